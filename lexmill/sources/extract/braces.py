"""Scanners for Go, Rust, TypeScript, Java, C, C++, C# and Zig."""

from __future__ import annotations

import re

from .scan import C_COMMENTS, CHARS, QUOTED, Declaration, Scope, blanked, read_braces, tidy, top_level_parts

ID = r"[A-Za-z_$]\w*"


class BraceScanner:
    """A language: how to blank its source, and what its headers and statements declare."""

    language = ""
    comments, strings = C_COMMENTS, f"{QUOTED}|{CHARS}"
    lines_end = False
    groups: str | None = None

    def symbols(self, text: str) -> list[Declaration]:
        self.text = text
        self.code = self.prepared(blanked(text, self.comments, self.strings))
        found = read_braces(self.code, self.header, self.statement, self.lines_end, self.groups)
        return sorted(found, key=lambda d: (d.start, -d.end))

    def prepared(self, code: str) -> str:
        return code

    def header(self, text: str, at: int, scopes: list[Scope]) -> Scope | None:
        return None

    def statement(self, text: str, at: int, scopes: list[Scope]) -> list[Declaration]:
        return []

    def declared(self, kind: str, name: str, at: int, text: str, container: str | None = None, visibility: str | None = None) -> Declaration:
        """A declaration that spans text; its signature is the source there."""
        return Declaration(kind, name, at, at + len(text), tidy(self.text[at : at + len(text)]), container, visibility)


def _go_visibility(name: str) -> str:
    return "pub" if name[:1].isupper() else "private"


class Go(BraceScanner):
    language = "go"
    strings = rf"{QUOTED}|{CHARS}|`[^`]*`"
    lines_end = True
    groups = r"(?:type|const|var|import)"

    def _in_group(self, scopes: list[Scope], word: str) -> bool:
        return scopes[-1].kind == "group" and scopes[-1].name == word

    def header(self, text, at, scopes):
        if m := re.match(rf"func\s*\(([^)]*)\)\s*({ID})", text):
            receiver = re.sub(r"\[.*", "", m[1].split()[-1] if m[1].split() else "").lstrip("*& ")
            return Scope("function", opened=[self.declared("method", m[2], at, text, receiver or None, _go_visibility(m[2]))])
        if m := re.match(rf"func\s+({ID})", text):
            return Scope("function", opened=[self.declared("function", m[1], at, text, None, _go_visibility(m[1]))])
        word = r"" if self._in_group(scopes, "type") else r"type\s+"
        if m := re.match(rf"{word}({ID})\s*(?:\[[^\]]*\])?\s*=?\s*(struct|interface)\s*\Z", text):
            return Scope(m[2], m[1], opened=[self.declared(m[2], m[1], at, text, None, _go_visibility(m[1]))])
        if scopes[-1].kind == "struct" and re.match(rf"{ID}(?:\s*,\s*{ID})*\s+.*struct\s*\Z", text):
            return Scope("struct", scopes[-1].name, opened=self._fields(text, at, scopes[-1].name))
        if re.match(r"(?:var|const|type)\b", text) or scopes[-1].kind == "group":
            return Scope("value")
        return None

    def _fields(self, text, at, container):
        m = re.match(rf"({ID}(?:\s*,\s*{ID})*)\s+\S", text)
        return [self.declared("field", n.strip(), at, text, container) for n in m[1].split(",")] if m else []

    def statement(self, text, at, scopes):
        if scopes[-1].kind == "struct":
            return self._fields(text, at, scopes[-1].name)
        if scopes[-1].kind == "interface":
            return []
        m = re.match(r"(type|const|var)\s+", text)
        word = m[1] if m else scopes[-1].name if scopes[-1].kind == "group" else None
        rest = text[m.end() :] if m else text
        if word == "type" and (t := re.match(rf"({ID})\s*(?:\[[^\]]*\])?\s*=?\s*\S", rest)):
            return [self.declared("type_alias", t[1], at, text, None, _go_visibility(t[1]))]
        if word in ("const", "var") and (t := re.match(rf"({ID}(?:\s*,\s*{ID})*)", rest)):
            return [self.declared("constant" if word == "const" else "variable", n.strip(), at, text, None, _go_visibility(n.strip())) for n in t[1].split(",")]
        if m := re.match(rf"func\s+({ID})\s*\(", text):
            return [self.declared("function", m[1], at, text, None, _go_visibility(m[1]))]
        return []


class Rust(BraceScanner):
    language = "rust"
    comments = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
    strings = rf'r(#*)"(?s:.*?)"\2|b?{QUOTED}|{CHARS}'

    PUB = r"(?:#!?\[[^\]]*\]\s*)*(pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?"
    strings = rf'r#+"(?s:.*?)"#+|r"[^"]*"|"(?:\\(?s:.)|[^"\\])*"|{CHARS}'

    def _vis(self, m: re.Match) -> str:
        return "pub" if m[1] else "private"

    def header(self, text, at, scopes):
        if m := re.match(rf"{self.PUB}(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+({ID})", text):
            owner = scopes[-1].name if scopes[-1].kind == "impl" else None
            return Scope("function", opened=[self.declared("method" if owner else "function", m[2], at, text, owner, self._vis(m))])
        if m := re.match(rf"{self.PUB}(?:unsafe\s+)?(struct|union|enum|trait|mod)\s+({ID})", text):
            if m[2] == "union":
                return None
            kind = {"mod": "module"}.get(m[2], m[2])
            return Scope(kind, m[3], opened=[self.declared(kind, m[3], at, text, None, self._vis(m))])
        if re.match(r"(?:#\[[^\]]*\]\s*)*(?:unsafe\s+)?impl\b", text):
            return Scope("impl", self._target(text))
        if re.match(rf"{self.PUB}(?:const|static|type)\b", text):
            return Scope("value")
        return None

    def _target(self, text: str) -> str | None:
        rest = re.sub(r"^.*?\bimpl\b\s*", "", text, count=1, flags=re.S)
        depth, i = 0, 0
        if rest.startswith("<"):
            for i, c in enumerate(rest):
                depth += (c == "<") - (c == ">" and rest[i - 1] != "-")
                if not depth:
                    break
            rest = rest[i + 1 :]
        rest = re.split(r"\bwhere\b", rest)[0]
        rest = re.split(r"\bfor\b", rest)[-1]
        return re.sub(r"<.*", "", rest.strip().lstrip("&").removeprefix("mut "), flags=re.S).strip() or None

    def statement(self, text, at, scopes):
        if scopes[-1].kind == "struct":
            out = []
            for offset, part in top_level_parts(text):
                lead = len(part) - len(part.lstrip())
                if m := re.match(rf"{self.PUB}({ID})\s*:[^:]", part.strip()):
                    out.append(self.declared("field", m[2], at + offset + lead, part.strip(), scopes[-1].name, self._vis(m)))
            return out
        if m := re.match(rf"{self.PUB}(struct|mod|type|const)\s+({ID})", text):
            if m[2] == "const" and m[3] == "fn" or m[2] == "type" and scopes[-1].kind in ("trait", "impl"):
                return []
            kind = {"mod": "module", "type": "type_alias", "const": "constant"}.get(m[2], m[2])
            return [self.declared(kind, m[3], at, text, None, self._vis(m))]
        return []


class TypeScript(BraceScanner):
    language = "typescript"
    strings = rf"{QUOTED}|'(?:\\.|[^'\\\n])*'|`(?:\\(?s:.)|[^`\\])*`"
    lines_end = True
    LEAD = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"

    def header(self, text, at, scopes):
        if m := re.match(rf"{self.LEAD}(?:async\s+)?function\s*\*?\s*({ID})", text):
            return Scope("function", opened=[self.declared("function", m[1], at, text)])
        if m := re.match(rf"{self.LEAD}(?:abstract\s+)?(class|interface|(?:const\s+)?enum)\s+({ID})", text):
            kind = m[1].split()[-1]
            owner = scopes[-1].name if kind == "class" and scopes[-1].kind == "class" else None
            return Scope(kind, m[2], opened=[self.declared(kind, m[2], at, text, owner)])
        if re.match(rf"{self.LEAD}type\s+{ID}", text):
            return Scope("value")
        if m := re.match(rf"{self.LEAD}(?:const|let|var)\s+({ID})", text):
            made = [self.declared("variable", m[1], at, text)]
            arrow = re.search(r"=>\s*\Z|\bfunction\b[^{{]*\Z", text)
            return Scope("function" if arrow else "object", opened=made)
        if scopes[-1].kind == "class":
            mods = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|declare)\s+)*\*?\s*"
            if (m := re.match(rf"(?:@\w+(?:\([^)]*\))?\s*)*{mods}(#?{ID})\s*(?:<[^>]*>)?\s*\(", text)) and m[1] not in ("if", "for", "while", "switch", "catch"):
                return Scope("function", opened=[self.declared("method", m[1], at, text, scopes[-1].name)])
        return None

    def statement(self, text, at, scopes):
        if scopes[-1].kind in ("interface", "enum", "object"):
            return []
        if m := re.match(rf"{self.LEAD}type\s+({ID})\s*(?:<[^=]*>)?\s*=", text):
            return [self.declared("type_alias", m[1], at, text)]
        if scopes[-1].kind != "class" and (m := re.match(rf"{self.LEAD}(?:const|let|var)\s+", text)):
            out = []
            for offset, part in top_level_parts(text[m.end() :], "([{", ")]}"):
                if n := re.match(rf"\s*({ID})", part):
                    out.append(self.declared("variable", n[1], at, text))
            return out
        return []


_JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp|transient|volatile|sealed|non-sealed|@\w+(?:\([^)]*\))?)\s+)*"


def _word_visibility(text: str, words: dict[str, str]) -> str | None:
    head = re.split(r"[({=]", re.sub(r"@\w+\([^)]*\)", "", text))[0].split()
    return next((words[w] for w in head if w in words), None)


class Java(BraceScanner):
    language = "java"
    strings = rf'"""(?s:.*?)"""|{QUOTED}|{CHARS}'
    WORDS = {"public": "pub", "private": "private", "protected": "protected"}
    TYPE = r"(?:<[^>]*>\s*)?[\w.$]+(?:<[^;{}()]*>)?(?:\s*\[\s*\])*"

    def _owner(self, scopes):
        return scopes[-1].name if scopes[-1].kind in ("class", "interface", "enum") else None

    def header(self, text, at, scopes):
        vis = _word_visibility(text, self.WORDS)
        if m := re.match(rf"{_JAVA_MODS}(class|interface|enum)\s+({ID})", text):
            return Scope(m[1], m[2], opened=[self.declared(m[1], m[2], at, text, self._owner(scopes), vis)])
        owner = self._owner(scopes)
        if owner and (m := re.match(rf"{_JAVA_MODS}(?:{self.TYPE}\s+)?({ID})\s*\(", text)) and m[1] not in ("if", "for", "while", "switch", "catch", "new", "synchronized", "return"):
            head = text.rsplit(",", 1)[-1] if scopes[-1].kind == "enum" and "," in text.split("(")[0] else text
            if not (scopes[-1].kind == "enum" and re.fullmatch(rf"{ID}\s*\(.*\)", head, re.S) and m[1] != owner):
                return Scope("function", opened=[self.declared("method", m[1], at, text, owner, vis)])
        if owner and "=" in text:
            return Scope("value")
        return None

    def statement(self, text, at, scopes):
        if m := re.match(r"import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*\Z", text):
            return [] if m[2] else [self.declared("import", m[1].rpartition(".")[2], at, text)]
        owner = self._owner(scopes)
        if not owner:
            return []
        vis = _word_visibility(text, self.WORDS)
        if m := re.match(rf"{_JAVA_MODS}{self.TYPE}\s+({ID})\s*\(", text):
            return [self.declared("method", m[1], at, text, owner, vis)]
        if m := re.match(rf"{_JAVA_MODS}{self.TYPE}\s+({ID})\s*(?:\[\s*\]\s*)*(?:[=,]|\Z)", text):
            if scopes[-1].kind == "interface":
                return [self.declared("constant", m[1], at, text, owner, "pub")]
            return [self.declared("field", m[1], at, text, owner, vis)]
        return []


_NO_NAMES = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "case", "new", "delete", "using", "lock", "fixed", "foreach"}


class C(BraceScanner):
    language = "c"
    MACRO = re.compile(rf"(?m)^[ \t]*#[ \t]*define[ \t]+({ID})(?![\w(])[^\n]*")

    def symbols(self, text):
        found = super().symbols(text)
        plain = blanked(text, self.comments, self.strings)
        for m in self.MACRO.finditer(plain):
            lead = len(m.group()) - len(m.group().lstrip())
            found.append(self.declared("constant", m[1], m.start() + lead, m.group()[lead:].rstrip()))
        return sorted(found, key=lambda d: (d.start, -d.end))

    def prepared(self, code):
        return re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m.group()), code)

    def _function(self, text: str) -> str | None:
        """The name before the parameter list; qualified names end in it."""
        head = re.split(r"(?<!:):(?!:)", text)[0] if not text.startswith("template") else text
        m = re.search(rf"((?:~\s*)?{ID}|operator\s*[^\s\w(]+)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|->[^{{]*|\s)*\Z", head)
        if not m or m[1] in _NO_NAMES or "=" in head[: m.start()]:
            return None
        return re.sub(r"\s+", "", m[1])

    def header(self, text, at, scopes):
        if m := re.search(rf"\b(struct|enum|union)\s+({ID})\s*\Z", text):
            made = [] if m[1] == "union" else [self.declared(m[1], m[2], at, text)]
            return Scope("record" if m[1] != "enum" else "enum", m[2], opened=made)
        if re.match(r"typedef\b|.*\b(?:struct|union|enum)\s*\Z", text, re.S):
            return Scope("record", None)
        if "=" in text:
            return Scope("value")
        if scopes[-1].kind == "file" and (name := self._function(text)):
            return Scope("function", opened=[self.declared("function", name, at, text)])
        return None

    def statement(self, text, at, scopes):
        if scopes[-1].kind != "file":
            return []
        before = self.code[:at].rstrip()
        if before.endswith("}") and self._typedef_before(before) and (m := re.search(rf"({ID})\s*\Z", text)):
            return [self.declared("type_alias", m[1], at, text)]
        if m := re.match(r"typedef\b", text):
            n = re.search(rf"\(\s*\*\s*({ID})\s*\)", text) or re.search(rf"({ID})\s*(?:\[[^\]]*\]\s*)*\Z", text)
            return [self.declared("type_alias", n[1], at, text)] if n else []
        head = text.split("=")[0]
        m = re.match(rf"(?:[\w]+[\s*]+)+?({ID})\s*(?:\(|\[|,|\Z)", head)
        if m and m[1] not in _NO_NAMES and not re.match(r"(?:struct|enum|union)\s+\w+\s*\Z", head.strip()):
            return [self.declared("variable", m[1], at, text)]
        return []

    def _typedef_before(self, before: str) -> bool:
        depth = 0
        for i in range(len(before) - 1, -1, -1):
            depth += (before[i] == "}") - (before[i] == "{")
            if not depth:
                return bool(re.search(r"typedef\b[^;{}]*\Z", before[:i]))
        return False


class Cpp(C):
    language = "cpp"
    strings = rf'R"(?P<tag>\w*)\((?s:.*?)\)(?P=tag)"|{QUOTED}|{CHARS}'
    TEMPLATE = r"(?:template\s*<[^{}]*?>\s*)?"

    def prepared(self, code):
        code = super().prepared(code)
        return re.sub(r"\b(?:public|private|protected)\s*:(?!:)", lambda m: re.sub(r"[^\n]", " ", m.group()[:-1]) + ";", code)

    def _owner(self, scopes):
        return next((s.name for s in reversed(scopes) if s.kind in ("class", "namespace")), None)

    def header(self, text, at, scopes):
        inside = scopes[-1].kind == "class"
        if m := re.match(rf"(?:inline\s+)?namespace(?:\s+([\w:]+))?\s*\Z", text):
            name = m[1].rpartition("::")[2] if m[1] else None
            return Scope("namespace", name, opened=[self.declared("module", name, at, text, self._owner(scopes))] if name else [])
        if m := re.match(rf"{self.TEMPLATE}(?:typedef\s+)?(class|struct)\s+(?:\[\[.*?\]\]\s*)?({ID})(?:\s+final)?\s*(?::[^:].*)?\Z", text, re.S):
            return Scope("class", m[2], opened=[self.declared(m[1], m[2], at, text, self._owner(scopes))])
        if m := re.match(rf"enum\s+(?:class\s+|struct\s+)?({ID})\s*(?::[^:].*)?\Z", text):
            return Scope("enum", m[1], opened=[self.declared("enum", m[1], at, text, self._owner(scopes))])
        if re.match(r"extern\s+\"", text):
            return Scope("namespace", self._owner(scopes))
        if scopes[-1].kind in ("file", "namespace", "class"):
            if name := self._function(text):
                return Scope("function", opened=[self.declared("method" if inside else "function", name, at, text, self._owner(scopes))])
            if "=" in text or inside:
                return Scope("value")
        return None

    def statement(self, text, at, scopes):
        owner, place = self._owner(scopes), scopes[-1].kind
        if place not in ("file", "namespace", "class"):
            return []
        if m := re.match(rf"{self.TEMPLATE}using\s+({ID})\s*=", text):
            return [self.declared("type_alias", m[1], at, text, owner)]
        if re.match(r"typedef\b", text) and (m := re.search(rf"({ID})\s*\Z", text)):
            return [self.declared("type_alias", m[1], at, text, owner)]
        if place == "class" and not re.match(r"(?:friend|using|template|class|struct|enum)\b", text):
            head = text.split("=")[0]
            if "(" not in head and (m := re.match(rf"(?:[\w:<>,*&\s]+?[\s*&>])({ID})\s*(?:\[[^\]]*\])?\s*\Z", head.split("{")[0])):
                return [self.declared("field", m[1], at, text, owner)]
        return []


class CSharp(BraceScanner):
    language = "csharp"
    strings = rf'@"(?:""|[^"])*"|\$?{QUOTED}|{CHARS}'
    WORDS = {"public": "pub", "private": "private", "protected": "protected", "internal": "internal"}
    MODS = r"(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|readonly|sealed|abstract|virtual|override|async|partial|extern|unsafe|new|const|volatile|required|ref)\s+)*"
    TYPE = r"[\w.?]+(?:<[^;{}()]*>)?\??(?:\[[,\s]*\])*\??"

    def _owner(self, scopes):
        return next((s.name for s in reversed(scopes) if s.kind in ("class", "namespace")), None)

    def header(self, text, at, scopes):
        vis, owner = _word_visibility(text, self.WORDS), self._owner(scopes)
        if m := re.match(r"namespace\s+([\w.]+)\s*\Z", text):
            return Scope("namespace", m[1], opened=[self.declared("module", m[1], at, text, owner)])
        if m := re.match(rf"{self.MODS}(class|struct|interface|enum)\s+({ID})", text):
            return Scope("class" if m[1] != "enum" else "enum", m[2], opened=[self.declared(m[1], m[2], at, text, owner, vis)])
        if scopes[-1].kind == "class":
            if (m := re.match(rf"{self.MODS}(?:{self.TYPE}\s+)?({ID})\s*(?:<[^>]*>)?\s*\(", text)) and m[1] not in _NO_NAMES:
                return Scope("function", opened=[self.declared("method", m[1], at, text, owner, vis)])
            if "=" in text:
                return Scope("value")
            if m := re.match(rf"{self.MODS}{self.TYPE}\s+({ID})\s*\Z", text):
                return Scope("accessors", opened=[self.declared("property", m[1], at, text, owner, vis)])
        return None

    def statement(self, text, at, scopes):
        if m := re.match(r"namespace\s+([\w.]+)\s*\Z", text):
            scopes[0].kind, scopes[0].name = "namespace", m[1]
            return [self.declared("module", m[1], at, text)]
        if scopes[-1].kind != "class":
            return []
        vis, owner = _word_visibility(text, self.WORDS), self._owner(scopes)
        if (m := re.match(rf"{self.MODS}(?:{self.TYPE}\s+)?({ID})\s*(?:<[^>]*>)?\s*\(", text)) and m[1] not in _NO_NAMES and "=" not in text.split("(")[0]:
            return [self.declared("method", m[1], at, re.split(r"\s*=>", text)[0], owner, vis)]
        if m := re.match(rf"{self.MODS}{self.TYPE}\s+({ID})\s*=>", text):
            return [self.declared("property", m[1], at, text, owner, vis)]
        if m := re.match(rf"{self.MODS}(?:event\s+)?{self.TYPE}\s+({ID})\s*(?:[=,]|\Z)", text):
            return [self.declared("field", m[1], at, text, owner, vis)]
        return []


class Zig(BraceScanner):
    language = "zig"
    comments = r"//[^\n]*"
    strings = rf"{QUOTED}|{CHARS}|\\\\[^\n]*"

    def header(self, text, at, scopes):
        if m := re.search(rf"(?:\A|,)\s*((?:(?:pub|export|inline|noinline|extern)\s+)*fn\s+({ID}).*)\Z", text, re.S):
            at, text = at + m.start(1), m[1]
            return Scope("function", opened=[self.declared("function", m[2], at, text, None, "pub" if re.match(r"pub\b", text) else "private")])
        if re.match(r"test\b", text):
            name = self.text[at : at + len(text)].strip()[4:].strip().strip('"')
            return Scope("function", opened=[self.declared("function", name, at, text)]) if name else None
        if m := re.match(rf"(pub\s+)?(?:threadlocal\s+)?(const|var)\s+({ID})\b[^=]*=\s*(.*)\Z", text, re.S):
            made = [self.declared("constant" if m[2] == "const" else "variable", m[3], at, text, None, "pub" if m[1] else "private")]
            return Scope("container", m[3], opened=made)
        return None

    def statement(self, text, at, scopes):
        if m := re.match(rf"(pub\s+)?(?:threadlocal\s+|extern\s+|export\s+)?(const|var)\s+({ID})", text):
            return [self.declared("constant" if m[2] == "const" else "variable", m[3], at, text, None, "pub" if m[1] else "private")]
        return []
