"""Scanners for Python and Ruby."""

from __future__ import annotations

import re

from .scan import Declaration, blanked, tidy

ID = r"[^\W\d]\w*"


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


class Python:
    language = "python"

    def symbols(self, text: str) -> list[Declaration]:
        triple = r"'''(?:\\(?s:.)|(?s:.))*?(?:'''|\Z)|\"\"\"(?:\\(?s:.)|(?s:.))*?(?:\"\"\"|\Z)"
        code = blanked(text, r"\#[^\n]*", rf"{triple}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
        found: list[Declaration] = []
        open_: list[tuple[int, Declaration]] = []
        classes: list[tuple[int, str]] = []
        last_end = 0
        for at, end in _logical_lines(code):
            line = code[at:end]
            indent = len(line) - len(line.lstrip())
            line, at = line.strip(), at + indent
            while open_ and open_[-1][0] >= indent:
                open_.pop()[1].end = last_end
            while classes and classes[-1][0] >= indent:
                classes.pop()
            last_end = at + len(line)
            owner = classes[-1][1] if classes else None
            if m := re.match(rf"(class|(?:async\s+)?def)\s+({ID})", line):
                header = line[: _colon(line) + 1]
                kind = "class" if m[1] == "class" else "method" if owner else "function"
                d = Declaration(kind, m[2], at, last_end, tidy(text[at : at + len(header)]), owner)
                found.append(d)
                open_.append((indent, d))
                if kind == "class":
                    classes.append((indent, m[2]))
                    rest, begun = line[len(header) :], at + len(header)
                    found += self._assigned(rest.strip(), begun + len(rest) - len(rest.lstrip()), m[2], text)
                continue
            if m := re.match(r"from\s+\S+\s+import\s+(.*)\Z", line, re.S):
                for part in m[1].split(","):
                    words = part.strip().strip("()").split()
                    if words and words[-1] not in ("*", "\\"):
                        found.append(Declaration("import", words[-1].strip("()"), at, last_end, tidy(text[at:last_end])))
                continue
            found += self._assigned(line, at, owner, text)
        for _, d in open_:
            d.end = last_end
        return found

    def _assigned(self, line: str, at: int, owner: str | None, text: str) -> list[Declaration]:
        """Names on the left of a plain or annotated assignment."""
        if re.match(r"(?:if|elif|while|for|return|assert|with|del|import|from|lambda|yield|raise|print|else|try|except|finally)\b", line):
            return []
        out, rest = [], line
        while m := re.match(rf"([\s\w,()\[\]*]*?{ID}[\s,()\[\]\w]*?)\s*(?::[^=]+)?=(?!=)", rest):
            if re.search(r"[\[(]", m[1]) and not re.fullmatch(rf"[\s(\[]*{ID}(?:\s*,\s*\*?{ID})*[\s,)\]]*", m[1]):
                break
            begun = at + line.index(rest)
            out += [Declaration("variable", n.group(), begun + n.start(), begun + n.end(), tidy(text[at : at + len(line)]), owner) for n in re.finditer(ID, m[1])]
            rest = rest[m.end() :]
        return out


def _colon(header: str) -> int:
    depth = 0
    for i, c in enumerate(header):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and not depth:
            return i
    return len(header) - 1


def _logical_lines(code: str) -> list[tuple[int, int]]:
    """(start, end) of lines that hold code, joined inside brackets and after a backslash."""
    out, begun, depth, i = [], 0, 0, 0
    for i, c in enumerate(code):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "\n" and not depth and code[i - 1 : i] != "\\":
            if code[begun:i].strip():
                out.append((begun, i))
            begun = i + 1
    if code[begun:].strip():
        out.append((begun, len(code)))
    return out


class Ruby:
    language = "ruby"
    OPENS = re.compile(r"(?:if|unless|while|until|case|for|begin)\b")

    def symbols(self, text: str) -> list[Declaration]:
        code = blanked(text, r"\#(?!\{)[^\n]*|^=begin(?s:.*?)^=end[^\n]*", r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
        found: list[Declaration] = []
        open_: list[tuple[str, Declaration | None]] = []
        starts = _line_starts(code)
        for begin, following in zip(starts, [*starts[1:], len(code) + 1], strict=True):
            for m in re.finditer(r"[^;]+", code[begin : following - 1]):
                part = m.group()
                at = begin + m.start() + len(part) - len(part.lstrip())
                self._statement(part.strip(), at, text, found, open_)
        for _, d in open_:
            if d:
                d.end = len(text)
        return found

    def _owner(self, open_) -> str | None:
        return next((d.name for kind, d in reversed(open_) if kind in ("class", "module")), None)

    def _statement(self, line: str, at: int, text: str, found: list, open_: list) -> None:
        if not line:
            return
        end = at + len(line)
        owner = self._owner(open_)

        def declare(kind: str, name: str, scope: str, visibility: str | None = None) -> None:
            d = Declaration(kind, name, at, end, tidy(text[at:end]), owner, visibility)
            found.append(d)
            if scope:
                open_.append((scope, d))

        if m := re.match(r"(class|module)\s+(?:[A-Z]\w*::)*([A-Z]\w*)", line):
            declare(m[1], m[2], m[1])
        elif re.match(r"class\s*<<", line):
            open_.append(("block", None))
        elif m := re.match(r"(?:(?:private|public|protected|module_function)\s+)?def\s+(self\.)?([^\s(;]+)", line):
            endless = re.match(r"def\s+[^=]*\)\s*=\s|def\s+\w+\s*=\s", line)
            declare("method" if m[1] or owner else "function", m[2], "" if endless else "def", "pub" if m[1] else None)
        elif m := re.match(r"([A-Z]\w*)\s*=(?![=~])", line):
            declare("constant", m[1], "")
            if re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*\Z", line):
                open_.append(("block", None))
        elif self.OPENS.match(line) or re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*\Z", line) or re.search(r"=\s*(?:if|unless|case|begin|while)\b", line):
            if not re.search(r"\bend\Z", line):
                open_.append(("block", None))
            return
        if re.search(r"(?:\A|\s)end\b", line) and open_:
            _, d = open_.pop()
            if d:
                d.end = end
