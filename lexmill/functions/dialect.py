"""The regular expression dialect: linear-time syntax, translated for the JVM's and Python's engines.

Lines end at "\\n" alone, classes are Unicode.  Look-around and back-references are refused.
"""

from __future__ import annotations

import regex

_BARRED = [
    (r"\(\?<?[=!]", "look-around"),
    (r"\\[1-9]", "back-references"),
    (r"\\k<", "back-references"),
    (r"\(\?P=", "back-references"),
    (r"\(\?>", "atomic groups"),
    (r"\(\?[a-z]*U", "swapped greed"),
]
#: Names of bracketed character classes, as ASCII sets: the JVM's own properties take in other scripts under its flag U.  "alpha" is that of Unicode, as test_dialect fixes it.
_POSIX = {"alpha": "\\p{Alpha}", "digit": "[0-9]", "alnum": "[0-9A-Za-z]", "upper": "[A-Z]", "lower": "[a-z]", "space": "[ \\t-\\r]", "punct": "[!-/:-@\\[-`{-~]", "word": "[A-Za-z0-9_]", "xdigit": "[0-9A-Fa-f]", "blank": "[ \\t]", "cntrl": "[\\x00-\\x1F\\x7F]", "print": "[ -~]", "graph": "[!-~]", "ascii": "[\\x00-\\x7F]"}


class BadPattern(ValueError):
    """A pattern that the dialect does not allow."""


def check(pattern: str) -> None:
    plain = regex.sub(r"\\\\", "", pattern)
    for barred, what in _BARRED:
        if regex.search(barred, plain):
            raise BadPattern(f"{what} are not supported: {pattern}")
    try:
        regex.compile(_named(pattern), regex.V1)
    except regex.error as e:
        raise BadPattern(f"{e}: {pattern}") from e


def _named(pattern: str) -> str:
    return regex.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)


def _pieces(pattern: str) -> list[tuple[str, str]]:
    """(kind, text): "escape", "class" (a whole bracketed class) or "plain" (one character)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(("escape", pattern[i : i + 2]))
            i += 2
        elif pattern[i] == "[":
            end, depth = i, 0
            while end < len(pattern):
                if pattern[end] == "\\":
                    end += 1
                elif pattern.startswith("[:", end) and (close := pattern.find(":]", end)) > 0:
                    end = close + 1
                elif pattern[end] == "[":
                    depth += 1
                elif pattern[end] == "]" and pattern[i + 1 : end] not in ("", "^"):
                    depth -= 1
                    if not depth:
                        break
                end += 1
            out.append(("class", pattern[i : end + 1]))
            i = end + 1
        else:
            out.append(("plain", pattern[i]))
            i += 1
    return out


def _posix(found: regex.Match) -> str:
    name = _POSIX.get(found[2])
    if name is None:
        raise BadPattern(f"unknown class {found[0]}")
    if not found[1]:
        return name
    return name.replace("\\p", "\\P") if name.startswith("\\p") else f"[^{name[1:-1]}]"


def _classes(text: str) -> str:
    return regex.sub(r"\[:(\^?)(\w+):\]", _posix, text)


def jvm_pattern(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """The same pattern for the JVM, flags in front.  A repeated repetition, possessive there, is folded into one."""
    check(pattern)
    out: list[str] = []
    repeat = ""
    for kind, text in _pieces(pattern):
        if kind == "class":
            text = _classes(text)
        if kind == "plain" and text == "+" and repeat:
            if repeat == "}":
                raise BadPattern(f"repeat a counted repetition within a group: {pattern}")
            out[-1] = "*" if repeat in "*?" else "+"
            continue
        repeat = text if kind == "plain" and text in "*+?}" else ""
        out.append(text)
    named = regex.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", "".join(out))
    return f"(?mdU{'s' if dot_all else ''}{'iu' if ignore_case else ''})" + named


def py_pattern(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> regex.Pattern:
    """The same pattern for Python workers."""
    check(pattern)
    flags = regex.V1 | regex.MULTILINE | (regex.IGNORECASE if ignore_case else 0) | (regex.DOTALL if dot_all else 0)
    translated = "".join(_classes(text) if kind == "class" else text for kind, text in _pieces(pattern))
    return regex.compile(_named(translated), flags)
