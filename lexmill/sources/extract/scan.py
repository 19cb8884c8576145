"""What the language scanners share: blanked sources, declarations, and a reader of brace scopes.

A scanner never fails on a broken file; it reports what it can recognise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Declaration:
    kind: str
    name: str
    start: int
    end: int
    signature: str | None = None
    container: str | None = None
    visibility: str | None = None


@dataclass
class Scope:
    kind: str
    name: str | None = None
    owner: str | None = None
    opened: list[Declaration] = field(default_factory=list)
    begun: int = 0


def blanked(text: str, comments: str, strings: str) -> str:
    """The text with comments and the insides of strings as spaces (line ends stay), so that offsets hold."""

    def blank(m: re.Match) -> str:
        found = m.group()
        if m.lastgroup == "string" and len(found) > 1:
            return found[0] + re.sub(r"[^\n]", " ", found[1:-1]) + found[-1]
        return re.sub(r"[^\n]", " ", found)

    return re.sub(rf"(?P<comment>{comments})|(?P<string>{strings})", blank, text)


C_COMMENTS = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
QUOTED = r'"(?:\\.|[^"\\\n])*"'
CHARS = r"'(?:\\.[^'\n]*|[^'\\\n])'"


def tidy(text: str) -> str:
    return text.strip()


def top_level_parts(text: str, opens: str = "([{<", closes: str = ")]}>") -> list[tuple[int, str]]:
    """(offset, part) between commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in opens:
            depth += 1
        elif c in closes and not (c == ">" and text[i - 1 : i] in ("-", "=")):
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append((at, text[at:i]))
            at = i + 1
    return [*out, (at, text[at:])]


#: A header (before "{") or a statement, its offset, and the scopes around it, innermost last.  Headers return the scope that opens.
OnHeader = Callable[[str, int, list[Scope]], Scope | None]
OnStatement = Callable[[str, int, list[Scope]], list[Declaration]]


def open_header(text: str, at: int, on_header: OnHeader, scopes: list[Scope]) -> tuple[int, Scope | None]:
    """Where the header begins and the scope that it opens; lines ahead of it that say nothing are passed over."""
    first = at + len(text) - len(text.lstrip())
    for m in re.finditer(r"\A|\n", text):
        rest = text[m.end() :]
        if rest.strip():
            begun = at + m.end() + len(rest) - len(rest.lstrip())
            if scope := on_header(rest.strip(), begun, scopes):
                return begun, scope
    return first, None


def read_braces(code: str, on_header: OnHeader, on_statement: OnStatement, lines_end: bool, groups: str | None = None) -> list[Declaration]:
    """Walks blanked code.  "{" and "}" open and close scopes; ";" (and line ends outside brackets, if lines_end) end statements.

    groups: headers before "(" that open a scope of their own instead of a bracket."""
    found: list[Declaration] = []
    scopes = [Scope("file")]
    at, depth = 0, 0
    stack: list[str] = []

    def statement(upto: int) -> None:
        nonlocal at
        text = code[at:upto]
        if text.strip():
            begun = at + len(text) - len(text.lstrip())
            for d in on_statement(text.strip(), begun, scopes):
                found.append(d)
        at = upto + 1

    for m in re.finditer(r"[{}();\n\[\]]", code):
        c, i = m.group(), m.start()
        if c in "([":
            header = code[at:i].strip()
            if c == "(" and groups and not depth and re.fullmatch(groups, header):
                scopes.append(Scope("group", header))
                stack.append("group")
                at = i + 1
            else:
                stack.append("bracket")
                depth += 1
        elif c in ")]":
            if stack and stack[-1] == "group":
                statement(i)
                stack.pop()
                scopes.pop()
            elif stack and stack[-1] == "bracket":
                stack.pop()
                depth -= 1
        elif c == "{":
            if depth:
                stack.append("inner")
                scopes.append(Scope("inner"))
                stack.append(str(depth))
                depth = 0
                continue
            begun, scope = open_header(code[at:i], at, on_header, scopes)
            scope = scope or Scope("block", scopes[-1].name, scopes[-1].owner)
            scope.begun = begun
            found += scope.opened
            scopes.append(scope)
            stack.append("scope" if scope.kind != "value" else "value")
            if scope.kind != "value":
                at = i + 1
        elif c == "}":
            while stack and stack[-1] == "bracket":
                stack.pop()
                depth = max(0, depth - 1)
            if stack and stack[-1].isdigit():
                depth = int(stack.pop())
                stack.pop()
                scopes.pop()
                continue
            if stack and stack[-1] in ("scope", "value"):
                value = stack.pop() == "value"
                if not value:
                    statement(i)
                closed = scopes.pop()
                for d in closed.opened:
                    d.end = i + 1
                at = at if value else i + 1
            else:
                at = i + 1
        elif not depth and (c == ";" or lines_end and c == "\n" and not (stack and stack[-1] == "value")):
            rest = code[at:i].rstrip()
            if c == ";" or not rest.endswith((",", "=", "|", "&", "(", ".", "+", ":", "=>")) and not re.match(r"\s*(?:[{|&.?]|=>)", code[i:]):
                statement(i)
    if code[at:].strip():
        statement(len(code))
    return found
