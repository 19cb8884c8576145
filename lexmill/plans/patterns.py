"""Query texts as plans: file patterns, symbol queries and the boolean plan of literals that a regex needs."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from lexmill.functions.analyzers import query_tokens


class Mode(Enum):
    EMPTY = "empty"
    EXACT = "exact"
    PREFIX = "prefix"
    SUFFIX = "suffix"
    SUBSTRING = "substring"
    ALL_TERMS = "all terms"


@dataclass(frozen=True)
class FilePattern:
    mode: Mode
    tokens: tuple[str, ...] = ()
    leading: bool = False
    trailing: bool = False


def parse_file_pattern(text: str) -> FilePattern:
    """A leading or trailing "%" opens that end of a single token; several tokens must all occur, and "%" has no say."""
    text = text.strip()
    leading, trailing = text.startswith("%"), text.endswith("%")
    tokens = tuple(query_tokens(text.strip("%")))
    if not tokens:
        return FilePattern(Mode.EMPTY)
    if len(tokens) > 1:
        return FilePattern(Mode.ALL_TERMS, tokens, leading, trailing)
    mode = {(False, False): Mode.EXACT, (False, True): Mode.PREFIX, (True, False): Mode.SUFFIX, (True, True): Mode.SUBSTRING}
    return FilePattern(mode[leading, trailing], tokens, leading, trailing)


#: Kinds of symbols, in order.
KINDS = ("function", "method", "class", "struct", "enum", "interface", "type_alias", "trait", "module", "variable", "constant", "property", "field", "import")
#: Other names of kinds; "fn" and "function" mean both callables.
KIND_NAMES = {"fn": ("function", "method"), "function": ("function", "method"), "var": ("variable",), "prop": ("property",), "const": ("constant",), "mod": ("module",), "type": ("type_alias",)}
#: Languages of symbols, and their other names.
LANGUAGES = ("go", "rust", "python", "typescript", "java", "c", "cpp", "csharp", "ruby", "zig")
LANGUAGE_NAMES = {"rs": "rust", "py": "python", "ts": "typescript", "rb": "ruby", "cs": "csharp"}


@dataclass(frozen=True)
class SymbolQuery:
    kinds: tuple[str, ...] = ()
    language: str | None = None
    path_prefix: str | None = None
    name: str = ""
    qualified_name: str | None = None
    invalid: str | None = None

    @property
    def has_filters(self) -> bool:
        return bool(self.kinds or self.language or self.path_prefix is not None or self.qualified_name is not None or self.invalid)


def kinds_of(name: str) -> tuple[str, ...] | None:
    name = name.lower()
    return KIND_NAMES.get(name) or ((name,) if name in KINDS else None)


def language_of(name: str) -> str | None:
    name = name.lower()
    name = LANGUAGE_NAMES.get(name, name)
    return name if name in LANGUAGES else None


def parse_symbol_query(text: str) -> SymbolQuery:
    """Leading kind:, lang:, path: and qname: filters, the last of a key wins; the rest is the name pattern.  A bad kind or language ends the parse and marks the query invalid."""
    words = text.split()
    found: dict = {}
    for at, word in enumerate(words):
        key, colon, value = word.partition(":")
        if not colon or key not in ("kind", "lang", "path", "qname"):
            return SymbolQuery(**found, name=" ".join(words[at:]))
        if key == "kind":
            kinds = kinds_of(value)
            if kinds is None:
                return SymbolQuery(**found, invalid=word)
            found["kinds"] = kinds
        elif key == "lang":
            language = language_of(value)
            if language is None:
                return SymbolQuery(**found, invalid=word)
            found["language"] = language
        elif key == "path":
            found["path_prefix"] = value
        else:
            found["qualified_name"] = value
    return SymbolQuery(**found)


@dataclass(frozen=True)
class Candidates:
    """What a text must hold for a regex to match it: any of the branches, and all literals of a branch.  No branches: nothing is known."""

    branches: tuple[tuple[str, ...], ...] = ()

    @property
    def everything(self) -> bool:
        return not self.branches

    @property
    def is_and(self) -> bool:
        return len(self.branches) == 1


@dataclass(frozen=True)
class Phrase:
    """Terms at relative positions; size is the literal's length in bytes."""

    terms: tuple[tuple[int, str], ...]
    size: int = field(default=0, compare=False)
