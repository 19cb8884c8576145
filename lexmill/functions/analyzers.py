"""Text analysis as column expressions: body tokens, identifier parts, lines.

A body token is a maximal run of alphabetic characters, numbers and "_", lower-cased, of at least two bytes.
Positions count all runs, short ones included.  The driver-side twins (query_tokens and others) follow the
same rules for query strings.
"""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_BYTES = 2

_BREAK = r"[^\p{IsAlphabetic}\p{N}_]+"
_BREAK_PY = regex.compile(r"[^\p{Alphabetic}\p{N}_]+")

#: Where an identifier falls apart: lower to upper, an acronym's end, to and from digits, and separators.
_PART = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|[^\p{IsAlphabetic}\p{N}]+"
_PART_PY = regex.compile(_PART.replace("IsAlphabetic", "Alphabetic"), flags=regex.V1)


def _long_enough(token: Column) -> Column:
    return F.octet_length(token) >= LEAST_BYTES


def _runs(text: Column, keep: Callable[[Column], Column]) -> Column:
    """Lower-cased runs that keep allows.  A text is lower-cased as a whole, unless it has one of the two characters whose lower case can move a boundary or depends on what follows a run."""
    text = F.coalesce(text, F.lit(""))
    plain = F.filter(F.split(F.lower(text), _BREAK), keep)
    careful = F.filter(F.transform(F.split(text, _BREAK), F.lower), keep)
    return F.when(text.contains("\u0130") | text.contains("\u03a3"), careful).otherwise(plain)


def token_runs(text: Column) -> Column:
    """All runs, lower-cased; short ones stay so that indexes are positions."""
    return _runs(text, lambda t: t != "")


def body_tokens(text: Column) -> Column:
    return _runs(text, _long_enough)


def token_positions(text: Column) -> Column:
    """array<struct<token, pos>> of the tokens that are long enough, at their places among all runs."""
    placed = F.transform(token_runs(text), lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    return F.filter(placed, lambda x: _long_enough(x["token"]))


def reversed_tokens(text: Column) -> Column:
    return F.transform(body_tokens(text), F.reverse)


def identifier_parts(name: Column) -> Column:
    """Lower-cased parts of a camel-case, snake-case or qualified name, of at least two bytes."""
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), _PART), F.lower)
    return F.filter(parts, _long_enough)


def lines(content: Column) -> Column:
    """Lines without their ends; an empty last line stays."""
    return F.transform(F.split(content, "\n"), trim_line_end)


def trim_line_end(line: Column) -> Column:
    return F.regexp_replace(line, r"\r?\n?\z", "")


def extension(path: Column) -> Column:
    """The lower-cased extension, "" without one."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r".\.([^./]+)\z", 1))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def clean_type(name: Column) -> Column:
    """A receiver or implementation target without references, pointers and type arguments."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[<\[].*\z", ""), r"\A[\s&*]+(?:mut\s+)?", ""))


def byte_line(content: Column, offset: Column) -> Column:
    """The 1-based line of a byte offset."""
    before = F.substring(F.col(content) if isinstance(content, str) else content.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def query_tokens(text: str) -> list[str]:
    return [t for t, _ in query_positions(text)]


def query_positions(text: str) -> list[tuple[str, int]]:
    runs = [t.lower() for t in _BREAK_PY.split(text) if t]
    return [(t, i) for i, t in enumerate(runs) if len(t.encode()) >= LEAST_BYTES]


def query_offsets(text: str) -> list[tuple[str, int]]:
    """Tokens with the byte offsets of their runs."""
    found = ((m.group().lower(), len(text[: m.start()].encode())) for m in regex.finditer(r"[\p{Alphabetic}\p{N}_]+", text))
    return [(t, at) for t, at in found if len(t.encode()) >= LEAST_BYTES]


def query_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART_PY.split(name) if p and len(p.lower().encode()) >= LEAST_BYTES]
