"""Glob patterns as regular expressions: "*" and "?" also match "/", "**" only stands as a whole component."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The whole-string regular expression of a glob; ValueError if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            end = i
            while end < len(pattern) and pattern[end] == "*":
                end += 1
            before, after = i == 0 or pattern[i - 1] == "/", end == len(pattern) or pattern[end] == "/"
            if end - i > 2 or not (before and after):
                raise ValueError("** must be a whole path component")
            if end < len(pattern):
                out.append("(?:.*/)?")
                i = end + 1
            else:
                out.append(".*")
                i = end
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern.startswith("[!", i) else 2))
            if end < 0:
                raise ValueError("a character class has no end")
            negated = pattern[i + 1] == "!"
            inner = pattern[i + 1 + negated : end]
            inner = re.sub(r"([\\\[\]^&])", r"\\\1", inner)
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_matches(path: Column, pattern: str) -> Column:
    """True if the whole path or its last component matches."""
    found = glob_regex(pattern)
    return path.rlike(found) | F.regexp_extract(path, r"([^/]*)\z", 1).rlike(found)
