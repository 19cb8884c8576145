"""Regex search: necessary literals narrow the files, the regex decides, lines and snippets come last.

Narrowing never changes the answer.  A literal test on the text runs before the regex; with an index, files are
first cut down through token fragments, unless the planner expects too many of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.analyzers import lines
from lexmill.functions.dialect import jvm_pattern, py_pattern
from lexmill.plans.literals import literal_candidates, phrases, token_candidates
from lexmill.plans.patterns import Candidates
from lexmill.plans.planner import prefer_scan

from .corpus import Corpus
from .snippets import file_lines, windows
from .tokens import all_substrings, phrase


def holds(text: Column, needed: Candidates) -> Column:
    """The literal test as a predicate."""
    if needed.everything:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [text.contains(x) for x in branch]) for branch in needed.branches])


def candidates(corpus: Corpus, pattern: str) -> DataFrame | None:
    """file_path of the files that may match, from token fragments; None if nothing is known."""
    needed = token_candidates(pattern)
    if needed.everything:
        return None
    return reduce(DataFrame.unionByName, [all_substrings(corpus, b) for b in needed.branches]).distinct()


def phrase_candidates(corpus: Corpus, pattern: str) -> DataFrame | None:
    """file_path of the files that hold one of the few exact strings of a pattern as whole tokens; None if it has none of two tokens or more.

    A string may also lie inside longer tokens, so these are sure to match but not all."""
    found = phrases(pattern)
    if not found:
        return None
    return reduce(DataFrame.unionByName, [phrase(corpus, list(p.terms)).select("file_path") for p in found]).distinct()


def narrowed(corpus: Corpus, pattern: str, ignore_case: bool = False, use_index: bool | None = None) -> DataFrame:
    """Files that hold the pattern's literals; through the index if there is one and the planner favours it."""
    files = corpus.files
    if corpus.postings is not None and use_index is not False:
        found = candidates(corpus, pattern)
        if found is not None and (use_index or not prefer_scan(corpus, token_candidates(pattern))):
            files = files.join(found, "file_path", "left_semi")
    return files if ignore_case else files.where(holds(F.col("content"), literal_candidates(pattern)))


def _matches(pattern: str, ignore_case: bool, multiline: bool) -> Column:
    """Whole content with multiline (a match may span lines), else any line."""
    found = jvm_pattern(pattern, ignore_case, multiline)
    if multiline:
        return F.col("content").rlike(found)
    return F.exists(lines(F.col("content")), lambda x: x.rlike(found))


def matching_files(corpus: Corpus, pattern: str, ignore_case: bool = False, multiline: bool = False, limit: int | None = None, use_index: bool | None = None) -> DataFrame:
    """file_path, by path; limit None or 0: all."""
    found = narrowed(corpus, pattern, ignore_case, use_index).where(_matches(pattern, ignore_case, multiline)).select("file_path").orderBy("file_path")
    return found.limit(limit) if limit else found


def count_files(corpus: Corpus, pattern: str, ignore_case: bool = False, multiline: bool = False) -> DataFrame:
    """One row, n; no limit applies."""
    return narrowed(corpus, pattern, ignore_case).where(_matches(pattern, ignore_case, multiline)).agg(F.count(F.lit(1)).alias("n"))


def spanned_lines(content: str, pattern) -> list[tuple[int, str]]:
    """(line number, text) of every line that a match touches, once each; an empty match touches the line it stands in."""
    starts = [0, *(i + 1 for i, c in enumerate(content) if c == "\n")]
    texts = [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]
    out: dict[int, str] = {}
    at = 0
    for m in pattern.finditer(content):
        while at + 1 < len(starts) and starts[at + 1] <= m.start():
            at += 1
        last = at
        while last + 1 < len(starts) and starts[last + 1] < m.end():
            last += 1
        if m.start() == len(content) and starts[at] == len(content) and m.start() == m.end() and len(content):
            continue
        for n in range(at, last + 1):
            out[n + 1] = texts[n]
    return sorted(out.items())


def _spanning(pattern: str, ignore_case: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = py_pattern(pattern, ignore_case, True)
        for batch in batches:
            rows = [(p, n, x) for p, c in zip(batch["file_path"], batch["content"], strict=True) for n, x in spanned_lines(c or "", compiled)]
            yield pd.DataFrame(rows, columns=["file_path", "line_number", "line_content"])

    return run


def matching_lines(corpus: Corpus, pattern: str, ignore_case: bool = False, multiline: bool = False) -> DataFrame:
    """file_path, line_number, line_content of every matching line."""
    files = narrowed(corpus, pattern, ignore_case)
    if multiline:
        files = files.where(_matches(pattern, ignore_case, True))
        return files.select("file_path", "content").mapInPandas(_spanning(pattern, ignore_case), "file_path string, line_number int, line_content string")
    found = jvm_pattern(pattern, ignore_case)
    return file_lines(files).where(F.col("line_content").rlike(found))


def regex_snippets(corpus: Corpus, pattern: str, before: int = 2, after: int = 2, ignore_case: bool = False) -> DataFrame:
    """file_path, grp, line_number, line_content, is_match: matching lines with their context."""
    files = narrowed(corpus, pattern, ignore_case).where(_matches(pattern, ignore_case, False))
    marked = file_lines(files).withColumn("is_match", F.col("line_content").rlike(jvm_pattern(pattern, ignore_case)))
    return windows(marked, before, after)


def nested_snippets(snippets: DataFrame) -> DataFrame:
    """One row a file: matches and snippets as arrays."""
    line = F.struct("line_number", "line_content", "is_match")
    grouped = snippets.groupBy("file_path", "grp").agg(F.sort_array(F.collect_list(line)).alias("snippet"))
    whole = grouped.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("grp", "snippet"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda x: x["snippet"]))
    matches = F.transform(F.filter(flat, lambda x: x["is_match"]), lambda x: F.struct(x["line_number"].alias("line_number"), x["line_content"].alias("line_content")))
    return whole.select("file_path", matches.alias("matches"), F.transform("s", lambda x: x["snippet"]).alias("snippets"))
