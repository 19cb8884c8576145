"""Context windows around matching lines, merged where they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.analyzers import body_tokens, lines
from lexmill.plans.patterns import Mode, parse_file_pattern

from .tokens import token_is


def file_lines(files: DataFrame) -> DataFrame:
    """file_path, line_number (from 1), line_content."""
    return files.select("file_path", F.posexplode(lines(F.col("content"))).alias("n", "line_content")).select("file_path", (F.col("n") + 1).alias("line_number"), "line_content")


def line_matches_pattern(line: Column, pattern: str) -> Column:
    """True if a token of the line meets any of the query's terms; the query's open ends count for each of them."""
    parsed = parse_file_pattern(pattern)
    if parsed.mode is Mode.EMPTY:
        return F.lit(False)
    mode = {(False, False): Mode.EXACT, (False, True): Mode.PREFIX, (True, False): Mode.SUFFIX, (True, True): Mode.SUBSTRING}[parsed.leading, parsed.trailing]
    return F.exists(body_tokens(line), lambda t: _any([token_is(mode, x, t) for x in parsed.tokens]))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def windows(marked: DataFrame, before: int, after: int) -> DataFrame:
    """Lines of marked (file_path, line_number, line_content, is_match) that lie in a window, with their group, counted from 1 in each file."""
    by_file = Window.partitionBy("file_path").orderBy("line_number")
    near = F.max(F.col("is_match").cast("int")).over(by_file.rowsBetween(-after, before))
    kept = marked.withColumn("near", near).where("near = 1").drop("near")
    begins = F.coalesce((F.col("line_number") - F.lag("line_number").over(by_file) > 1).cast("int"), F.lit(1))
    return kept.withColumn("b", begins).withColumn("grp", F.sum("b").over(by_file)).drop("b")


def groups(windowed: DataFrame) -> DataFrame:
    """file_path, grp, lo, hi, hits of each merged window."""
    return windowed.groupBy("file_path", "grp").agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi"), F.sum(F.col("is_match").cast("long")).alias("hits"))


def snippets(files: DataFrame, pattern: str, before: int = 2, after: int = 2) -> DataFrame:
    """The windows' lines for a token pattern: file_path, grp, line_number, line_content, is_match.  Only lines of files with a match are taken apart."""
    files = files.where(line_matches_pattern(F.col("content"), pattern))
    marked = file_lines(files).withColumn("is_match", line_matches_pattern(F.col("line_content"), pattern))
    return windows(marked, before, after)
