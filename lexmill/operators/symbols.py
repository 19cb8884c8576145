"""Symbol search: filters, name patterns, order, and refinement by a regex over the symbols' source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.analyzers import identifier_parts, lines
from lexmill.functions.dialect import jvm_pattern
from lexmill.functions.globs import glob_matches
from lexmill.plans.patterns import SymbolQuery, parse_symbol_query

SYMBOL_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("qualified_name", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("repo_rel_path", T.StringType()), T.StructField("container_name", T.StringType()),
    T.StructField("visibility", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("doc", T.StringType()),
])

LEAST_SUBSTRING = 3


class InvalidQuery(ValueError):
    """A symbol query that cannot be answered."""


def search_columns(symbols: DataFrame) -> DataFrame:
    """Adds what searches compare with; an index stores them."""
    return symbols.withColumns({
        "name_lower": F.lower("name"), "name_reversed": F.reverse(F.lower("name")), "name_parts": identifier_parts(F.col("name")),
        "qname_lower": F.lower("qualified_name"), "qname_reversed": F.reverse(F.lower("qualified_name")), "qname_parts": identifier_parts(F.col("qualified_name")),
        "repo_rel_path_lower": F.lower("repo_rel_path"),
    })


def _name(pattern: str, lower: Column, rev: Column, parts: Column) -> Column:
    """Several words without "%": all are parts of the name.  Else a leading or trailing "%" opens that end; any other "%" is itself."""
    pattern = pattern.lower()
    words = pattern.split()
    if len(words) > 1 and "%" not in pattern:
        return reduce(lambda a, b: a & b, [F.array_contains(parts, w) for w in words])
    text = pattern.strip("%")
    leading, trailing = pattern.startswith("%"), pattern.endswith("%")
    if not text:
        return F.lit(False)
    if leading and trailing:
        if len(text) < LEAST_SUBSTRING:
            raise InvalidQuery("symbol substring search requires at least 3 chars")
        return lower.contains(text)
    if leading:
        return rev.startswith(text[::-1])
    return lower.startswith(text) if trailing else lower == text


def predicate(query: SymbolQuery) -> Column:
    """The conjunction of a query's filters, on search_columns()."""
    if query.invalid:
        raise InvalidQuery(f"invalid filter {query.invalid}")
    tests = []
    if query.kinds:
        tests.append(F.col("kind").isin(*query.kinds))
    if query.language:
        tests.append(F.col("language") == query.language)
    if query.path_prefix is not None:
        tests.append(F.col("repo_rel_path_lower").startswith(query.path_prefix.lower()))
    if query.name:
        tests.append(_name(query.name, F.col("name_lower"), F.col("name_reversed"), F.col("name_parts")))
    if query.qualified_name:
        tests.append(_name(query.qualified_name, F.col("qname_lower"), F.col("qname_reversed"), F.col("qname_parts")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def refined(found: DataFrame, files: DataFrame, pattern: str, ignore_case: bool = False, multiline: bool = False) -> DataFrame:
    """Symbols whose signature matches or whose source lines do.  Sources are joined only for symbols whose signature doesn't match; files: repo_rel_path, content."""
    rx = jvm_pattern(pattern, ignore_case, multiline)
    by_signature = F.coalesce(F.col("signature").rlike(rx), F.lit(False))
    rest = found.where(~by_signature).join(files.select("repo_rel_path", "content"), "repo_rel_path")
    body = F.array_join(F.slice(lines(F.col("content")), F.col("line_start"), F.greatest(F.lit(0), F.col("line_end") - F.col("line_start") + 1)), "\n")
    return found.where(by_signature).unionByName(rest.where(body.rlike(rx)).select(*found.columns))


def ordered(found: DataFrame, limit: int | None = None) -> DataFrame:
    """By lower-cased path, line, kind and lower-cased name, and then by all that tells symbols apart, so that any partitioning gives one order; limit 0 or None: all."""
    first = ["repo_rel_path_lower", "line_start", "kind", "name_lower", "name", "repo_rel_path"]
    out = found.orderBy(*first, *[c for c in SYMBOL_SCHEMA.names if c not in first])
    return out.limit(limit) if limit else out


def search_symbols(symbols: DataFrame, query: str | SymbolQuery, limit: int | None = None, glob: str | None = None, refine: str | None = None, files: DataFrame | None = None, ignore_case: bool = False, multiline: bool = False) -> DataFrame:
    """The symbols found, in order.  Glob and refinement apply before the limit."""
    query = parse_symbol_query(query) if isinstance(query, str) else query
    symbols = symbols if "name_lower" in symbols.columns else search_columns(symbols)
    found = symbols.where(predicate(query))
    if glob is not None:
        found = found.where(glob_matches(F.col("repo_rel_path"), glob))
    if refine is not None:
        if files is None:
            raise InvalidQuery("a refinement needs the files")
        found = refined(found, files, refine, ignore_case, multiline)
    return ordered(found, limit).select(*SYMBOL_SCHEMA.names)


def distinct_files(found: DataFrame) -> DataFrame:
    """repo_rel_path of the symbols found, each once, by path."""
    return found.select("repo_rel_path").distinct().orderBy(F.lower("repo_rel_path"), "repo_rel_path")
