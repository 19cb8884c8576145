"""URL rules and a list of blocked URLs, by DataFrame expressions alone.

A URL's host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; its path is
what follows up to "?", "#" or the end.  A null URL, or one without "://", has an empty host and path.

Rules (verdict, host, path) fit their host and its subdomains if the URL's path starts with the rule's path.
The longest rule that fits decides (length of host and path together; ties by block before allow, then by
text).  Other URLs are blocked if their canonical form is on the list.

The list becomes a blocked Bloom filter of 256-bit blocks, as many as give each listed URL BITS bits (a power of
two): about one other URL in 500 passes, whatever the list's length.  One block, chosen by the URL's hash, holds
all eight bits of a URL.  A filter of up to MOST_BLOCKS blocks (about 30 MB) is broadcast; beyond, pages meet it in
a salted shuffle by block.  Possible hits go to an exact join with the list, which removes false positives; all
other rows never meet the list.

Repeated pages are judged apart.  An empty list blocks nothing.  Null entries of the list are skipped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import few, salted_join

BITS = 20
MOST_BLOCKS = 1 << 18
#: Most listed URLs that are broadcast to the exact join (about 150 bytes each).
MOST_LISTED = 200_000
WORDS = 4
PER_WORD = 2

#: Canonical form: no query parameters of these names (a prefix ends in "*").
TRACKING = "utm_[^=&#]*|ref|fbclid|gclid"

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """host, path without "index.html" and a last "/", and the query without tracking parameters; scheme and fragment go.  Null for URLs without a host."""
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?:\A|&)(?:{TRACKING})=[^&]*", ""), r"\A&+|&+\z", "")
    path = F.regexp_replace(path, r"(?:/index\.html?)?/?\z", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    chosen = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ordered]
    return F.coalesce(*[F.when(f, c) for f, c in zip(fits, chosen, strict=True)], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _bits(url: Column, word: int) -> Column:
    """The bits that a URL sets in a word of its block."""
    spread = F.xxhash64(F.lit(word + 1), url)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(spread, 16 * n), F.lit(64)).cast("int")) for n in range(PER_WORD)])


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), url), F.lit(blocks)).cast("int")


def blocks_for(n: int) -> int:
    """How many blocks a list of n URLs takes."""
    return max(16, 1 << math.ceil(math.log2(max(1, n * BITS / 256))))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, b0..: the filter of column "url"; at most blocks rows."""
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), *[_bits(F.col("url"), w).alias(f"b{w}") for w in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """One row a page: id, host, path, canonical_url, rule, verdict, possible (passed the filter), listed."""
    scratch = Scratch(pages.sparkSession, "urls")
    exact = scratch.save(listed.select(F.col(listed.columns[0]).alias("url")).where("url is not null").distinct(), "list")
    blocks = blocks or blocks_for(exact.count())
    held = scratch.save(bloom(exact, blocks), "bloom")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rows = rows.select("id", "host", "path", canonical(F.col("u"), F.col("host"), F.col("path")).alias("canonical_url"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    open_ = F.col("r").isNull() & F.col("canonical_url").isNotNull()
    rows = rows.withColumn("block", F.when(open_, _block(F.col("canonical_url"), blocks)))
    if blocks <= MOST_BLOCKS:
        tested = rows.join(F.broadcast(held), "block", "left")
    else:
        tested = salted_join(rows.where("block is not null"), held, ["block"], "left").unionByName(rows.where("block is null"), allowMissingColumns=True)
    inside = reduce(lambda a, b: a & b, [F.col(f"b{w}").bitwiseAND(_bits(F.col("canonical_url"), w)) == _bits(F.col("canonical_url"), w) for w in range(WORDS)])
    tested = scratch.save(tested.select("id", "host", "path", "canonical_url", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.coalesce(open_ & inside, F.lit(False)).alias("possible")), "tested")
    known, possible = exact.select(F.col("url").alias("canonical_url"), F.lit(True).alias("listed")), tested.where("possible")
    hits = possible.join(F.broadcast(known), "canonical_url", "left") if few(exact, MOST_LISTED) else salted_join(possible, known, ["canonical_url"], "left")
    hits = hits.select(*tested.columns, "listed")
    rest = tested.where("not possible").withColumn("listed", F.lit(None).cast("boolean"))
    out = hits.unionByName(rest).withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "canonical_url", "rule", verdict.alias("verdict"), "possible", "listed")
