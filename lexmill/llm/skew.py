"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of one key in a shuffled join; the keys above it, or above a ten-thousandth of all rows, are at most 10 000 and are broadcast.
HOT_ROWS = 100_000
SALTS = 16


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with a written table of one row a key; its column count says how many rows have the key.

    Keys of many rows are joined by broadcast, so no key's rows meet in one task."""
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_ROWS, (total or 0) // 10_000)
    if (most or 0) <= limit:
        return rows.join(table, keys)
    hot = table.where(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(count) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).select(*rest.columns).unionByName(rest)


def few(table: DataFrame, most: int) -> bool:
    """True if a written table has few enough rows to be broadcast."""
    return table.limit(most + 1).count() <= most


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join of rows with a table of one row a key, in which each key's rows are dealt over SALTS tasks."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")
