"""Shared column rules of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the key as text, modulo by; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(by)).cast("int")


def fits(df: DataFrame, max_bytes: int, *size_of: Column) -> bool:
    """True if the given byte sizes, summed over the whole table, are at most max_bytes."""
    total = df.select(F.sum(sum(size_of, F.lit(0)).cast("long")).alias("n")).first()["n"]
    return (total or 0) <= max_bytes
