"""The operators as steps over a documents table that keep its columns.

A step's scratch tables go when the next step begins: write a step's result before, as the pipeline does.  The
last step's stay, as its result may be read at any time.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import without_benchmark
from .mixing import mixed
from .near_dup import near_duplicates
from .quality_rules import passing
from .scratch import stage
from .tables import table
from .token_files import token_digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    with stage(spark):
        return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of linked texts.  Rows that repeat a doc_id and its text are one row, that whose columns come first as JSON; a doc_id's other texts stay unless they are linked.  Rows without a doc_id stay."""
    with stage(spark):
        found = near_duplicates(docs)
    keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")]
    gone = found.where("doc_id is not null and not stays").select(*keys).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), whole.alias("_row"))
    left = rows.join(gone, ["_id", "_th"], "left_anti")
    again = found.where("doc_id is not null and stays").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return left.select("_row.*")
    once = left.join(again, ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return left.join(again, ["_id", "_th"], "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    with stage(spark):
        return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    with stage(spark):
        return mixed(docs)


def in_file_order(docs: DataFrame) -> list:
    """Columns that sort a table read from files as it was written; none for other tables."""
    if not docs.inputFiles():
        return []
    return [F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix (the order of docs' files; of doc_id if docs has no files), and what they hold of each document."""
    with stage(spark):
        pass
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), order=in_file_order(docs) or None)
