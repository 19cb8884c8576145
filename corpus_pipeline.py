"""From raw documents to token files: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import stages
from lexmill.llm.scratch import Scratch
from lexmill.llm.tables import table

STAGES = [
    ("quality rules", stages.quality_rules),
    ("MinHash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("mixing sources to target weights", stages.mixing),
    ("token-ID output", stages.token_output),
]

#: Robust estimates, sketches and tokenizers are beyond SQL; a brute-force version checks the rows in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens, ids_crc32 and n_symbols of each document kept."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
