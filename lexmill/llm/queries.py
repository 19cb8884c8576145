"""One query for each operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .mixing import places
from .near_dup import near_duplicates
from .ngram_lm import scored
from .quality_model import quality_scores
from .quality_rules import quality
from .tables import remainder, table
from .token_counts import token_counts
from .token_files import token_digests
from .url_filter import canonical, host_of, judge, path_of
from .warc import archived


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(table(spark, sf_dir, "documents"))


def op2_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_HOSTS = ("spam-farm", "cheap-pills")


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of blocked URLs: canonical URLs of the pages on hosts with a label of LISTED_HOSTS."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(canonical(url, host_of(url), path_of(url)).alias("listed_url"), host_of(url).alias("host"))
    return pages.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_HOSTS)))).select("listed_url").distinct()


def op3_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_subword_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder() != 0)
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op9_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_katz_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), train=remainder() != 1)
    return found.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_warc_chunked_records": op2_warc_chunked_records,
    "op3_blocked_bloom_urls": op3_blocked_bloom_urls,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_subword_quality_classifier": op6_subword_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_robust_quality_rules": op8_robust_quality_rules,
    "op9_repair_token_files": op9_repair_token_files,
    "op10_katz_backoff_scores": op10_katz_backoff_scores,
}
