"""Queries that read what the library wrote: persisted indexes, scanned trees, change streams; and the service on top.

An index is built once a session and table folder, in the shared folder, and read by all its queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions import analyzers as an
from lexmill.operators import regexes as rx
from lexmill.operators import tokens as tok
from lexmill.operators.corpus import Corpus, term_table
from lexmill.operators.index import Index
from lexmill.operators.snippets import file_lines
from lexmill.operators.symbols import search_symbols
from lexmill.plans.benchmark import latency_stats, regressions
from lexmill.plans.literals import literal_candidates
from lexmill.queries import BRANCHES, GAPPED, PHRASE, _doc_changes, corpus, made_files, read, symbols, text_files
from lexmill.service import Service
from lexmill.sinks import output
from lexmill.sources.listing import changed, fingerprint, listing, scan, scanned, skip_report, store_of
from lexmill.streaming.changes import watch
from lexmill.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]

#: No file of the test tables is too large.
ANY_SIZE = Config(max_file_size=1 << 40)
SYMBOL_LANGUAGES = ("go", "java", "python")
_HELD: dict[tuple[str, str, str], Index] = {}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files(spark, sf_dir).select("file_path", F.col("file_path").alias("repo_rel_path"), "content")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda language: made_files(spark, sf_dir, language).select(F.col("repo_rel_path").alias("file_path"), "repo_rel_path", "content")
    return one("go").unionByName(one("java")).unionByName(one("python"))


def _built(spark: SparkSession, sf_dir: str, state: str) -> Index:
    index = Index(spark, new_folder(spark, f"index-{state}"))
    if state == "symbols":
        index.build(_sources(spark, sf_dir))
        return index
    index.build(_files(spark, sf_dir))
    if state in ("updated", "compacted"):
        new = _files(spark, sf_dir).withColumn("content", F.concat(F.lit("new "), "content"))
        index.apply(_doc_changes(spark, sf_dir), new, ANY_SIZE)
    if state == "compacted":
        index.compact()
    if state == "streamed":
        _streamed(spark, sf_dir, index)
    return index


def _streamed(spark: SparkSession, sf_dir: str, index: Index) -> None:
    """The changes as a feed of files, each path first with content that a later change replaces."""
    feed = new_folder(spark, "feed")
    changes = _doc_changes(spark, sf_dir).join(_files(spark, sf_dir).select(F.col("file_path").alias("path"), "content"), "path")
    early = changes.select("path", F.lit("index").alias("action"), F.lit(1).cast("long").alias("seq"), F.lit("soon replaced").alias("content"))
    late = changes.select("path", "action", F.lit(2).cast("long").alias("seq"), F.when(F.col("action") == "index", F.concat(F.lit("new "), "content")).alias("content"))
    early.repartition(2).write.json(feed)
    late.repartition(2).write.mode("append").json(feed)  # a file source reads older files first
    watch(spark, feed, index, new_folder(spark, "feed-checkpoint"), ANY_SIZE, once=True, files_per_batch=2).awaitTermination()


def index_of(spark: SparkSession, sf_dir: str, state: str = "base") -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _HELD:
        _HELD[key] = _built(spark, sf_dir, state)
    return _HELD[key]


def _over(run: Callable[[Corpus], DataFrame], state: str = "base") -> Query:
    return lambda s, d: run(index_of(s, d, state).corpus())


def _table(name: str, state: str, *columns: str) -> Query:
    return lambda s, d: index_of(s, d, state).table(name).selectExpr(*columns)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each state of the index: files, segments, whether it is dirty or must be rebuilt."""
    rows = []
    for state in ("base", "updated", "compacted"):
        found = index_of(spark, sf_dir, state).status()
        rows.append((state, found["n_files"], len(found["segments"]), found["dirty"], found["needs_rebuild"], found["bytes"] > 0))
    return spark.createDataFrame(rows, "state string, n_files long, n_segments long, dirty boolean, needs_rebuild boolean, has_bytes boolean")


def life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild of the same files, a dirty mark, a generation aside and a cleaning do."""
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo_rel_path"), F.col("s_name").alias("content"))
    index = Index(spark, new_folder(spark, "life"))
    before = index.generations.needs_rebuild()
    first = index.build(files)
    reused = index.build(files) == first
    aside = index.generations.create()
    index.store.write(f"generations/{aside}/report.json", "{}")
    still, cleaned = index.generations.active() == first, index.generations.clean() == [aside]
    index.generations.mark_dirty()
    dirty = index.generations.needs_rebuild()
    rebuilt = index.build(files) != first and not index.generations.dirty and len(index.store.names("generations")) == 1
    rows = [("needs a build at first", before), ("same files reuse the generation", reused), ("a generation aside is not active", still), ("cleaning removes it", cleaned), ("a dirty mark asks for a rebuild", dirty), ("a rebuild replaces the generation", rebuilt), ("every file is there", index.table("files").count() == files.count())]
    return spark.createDataFrame(rows, "step string, holds boolean")


# A tree of files, one a supplier.

FILE = "concat(folder, 'f', k, ext)"
TREE_FOLDER = "case k % 7 when 0 then '_private/' when 1 then 'src/__tests__/' when 2 then 'src/_util/deep/' when 3 then '.hidden/' when 4 then 'gen/' when 5 then 'sub/' else '' end"
TREE_EXT = "case k % 5 when 0 then '.py' when 1 then '.md' when 2 then '.log' when 3 then '.pdf' else '.skip.txt' end"


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(root)
        for batch in batches:
            for row in batch.to_pylist():
                store.create_dir(f"{at}/{row['path'].rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{at}/{row['path']}") as f:
                    f.write(row["content"].encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return write


def tree_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each supplier, under names that scans are apt to lose, broken PDF files, and ignore rules."""
    key = (spark.sparkContext.applicationId, sf_dir, "tree")
    if key not in _HELD:
        root = new_folder(spark, "tree")
        made = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name").selectExpr("k", "s_name", f"{TREE_FOLDER} as folder", f"{TREE_EXT} as ext")
        content = F.when(F.col("k") % 10 == 0, F.concat("s_name", F.repeat(F.lit(" more"), 100))).otherwise(F.col("s_name"))
        rules = spark.createDataFrame([(".gitignore", "*.skip.txt\n/gen/\n"), ("sub/.gitignore", "!*.skip.txt\n*.md\n")], "path string, content string")
        files = made.select(F.expr(FILE).alias("path"), content.alias("content")).unionByName(rules)
        files.mapInArrow(_writer(root), "path string").count()
        _HELD[key] = root
    return _HELD[key]


#: Files of over 400 bytes are too large here.
TREE_CONFIG = Config(include_pdfs=True, max_file_size=400)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, tree_of(spark, sf_dir), TREE_CONFIG)


def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes between a state without every third file and with other sizes of every fifth, and the tree."""
    root = tree_of(spark, sf_dir)
    k = F.regexp_extract("repo_rel_path", r"f(\d+)", 1).cast("long")
    known = scan(spark, root, TREE_CONFIG).where(k % 3 != 0).select("repo_rel_path", F.when(k % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified")
    gone = read(spark, sf_dir, "nation").select(F.concat(F.lit("gone"), F.monotonically_increasing_id().cast("string")).alias("repo_rel_path"), F.lit(1).cast("long").alias("size"), F.current_timestamp().alias("modified"))
    return changed(listing(spark, root, TREE_CONFIG), known.unionByName(gone.limit(1)), root)


def same_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, and whether the signature stays the same in another order and partitioning and changes with a file, whichever files there are."""
    files = text_files(spark, sf_dir).select("file_path", F.octet_length("content").alias("size"))
    more = files.unionByName(spark.createDataFrame([("one/more.txt", 1)], "file_path string, size int"))
    one = fingerprint(files).select("n_files", F.col("signature").alias("a"))
    two = fingerprint(files.repartition(5, "size")).select(F.col("signature").alias("b"))
    other = fingerprint(more).select(F.col("signature").alias("c"))
    return one.join(two).join(other).select("n_files", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("changes_with_a_file"))


# The service and what is planned before a search.

COUNTED = ("the", "ent%", "%tion", "%ati%", "the of")


def dispatched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = Service(index_of(spark, sf_dir))
    return spark.createDataFrame([(p, service.token_count(p)) for p in COUNTED], "pattern string, n long")


def resolved_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results a limit gives: the default, a number, and 0 for all."""
    service = Service(index_of(spark, sf_dir), Config(default_limit=7))
    rows = [(name, len(service.token_rows("the", limit)), len(service.regex_files("the", limit))) for name, limit in (("default", None), ("five", 5), ("all", 0))]
    return spark.createDataFrame(rows, "case string, tokens long, files long")


def symbol_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_symbols(symbols(spark, sf_dir), "kind:class", 15).collect()
    lines = output.symbol_lines([r.asDict() for r in found], "kind:class")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_number int, line string")


def _literal_files(pattern: str) -> Query:
    return lambda s, d: corpus(s, d).files.where(rx.holds(F.col("content"), literal_candidates(pattern))).select("file_path")


def _timed(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_id") % 2 == rest).select(F.col("event_type").alias("query"), F.col("value").alias("ms"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def byte_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line in which the first "the " of each document begins, by its byte offset."""
    at = F.instr("text", "the ")
    offset = F.octet_length(F.substring(F.col("text"), F.lit(1), at - 1))
    return read(spark, sf_dir, "documents").where(at > 0).select("doc_id", an.byte_line(F.col("text"), offset).alias("line"))


def clean_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, brand = F.col("p_partkey"), F.regexp_replace("p_brand", "#", "")
    made = F.when(key % 4 == 0, F.concat(F.lit("&mut "), brand, F.lit("<"), "p_type", F.lit(">"))).when(key % 4 == 1, F.concat(F.lit("*"), brand)).when(key % 4 == 2, F.concat(brand, F.lit("[K, V]"))).otherwise(brand)
    return read(spark, sf_dir, "part").select("p_partkey", an.clean_type(made).alias("name"))


REGEX, PHRASES, POSIX = r"the thor\w+", "(of|in) the", "[[:upper:]][[:digit:]]|[[:punct:]]{2}"

QUERIES: dict[str, Query] = {
    "pidx_exact": _over(lambda c: tok.search(c, "the")),
    "pidx_prefix": _over(lambda c: tok.search(c, "ent%")),
    "pidx_suffix": _over(lambda c: tok.search(c, "%tion")),
    "pidx_substring": _over(lambda c: tok.search(c, "%ati%")),
    "pidx_multi_and": _over(lambda c: tok.search(c, "the of and")),
    "pidx_multi_substring": _over(lambda c: tok.all_substrings(c, ["tio", "ing"])),
    "pidx_phrase": _over(lambda c: tok.phrase(c, PHRASE)),
    "pidx_phrase_gap": _over(lambda c: tok.phrase(c, GAPPED)),
    "pidx_any_branch": _over(lambda c: tok.any_branch(c, BRANCHES)),
    "pidx_rank": _over(lambda c: tok.search_ranked(c, "the of", 20)),
    "pidx_rank_phrase": _over(lambda c: tok.phrase_ranked(c, PHRASE, 20)),
    "pidx_regex": _over(lambda c: rx.matching_files(c, REGEX)),
    "pidx_regex_lines": _over(lambda c: rx.matching_lines(c, "^The .*tion")),
    "pidx_terms": _over(lambda c: term_table(c.postings)),
    "pidx_stored_terms": lambda s, d: index_of(s, d).terms(),
    "pidx_lengths": _table("lengths", "base", "file_path", "dl"),
    "pidx_files": _table("files", "base", "file_path", "md5(content) as content_md5"),
    "pidx_stats": _over(tok.index_stats),
    "pidx_upd_files": _table("files", "updated", "file_path", "md5(content) as content_md5"),
    "pidx_upd_exact": _over(lambda c: tok.search(c, "new"), "updated"),
    "pidx_upd_suffix": _over(lambda c: tok.search(c, "%tion"), "updated"),
    "pidx_upd_terms": _over(lambda c: term_table(c.postings), "updated"),
    "pidx_cmp_files": _table("files", "compacted", "file_path", "md5(content) as content_md5"),
    "pidx_cmp_terms": lambda s, d: index_of(s, d, "compacted").terms(),
    "pidx_status": status,
    "pidx_life_cycle": life_cycle,
    "pidx_symbols": lambda s, d: index_of(s, d, "symbols").symbols().select("repo_rel_path", "kind", "name", "container_name", "visibility", "language"),
    "pidx_symbol_search": lambda s, d: search_symbols(index_of(s, d, "symbols").symbols(), "kind:method lang:java visitors").select("repo_rel_path", "name", "container_name"),
    "stream_applied_files": _table("files", "streamed", "file_path", "md5(content) as content_md5"),
    "stream_events": lambda s, d: s.read.parquet(index_of(s, d, "streamed").store.path("events")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("event").alias("event")).select("path", F.lit(True).alias("told")),
    "src_scan": lambda s, d: _scanned(s, d).select("repo_rel_path", "size", F.md5("content").alias("content_md5"), "reason"),
    "src_scan_skips": lambda s, d: skip_report(_scanned(s, d), samples=3).select("reason", "n", F.array_join("samples", ",").alias("samples")),
    "src_tree_changes": tree_changes,
    "src_fingerprint": same_fingerprint,
    "cnt_dispatch": dispatched_counts,
    "top_limits": resolved_limits,
    "out_symbol_text": symbol_text,
    "rx_literal_files": _literal_files(r"(idiot|moron)s? \w+|clown"),
    "rx_token_files": lambda s, d: rx.candidates(corpus(s, d), REGEX),
    "rx_phrase_files": lambda s, d: rx.phrase_candidates(corpus(s, d), PHRASES),
    "rx_posix": lambda s, d: file_lines(rx.narrowed(corpus(s, d), POSIX)).where(F.col("line_content").rlike(rx.jvm_pattern(POSIX))).select("file_path", "line_number"),
    "bench_latency": lambda s, d: _rounded(latency_stats(_timed(s, d, 0))),
    "bench_regressions": lambda s, d: _rounded(regressions(latency_stats(_timed(s, d, 0)), latency_stats(_timed(s, d, 1)), 1.02, 1.0).select("query", "p50", "base_p50", "ratio", "status")),
    "an_byte_line": byte_lines,
    "an_clean_type": clean_types,
}
