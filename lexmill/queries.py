"""Queries over the test tables, one or more for each operator.

The text corpus is the documents table, a file each; the symbol corpus is made from the part table; the change
feed is the events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions import analyzers as an
from lexmill.functions.globs import glob_matches
from lexmill.operators import regexes as rx
from lexmill.operators import tokens as tok
from lexmill.operators import updates as upd
from lexmill.operators.corpus import Corpus, file_terms, postings_table, term_table
from lexmill.operators.snippets import file_lines, groups, snippets, windows
from lexmill.operators.symbols import distinct_files, search_symbols
from lexmill.plans.benchmark import planted_corpus
from lexmill.plans.made_sources import EXTENSION, source_column
from lexmill.plans.patterns import KINDS, LANGUAGES, SymbolQuery
from lexmill.sinks import output
from lexmill.sources.extract import symbols_of
from lexmill.sources.listing import indexable, skip_report
from lexmill.streaming.changes import latest_from_stream

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(path.alias("file_path"), F.col("text").alias("content"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(text_files(spark, sf_dir).select("file_path", "content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    one_of = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    key = F.col("p_partkey")
    second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    name = F.concat(words[0], F.upper(F.substring(second, 1, 1)), F.substring(second, 2, 1 << 20))
    container = F.when(key % 3 != 0, F.regexp_replace("p_brand", "#", ""))
    line = (key % 200 + 1).cast("int")
    return read(spark, sf_dir, "part").select(
        one_of(KINDS, F.col("p_size")).alias("kind"), name.alias("name"), F.concat(container, F.lit("::"), name).alias("qualified_name"),
        one_of(LANGUAGES, key).alias("language"), F.concat(F.lit("pkg/"), F.lower("p_type"), F.lit("/f"), (key % 50).cast("string"), F.lit(".go")).alias("repo_rel_path"),
        container.alias("container_name"), F.lit(None).cast("string").alias("visibility"), F.concat(F.lit("fn "), name, F.lit("(size: "), F.col("p_size").cast("string"), F.lit(")")).alias("signature"),
        line.alias("line_start"), line.alias("line_end"), F.lit(0).cast("long").alias("byte_start"), F.length(name).cast("long").alias("byte_end"), F.lit(None).cast("string").alias("doc"),
    )


SYMBOL_COLUMNS = ["kind", "name", "qualified_name", "language", "repo_rel_path", "container_name", "signature", "line_start"]


def _symbols(query: str, **more) -> Query:
    return lambda s, d: search_symbols(symbols(s, d), query, **more).select(*SYMBOL_COLUMNS)


def _refined(query: str, pattern: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = symbols(spark, sf_dir)
        body = F.concat(F.lit("size "), (F.col("line") * 7 % 50).cast("string"))
        files = found.select("repo_rel_path").distinct().withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(200)))).groupBy("repo_rel_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", body.alias("b")))), lambda x: x["b"]), "\n").alias("content"))
        return search_symbols(found, query, refine=pattern, files=files).select(*SYMBOL_COLUMNS)

    return run


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change_rows(read(spark, sf_dir, "events"))


def _change_rows(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "error", F.lit("remove")).otherwise(F.lit("index"))
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), action.alias("action"), "ts", "event_id")


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("create", "modify_data", "metadata", "rename_from", "remove", "rename_to")))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    renamed = F.when(F.col("event_id") % 10 == 0, F.concat(path, F.lit(".new")))
    return read(spark, sf_dir, "events").select(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"), path.alias("path"), renamed.alias("new_path"), F.col("event_id").alias("seq"))


def _doc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh file goes; every seventh gets new content."""
    files = text_files(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 11 == 0, F.lit("remove")).when(F.col("doc_id") % 7 == 0, F.lit("index"))
    return files.select(F.col("file_path").alias("path"), kind.alias("action")).where("action is not null")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = text_files(spark, sf_dir)
    new = files.select("file_path", F.concat(F.lit("new "), "content").alias("content"))
    return upd.upserted(files.select("file_path", "content"), new, _doc_changes(spark, sf_dir)).select("file_path", F.md5("content").alias("content_md5"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_lines(corpus(spark, sf_dir).files).withColumn("is_match", F.col("line_content").rlike("(?mdU)the thor"))


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    extensions = F.array(*map(F.lit, ("rs", "TXT", "pdf", "log", "py", "")))
    ext = F.element_at(extensions, (F.col("page_id") % 6 + 1).cast("int"))
    hidden = F.when(F.col("page_id") % 5 == 0, F.lit(".git/")).otherwise(F.lit(""))
    path = F.concat(F.lit("src/"), hidden, F.lit("p"), F.col("page_id").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").alias("size"))


def _exploded(tokens: Callable, table: str, key: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = read(spark, sf_dir, table).select(key, F.explode(tokens(F.col(text))).alias("token"))
        return made.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))

    return run


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "documents").select("doc_id", F.explode(an.token_positions(F.col("text"))).alias("x"))
    return made.select("doc_id", "x.token", F.col("x.pos").cast("long").alias("pos"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_terms(corpus(spark, sf_dir).files)


def _indexed(run: Callable[[Corpus], DataFrame]) -> Query:
    return lambda s, d: run(corpus(s, d).with_postings())


def _scanned(run: Callable[[Corpus], DataFrame]) -> Query:
    return lambda s, d: run(corpus(s, d))


def _count(run: Callable[[Corpus], DataFrame]) -> Query:
    return lambda s, d: tok.count(run(corpus(s, d)))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upd_latest_wins as a stream over the events files."""
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    return latest_from_stream(_change_rows(stream), "ts", "event_id").select("path", "action", "event_id")


def made_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """A source file for each row of the part table."""
    first, key = F.split("p_name", " ")[0], F.col("p_partkey")
    type_name, word = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 20), key.cast("string")), F.concat(F.lower(first), key.cast("string"))
    path = F.concat(F.lit(f"src/{language}/f"), key.cast("string"), F.lit(f".{EXTENSION[language]}"))
    return read(spark, sf_dir, "part").select(path.alias("repo_rel_path"), source_column(language, key, type_name, word).alias("content"))


def _extracted(language: str) -> Query:
    return lambda s, d: symbols_of(made_files(s, d, language)).select("repo_rel_path", "kind", "name", "container_name", "visibility", "language")


PHRASE = [(0, "of"), (1, "the")]
GAPPED = [(0, "the"), (2, "of")]
BRANCHES = [["the", "of"], ["de", "la"], []]

QUERIES: dict[str, Query] = {
    "tok_exact": _scanned(lambda c: tok.search(c, "The")),
    "tok_prefix": _scanned(lambda c: tok.search(c, "ent%")),
    "tok_suffix": _scanned(lambda c: tok.search(c, "%tion")),
    "tok_substring": _scanned(lambda c: tok.search(c, "%ati%")),
    "tok_multi_and": _scanned(lambda c: tok.search(c, "the of% and")),
    "tok_multi_substring": _scanned(lambda c: tok.all_substrings(c, ["tio", "ing"])),
    "tok_phrase": _scanned(lambda c: tok.phrase(c, PHRASE)),
    "tok_phrase_gap": _scanned(lambda c: tok.phrase(c, GAPPED)),
    "tok_empty": _scanned(lambda c: tok.search(c, "%%")),
    "idx_exact": _indexed(lambda c: tok.search(c, "the")),
    "idx_prefix": _indexed(lambda c: tok.search(c, "ent%")),
    "idx_suffix": _indexed(lambda c: tok.search(c, "%tion")),
    "idx_substring": _indexed(lambda c: tok.search(c, "%ati%")),
    "idx_multi_and": _indexed(lambda c: tok.search(c, "the of and")),
    "idx_multi_substring": _indexed(lambda c: tok.all_substrings(c, ["tio", "ing"])),
    "idx_phrase": _indexed(lambda c: tok.phrase(c, PHRASE)),
    "cnt_exact": _count(lambda c: tok.exact(c, "the")),
    "cnt_prefix": _count(lambda c: tok.prefix(c, "ent")),
    "cnt_suffix": _count(lambda c: tok.suffix(c, "tion")),
    "cnt_substring": _count(lambda c: tok.substring(c, "ati")),
    "cnt_multi_term": _count(lambda c: tok.all_terms(c, ["the", "of"])),
    "cnt_multi_substring": _count(lambda c: tok.all_substrings(c, ["tio", "ing"])),
    "cnt_any_branch": _count(lambda c: tok.any_branch(c, BRANCHES)),
    "cnt_phrase": _count(lambda c: tok.phrase(c, PHRASE)),
    "cnt_min_branch": lambda s, d: tok.least([tok.count(tok.all_terms(corpus(s, d), b)) for b in BRANCHES if b]),
    "cnt_files": _count(lambda c: c.files),
    "stats_index": _indexed(tok.index_stats),
    "stats_terms": term_stats,
    "idx_terms": lambda s, d: term_table(postings_table(corpus(s, d).files)),
    "rank_bm25_term": _scanned(lambda c: tok.search_ranked(c, "the", 20)),
    "rank_bm25_multi": _scanned(lambda c: tok.search_ranked(c, "the of", 20)),
    "rank_bm25_indexed": _indexed(lambda c: tok.search_ranked(c, "the of", 20)),
    "rank_phrase": _scanned(lambda c: tok.phrase_ranked(c, PHRASE, 20)),
    "rank_prefix_const": _scanned(lambda c: tok.search_ranked(c, "ent%", 20)),
    "rank_multi_substring": _scanned(lambda c: tok.substrings_ranked(c, ["tio", "ing"], 20)),
    "rank_list_all": _scanned(lambda c: tok.list_all(c, 20)),
    "rank_glob": _scanned(lambda c: tok.search_ranked(c, "the", 10, glob="src1/*.txt")),
    "src_stored_text": lambda s, d: tok.stored_text(corpus(s, d), "src1/en/1.txt").select(F.md5("content").alias("content_md5")),
    "set_or_of_ands": _scanned(lambda c: tok.any_branch(c, BRANCHES)),
    "set_intersect": _scanned(lambda c: tok.prefix(c, "ent").intersect(tok.suffix(c, "tion"))),
    "set_except": lambda s, d: upd.without(corpus(s, d).files.select("file_path"), tok.exact(corpus(s, d), "the")),
    "rx_lines": _scanned(lambda c: rx.matching_lines(c, "^The .*tion")),
    "rx_files": _scanned(lambda c: rx.matching_files(c, r"the thor\w+")),
    "rx_prefiltered": _indexed(lambda c: rx.matching_files(c, r"the thor\w+", use_index=True)),
    "rx_count": _scanned(lambda c: rx.count_files(c, r"tion[,.] (The|And)")),
    "rx_ignore_case": _scanned(lambda c: rx.matching_files(c, "THE THOR", ignore_case=True)),
    "rx_alternation": _scanned(lambda c: rx.matching_files(c, "idiot|moron|clown")),
    "rx_multiline_dot": _scanned(lambda c: rx.matching_files(c, r"tion\.\nThe", multiline=True)),
    "rx_multiline_lines": _scanned(lambda c: rx.matching_lines(c, r"tion\.\nThe", multiline=True)),
    "rx_bounded": _scanned(lambda c: rx.matching_files(c, "the", limit=20)),
    "snip_context": lambda s, d: groups(snippets(corpus(s, d).files, "thor%", 1, 2)),
    "snip_regex": lambda s, d: rx.regex_snippets(corpus(s, d), "the thor", 2, 0),
    "snip_asymmetric": lambda s, d: groups(windows(_marked(s, d), 0, 3)),
    "sym_kind": _symbols("kind:struct"),
    "sym_kind_fn": _symbols("kind:fn"),
    "sym_lang": _symbols("lang:rs"),
    "sym_path": _symbols("path:PKG/economy"),
    "sym_name_exact": _symbols("kind:fn RedWidget"),
    "sym_name_prefix": _symbols("kind:fn red%"),
    "sym_name_suffix": _symbols("lang:go %bolt"),
    "sym_name_substring": _symbols("lang:py %dbo%"),
    "sym_name_parts": _symbols("path:pkg/ red widget"),
    "sym_qname_exact": _symbols("qname:brand2::SmallRing"),
    "sym_qname_prefix": _symbols("qname:Brand1%"),
    "sym_qname_suffix": _symbols("qname:%::RedWidget"),
    "sym_qname_substring": _symbols("qname:%2::s%"),
    "sym_qname_parts": lambda s, d: search_symbols(symbols(s, d), SymbolQuery(qualified_name="brand gear")).select(*SYMBOL_COLUMNS),
    "sym_combined": _symbols("kind:fn lang:go path:PKG/s %bol%"),
    "sym_topk": _symbols("kind:class", limit=15),
    "sym_glob": _symbols("kind:fn", glob="pkg/*/f1*.go"),
    "sym_regex_refine": _refined("kind:fn", r"size(: [12]$|:? 4)"),
    "sym_files": lambda s, d: distinct_files(search_symbols(symbols(s, d), "kind:enum")),
    "an_body_tokens": _exploded(an.body_tokens, "documents", "doc_id", "text"),
    "an_reversed": _exploded(an.reversed_tokens, "documents", "doc_id", "text"),
    "an_positions": positions,
    "an_ident_parts": lambda s, d: symbols(s, d).select("name", F.explode(an.identifier_parts(F.col("name"))).alias("part")).distinct(),
    "an_qname_parts": lambda s, d: symbols(s, d).select("qualified_name", F.explode(an.identifier_parts(F.col("qualified_name"))).alias("part")).distinct(),
    "src_ext_filter": lambda s, d: _page_paths(s, d).where(indexable(F.col("path"), hidden=True)).select("page_id", "path"),
    "src_hidden_filter": lambda s, d: _page_paths(s, d).where(indexable(F.col("path"))).select("page_id", "path"),
    "src_size_limit": lambda s, d: _page_paths(s, d).where(F.col("size") <= 4096).select("page_id"),
    "src_skip_report": lambda s, d: skip_report(_page_paths(s, d).select("path", "size"), Config(max_file_size=4096)).select("reason", "n", F.array_join("samples", ",").alias("samples")),
    "src_lines": lambda s, d: file_lines(text_files(s, d)).select("file_path", "line_number", F.md5("line_content").alias("line_md5")),
    "src_glob": lambda s, d: text_files(s, d).where(glob_matches(F.col("file_path"), "src[12]/**/1??.txt")).select("file_path"),
    "src_extension": lambda s, d: _page_paths(s, d).groupBy(an.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n")),
    "out_json": lambda s, d: output.json_rows(rx.matching_lines(corpus(s, d), "the thor")),
    "out_envelope": lambda s, d: output.json_envelope(tok.search_ranked(corpus(s, d), "the", 20).select("file_path"), "the", "token"),
    "out_plain": lambda s, d: output.plain_lines(rx.regex_snippets(corpus(s, d), "the thor", 1, 1)),
    "upd_latest_wins": lambda s, d: upd.latest(_changes(s, d), "ts", "event_id").select("path", "action", "event_id"),
    "stream_latest_wins": stream_latest,
    "upd_event_actions": lambda s, d: _file_events(s, d).select("seq", "path", upd.action_of(F.col("kind")).alias("action")),
    "upd_rename_pair": lambda s, d: upd.latest(upd.rename_pairs(_file_events(s, d)), "seq", "action"),
    "upd_vanished": lambda s, d: upd.vanished_to_remove(upd.latest(_changes(s, d), "ts", "event_id").select("path", "action"), _changes(s, d).where("event_id % 2 = 0").select("path")),
    "upd_delete": lambda s, d: upd.without(text_files(s, d).select("file_path"), _doc_changes(s, d).where("action = 'remove'").select("path")),
    "upd_upsert": upsert,
    "bench_corpus_planted": lambda s, d: file_lines(planted_corpus(s)).groupBy(F.regexp_extract("line_content", "fn (initialize_connection|connect_database|handle_request)", 1).alias("planted")).agg(F.countDistinct("file_path").alias("n")).where("planted <> ''"),
    "bench_corpus_query": lambda s, d: tok.search(Corpus(planted_corpus(s)), "%request%"),
}
QUERIES |= {f"extract_symbols_{language}": _extracted(language) for language in EXTENSION}
