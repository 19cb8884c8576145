"""Token, phrase and regex searches, over files and over postings."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.dialect import py_pattern
from lexmill.operators import regexes as rx
from lexmill.operators import tokens as tok
from lexmill.operators.corpus import Corpus
from lexmill.operators.snippets import groups, snippets
from lexmill.plans.benchmark import latency_stats, planted_corpus, regressions


def corpus_of(spark, files, indexed=False):
    made = Corpus(spark.createDataFrame(sorted(files.items()), "file_path string, content string"))
    return made.with_postings() if indexed else made


def paths(df):
    return sorted(r["file_path"] for r in df.collect())


CASES = [
    ({"a.rs": "fn connect() {}", "b.rs": "fn connect() {}"}, "connect", ["a.rs", "b.rs"]),
    ({"a.rs": "initialize initialization final"}, "init%", ["a.rs"]),
    ({"a.rs": "initialize initialization final"}, "%init%", ["a.rs"]),
    ({"a.rs": "hello jello world"}, "%llo", ["a.rs"]),
    ({"a.rs": "cat concatenate locate"}, "%at%", ["a.rs"]),
    ({"a.rs": "HelloWorld HELLOWORLD helloworld"}, "helloworld", ["a.rs"]),
    ({"a.rs": "fn validate authorization", "b.rs": "fn validate only"}, "authorization validate", ["a.rs"]),
    ({"a.go": "func Run() { }"}, "HollowKubelet Run", []),
    ({"a.go": "func Validate() error { }"}, "Validate()", ["a.go"]),
    ({"a.rs": "use std::io::Read;"}, "std::io", ["a.rs"]),
    ({"a.css": "my-variable: red;"}, "my-variable", ["a.css"]),
    ({"a.rs": "fn hello_run() { }"}, "%::run", ["a.rs"]),
    ({"a.rs": "fn hello() { }"}, "%%", []),
    ({"a.rs": "fn hello() { }"}, "%a%", []),
]


@pytest.mark.parametrize("indexed", [False, True])
def test_patterns(spark, indexed):
    for files, pattern, expected in CASES:
        corpus = corpus_of(spark, files, indexed)
        assert paths(tok.search(corpus, pattern)) == expected, pattern
        assert tok.count(tok.search(corpus, pattern)).first()["n"] == len(expected)


@pytest.mark.parametrize("indexed", [False, True])
def test_phrases(spark, indexed):
    corpus = corpus_of(spark, {"/a.rs": "context.Context context", "/b.rs": "context other Context", "/c.rs": "foo a bar"}, indexed)
    assert {r["file_path"]: r["hits"] for r in tok.phrase(corpus, [(0, "context"), (1, "context")]).collect()} == {"/a.rs": 2}
    assert paths(tok.phrase(corpus, [(0, "foo"), (2, "bar")])) == ["/c.rs"]
    with pytest.raises(ValueError):
        tok.phrase(corpus, [(0, "foo")])


@pytest.mark.parametrize("indexed", [False, True])
def test_ranking(spark, indexed):
    files = {f"f{i}": "hello " * i + "world" for i in range(1, 4)} | {"x": "other", "empty": ""}
    corpus = corpus_of(spark, files, indexed)
    assert [r["file_path"] for r in tok.bm25(corpus, ["hello"], 2).collect()] == ["f3", "f2"]
    assert tok.bm25(corpus, ["hello", "world"]).count() == 3
    assert tok.bm25(corpus, ["hello", "nowhere"]).count() == 0
    assert [r["file_path"] for r in tok.search_ranked(corpus, "hel%", 2).collect()] == ["f1", "f2"]
    assert [r["file_path"] for r in tok.search_ranked(corpus, "hello", 0, "f[12]").collect()] == ["f2", "f1"]
    assert paths(tok.any_branch(corpus, [["hello", "world"], ["other"], []])) == ["f1", "f2", "f3", "x"]
    assert tok.any_branch(corpus, [[]]).count() == 0


def test_index_stats(spark):
    row = tok.index_stats(corpus_of(spark, {"a": "one two two", "b": "two"})).first()
    assert (row["n_files"], row["n_terms"], row["n_postings"]) == (2, 2, 3)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.text(alphabet="ab c_D", max_size=15), min_size=1), st.text(alphabet="ab%_ cD", min_size=1, max_size=5))
def test_index_equals_scan(spark, files, pattern):
    assert paths(tok.search(corpus_of(spark, files), pattern)) == paths(tok.search(corpus_of(spark, files, True), pattern))


REGEX = [
    ("line one\nfn hello_world() {}\nline three\n", "hello_world", [(2, "fn hello_world() {}")]),
    ("TODO: fix\nclean\nTODO: also\n", "TODO", [(1, "TODO: fix"), (3, "TODO: also")]),
    ("hit\r\nmiss\r\n", "hit$", [(1, "hit")]),
]


def test_regex_lines(spark):
    for content, pattern, expected in REGEX:
        corpus = corpus_of(spark, {"a": content})
        assert [(r["line_number"], r["line_content"]) for r in rx.matching_lines(corpus, pattern).orderBy("line_number").collect()] == expected
    corpus = corpus_of(spark, {"a": "start\nmatch across\nlines end\nafter\n"})
    assert [r["line_number"] for r in rx.matching_lines(corpus, "match across\nlines", multiline=True).orderBy("line_number").collect()] == [2, 3]
    assert rx.matching_files(corpus, "match across\nlines").count() == 0
    assert rx.matching_files(corpus, "across.*end", multiline=True).count() == 1


def test_spanned_lines():
    assert rx.spanned_lines("a\nb\n", py_pattern("b\n", dot_all=True)) == [(2, "b")]
    assert rx.spanned_lines("", py_pattern("^", dot_all=True)) == [(1, "")]


def test_regex_context(spark):
    corpus = corpus_of(spark, {"a": REGEX[0][0]})
    row = rx.nested_snippets(rx.regex_snippets(corpus, "hello_world", 1, 1)).first()
    assert [(x["line_number"], x["is_match"]) for x in row["snippets"][0]] == [(1, False), (2, True), (3, False)]
    assert [x["line_number"] for x in row["matches"]] == [2]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab\nT", max_size=12), min_size=1, max_size=4), st.sampled_from(["ab", "a.b", "T|bb", "^a", "b$", "(ab)+", "a+T?"]))
def test_narrowing_keeps_the_answer(spark, texts, pattern):
    corpus = corpus_of(spark, {f"f{i}": t for i, t in enumerate(texts)}, True)
    compiled = py_pattern(pattern)
    expected = sorted(f"f{i}" for i, t in enumerate(texts) if any(compiled.search(x) for x in t.split("\n")))
    assert paths(rx.matching_files(corpus, pattern, use_index=True)) == expected
    assert paths(rx.matching_files(corpus, pattern)) == expected
    assert paths(rx.matching_files(corpus, pattern, use_index=False)) == expected


def test_snippets(spark):
    corpus = corpus_of(spark, {"a": "line1\nfn match_a() {}\nfn match_b() {}\nline4\nline5\n"})
    assert [tuple(r)[1:] for r in groups(snippets(corpus.files, "%match_%", 1, 1)).collect()] == [(1, 1, 4, 2)]
    far = corpus_of(spark, {"a": "fn match_one() {}\n" + "x\n" * 5 + "fn match_two() {}\n"})
    assert groups(snippets(far.files, "%match_%", 0, 0)).count() == 2
    touching = corpus_of(spark, {"a": "match\nx\ny\nmatch\n"})
    assert groups(snippets(touching.files, "match", 1, 1)).count() == 1


def test_planted_corpus(spark):
    corpus = Corpus(planted_corpus(spark).cache())
    for pattern in ("handle_request", "handle%", "%request%"):
        assert tok.search(corpus, pattern).count() == 200
    assert tok.search(corpus, "initialize_connection").count() == 100
    assert tok.search(corpus, "connect_database").count() == 50


def test_benchmark_gate(spark):
    runs = spark.createDataFrame([("q", float(x)) for x in range(1, 102)], "query string, ms double")
    stats = latency_stats(runs)
    row = stats.first()
    assert (row["p50"], row["p95"]) == (51.0, 96.0)
    base = stats.withColumn("p50", F.lit(20.0))
    assert regressions(stats, base).first()["status"] == "fail"
    assert regressions(stats, stats).first()["status"] == "ok"
