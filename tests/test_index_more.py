"""Written indexes: recovery, events, compaction beside a stream, feeds made from a tree."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lexmill.operators import tokens as tok
from lexmill.operators.corpus import Corpus, lengths_table, postings_table
from lexmill.operators.index import Index
from lexmill.plans.planner import prefer_scan
from lexmill.plans.literals import token_candidates
from lexmill.sources.listing import scan
from lexmill.streaming.changes import apply_batch, stop_when_idle, watch, write_feed

from .test_index import feed_df, files_df, hits, write


def test_postings_of_awkward_files(spark):
    """Grouped in one pass: positions count short runs, null and empty files have none, columns are those of the contract."""
    files = spark.createDataFrame([("a", "the cat x the Dog"), ("b", None), ("c", ""), ("d", "x y z"), ("e", "dog " * 3000)], "file_path string, content string").repartition(2)
    got = {(r["file_path"], r["token"]): (r["tf"], r["positions"]) for r in postings_table(files).collect()}
    assert {k: v for k, v in got.items() if k[0] != "e"} == {("a", "the"): (2, [0, 3]), ("a", "cat"): (1, [1]), ("a", "dog"): (1, [4])}
    assert got["e", "dog"] == (3000, list(range(3000)))
    assert {r["file_path"]: r["dl"] for r in lengths_table(files).collect()}.items() >= {"a": 4, "c": 0, "d": 0, "e": 3000}.items()
    assert postings_table(files.limit(0)).collect() == []


def test_suffixes_read_their_own_copy(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(files_df(spark, {f"f{i}": f"nation{i}x station word{i}ing" for i in range(20)}))
    found = tok.suffix(index.corpus(), "tion")
    assert found.inputFiles() and all("/reversed/" in f for f in found.inputFiles())
    assert "StringStartsWith(token_rev" in found._jdf.queryExecution().executedPlan().toString()
    assert len(hits(index, "%ation")) == 20 and hits(index, "%7ing") == ["f17", "f7"]


def test_planner_uses_stored_frequencies(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(files_df(spark, {f"f{i}": "common words" + (" rarest" if i == 3 else "") for i in range(40)}))
    corpus = index.corpus()
    assert corpus.n_files == 40 and prefer_scan(corpus, token_candidates("common")) and not prefer_scan(corpus, token_candidates("rarest"))
    assert prefer_scan(Corpus(corpus.files, corpus.postings), token_candidates("rarest"))


def test_a_crash_within_an_update(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"))
    index.build(files_df(spark, {"a": "alpha", "b": "beta"}))
    report = index.store.write

    def fail(name, text):
        if name.endswith("report.json"):
            raise OSError("disk full")
        report(name, text)

    monkeypatch.setattr(index.store, "write", fail)
    seen: list = []
    with pytest.raises(OSError):
        apply_batch(index, feed_df(spark, [("a", "index", 1, "gamma")]), 0, listener=seen.append)
    monkeypatch.undo()
    assert seen == [{"event": "error", "batch": 0, "message": "disk full"}]
    again = Index(spark, index.root)
    assert again.generations.dirty and again.generations.needs_rebuild() and hits(again, "alpha") == ["a"]
    assert len(again.recover()) == 1 and not again.generations.dirty and again.store.names(f"generations/{again.generations.active()}") == ["base", "report.json"]
    apply_batch(again, feed_df(spark, [("a", "index", 1, "gamma")]), 0, listener=seen.append)
    assert hits(again, "gamma") == ["a"] and seen[-1]["indexed"] == 1
    events = spark.read.parquet(again.store.path("events"))
    assert [(r["path"], r["event"], r["batch"]) for r in events.collect()] == [("a", "indexed", 0)]


def test_feed_from_a_tree(spark, tmp_path):
    root, feed = tmp_path / "root", str(tmp_path / "feed")
    write(root, {"a.py": "alpha", "b.py": "beta", "c.py": "gone soon"})
    index = Index(spark, str(tmp_path / "i"))
    index.build(scan(spark, str(root)))
    assert write_feed(index, str(root), feed) == 0
    (root / "c.py").unlink()
    write(root, {"b.py": "better", "new/d.py": "def delta():\n    pass\n"})
    assert write_feed(index, str(root), feed) == 3
    watch(spark, feed, index, str(tmp_path / "cp"), once=True).awaitTermination(120)
    rel = {r["file_path"]: r["repo_rel_path"] for r in index.table("files").collect()}
    assert sorted(rel.values()) == ["a.py", "b.py", "new/d.py"] and all(p.endswith(r) for p, r in rel.items())
    assert hits(index, "better") == [f"{root}/b.py"] and hits(index, "gone") == []
    assert [r["repo_rel_path"] for r in index.symbols().collect()] == ["new/d.py"]


def test_compaction_while_the_stream_goes_on(spark, tmp_path):
    index, feed = Index(spark, str(tmp_path / "i")), tmp_path / "feed"
    index.build(files_df(spark, {"a": "start"}))
    feed.mkdir()
    for i in range(4):
        index.apply(feed_df(spark, [("a", "index", i, "")]).select("path", "action"), files_df(spark, {"a": f"again{i}"}))
    assert index.should_compact()
    query = watch(spark, str(feed), index, str(tmp_path / "cp"))
    follower = threading.Thread(target=stop_when_idle, args=(query, 25, 0.2, index, 0.5))
    follower.start()
    for _ in range(600):
        if not index.should_compact():
            break
        threading.Event().wait(0.2)
    assert not index.should_compact() and query.isActive and hits(index, "again3") == ["a"]
    (feed / "1.json").write_text(json.dumps({"path": "b", "action": "index", "seq": 1, "content": "later"}))
    for _ in range(100):
        if hits(index, "later") == ["b"]:
            break
        threading.Event().wait(0.2)
    assert hits(index, "later") == ["b"]
    query.stop()
    follower.join(60)


def test_documents_of_one_index_equal_another(spark, tmp_path):
    """Searches over the written tables give what a scan gives."""
    files = {f"f{i}": f"the quick {'brown' if i % 3 else 'red'} fox number{i} x the end" for i in range(30)}
    index = Index(spark, str(tmp_path / "i"))
    index.build(files_df(spark, files))
    plain = Corpus(files_df(spark, files).select("file_path", "content"))
    for pattern in ("the", "numb%", "%ber2", "%umbe%", "the brown", "red fox"):
        assert hits(index, pattern) == sorted(r["file_path"] for r in tok.search(plain, pattern).collect()), pattern
    same = lambda c: sorted((r["file_path"], r["hits"]) for r in tok.phrase(c, [(0, "fox"), (3, "the")]).collect())
    assert same(index.corpus()) == same(plain) and len(same(plain)) == 30
    assert index.terms().where(F.col("token") == "the").first().asDict() == {"token": "the", "df": 30, "cf": 60}
