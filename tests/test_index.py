"""Scans, generations, updates, streams, output and the service."""

import io
import json
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lexmill import written
from lexmill.__main__ import main
from lexmill.config import Config, config_for, read_config, repo_id, worktree_root
from lexmill.operators import tokens as tok
from lexmill.operators import updates as upd
from lexmill.operators.index import Index, NoIndex
from lexmill.service import Service, answer, search, serve
from lexmill.sinks import output
from lexmill.sources import listing as listing_module
from lexmill.sources.listing import IgnoreRules, fingerprint, glob_files, indexable, scan
from lexmill.sources.pdf import BadPdf, pdf_text
from lexmill.streaming.changes import apply_batch, watch


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def scanned(spark, root, **config):
    return {r["repo_rel_path"]: r["content"] for r in scan(spark, str(root), Config(**config)).collect()}


def test_scan(spark, tmp_path):
    write(tmp_path, {
        "src/lib.rs": "fn a() {}", "secret.yaml": "x", ".gitignore": "secret.yaml\n*.log\n!important.log\n", ".hidden/secret.rs": "x", "important.log": "keep", "other.log": "no",
        "sub/.gitignore": "*.generated.rs\n", "sub/a.generated.rs": "x", "sub/b.rs": "y", "big.txt": "x" * 200, "bad.txt": b"A\xffB\xe2\x82", "noext": "x", "doc.md": "d",
    })
    assert set(scanned(spark, tmp_path, max_file_size=100)) == {"src/lib.rs", "sub/b.rs", "bad.txt", "doc.md"}
    assert set(scanned(spark, tmp_path, include_extensions=("log",), exclude_extensions=("md",))) == {"src/lib.rs", "sub/b.rs", "bad.txt", "big.txt", "important.log"}
    assert scanned(spark, tmp_path)["bad.txt"] == b"A\xffB\xe2\x82".decode(errors="replace")


def test_scan_sees_every_name(spark, tmp_path, monkeypatch):
    """Names with a leading underscore, broken PDF files, linked folders, a file that cannot be read, rules of the user, the repository and the root."""
    home = tmp_path / "home"
    root = tmp_path / "root"
    write(home, {".config/git/ignore": "*.bak.txt\n", "elsewhere": ""})
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    write(root, {
        "__init__.py": "i", "_util/_a.py": "u", "__tests__/t.js": "t", "broken.pdf": b"no pdf", "odd.pdf": b"%PDF-1.4\n<</Filter /FlateDecode>> stream\nzzz\nendstream", "x.bak.txt": "b", "y.txt": "y", "gen/z.txt": "z", "gen/deep/w.txt": "w",
        "keep/.gitignore": "*.txt\n!stay.txt\n", "keep/a.txt": "a", "keep/stay.txt": "s", "keep/in/b.txt": "b", ".git/info/exclude": "/gen/\n", ".lexmillignore": "y.txt\n!keep/a.txt\n", ".env.py": "h", "notes": "n", "large.md": "l" * 99,
    })
    (root / "loop").symlink_to(root, target_is_directory=True)
    (root / "gone.py").symlink_to(root / "nowhere.py")
    config = Config(include_pdfs=True, max_file_size=90)
    rows = {r["repo_rel_path"]: (r["content"], r["reason"]) for r in listing_module.scanned(spark, str(root), config).collect()}
    assert {p for p, (c, why) in rows.items() if why is None} == {"__init__.py", "_util/_a.py", "__tests__/t.js", "keep/a.txt", "keep/stay.txt"}
    expected = {"broken.pdf": "unreadable", "odd.pdf": "unreadable", "x.bak.txt": "ignored", "y.txt": "ignored", "gen/": "ignored", "keep/in/b.txt": "ignored", ".git/": "hidden", "keep/.gitignore": "hidden", ".lexmillignore": "hidden", ".env.py": "hidden", "notes": "extension", "large.md": "size"}
    assert {p: why for p, (_, why) in rows.items() if why and p != "gone.py"} == expected
    report = {r["reason"]: (r["n"], r["samples"]) for r in listing_module.skip_report(listing_module.scanned(spark, str(root), config)).collect()}
    assert report["ignored"] == (4, ["gen/", "keep/in/b.txt", "x.bak.txt", "y.txt"]) and report["unreadable"][1][:2] == ["broken.pdf", "odd.pdf"]
    monkeypatch.setattr(listing_module, "HANDED_OUT", 1)
    assert {r["repo_rel_path"]: r["reason"] for r in listing_module.listing(spark, f"file://{root}", config).collect() if r["repo_rel_path"] != "gone.py"} == {p: None if why == "unreadable" else why for p, (_, why) in rows.items() if p != "gone.py"}


def test_changed_between_two_listings(spark, tmp_path):
    write(tmp_path, {"a.py": "a", "b.py": "b", "c.py": "c"})
    known = spark.createDataFrame(scan(spark, str(tmp_path)).collect())
    (tmp_path / "a.py").unlink()
    write(tmp_path, {"b.py": "longer", "d.py": "d"})
    got = listing_module.changed(listing_module.listing(spark, str(tmp_path)), known).collect()
    assert sorted(map(tuple, got)) == [("a.py", "remove"), ("b.py", "index"), ("d.py", "index")]


def test_unreadable_files_are_no_changes(spark, tmp_path):
    config = Config(include_pdfs=True)
    good = b"%PDF-1.4\n1 0 obj <</Length 1>> stream\nBT (Hello) Tj ET\nendstream endobj"
    for name in ("was.pdf", "stays.pdf"):
        (tmp_path / name).write_bytes(good)
    write(tmp_path, {"a.py": "a"})
    known = spark.createDataFrame(scan(spark, str(tmp_path), config).collect())
    assert known.count() == 3
    write(tmp_path, {"was.pdf": "broken", "never.pdf": "broken", "b.py": ""})
    (tmp_path / "new.pdf").write_bytes(good)
    (tmp_path / "a.py").unlink()
    got = listing_module.changed(listing_module.listing(spark, str(tmp_path), config), known, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a.py", "remove"), ("b.py", "index"), ("new.pdf", "index"), ("was.pdf", "remove")]


@pytest.mark.parametrize("ids", [(7, 8), ()])
def test_fingerprint_query_needs_no_certain_file(spark, tmp_path, ids):
    """Whichever documents there are, none included."""
    rows = [(i, "some text", "en", "src1") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert list(map(tuple, written.same_fingerprint(spark, str(tmp_path)).collect())) == [(len(ids), True, True)]


def test_ignore_rules():
    rules = IgnoreRules()
    rules.add("", ["# note", "build/", "/top.rs", "a/**/z.rs", "*.tmp", "!keep.tmp", r"\!odd"])
    for path, expected in [("build/x.rs", True), ("src/build/x.rs", True), ("top.rs", True), ("src/top.rs", False), ("a/b/c/z.rs", True), ("x.tmp", True), ("keep.tmp", False), ("!odd", True), ("ok.rs", False)]:
        assert rules.ignored(path) is expected, path


def test_extensions(spark):
    df = spark.createDataFrame([("a.RS",), ("a.pdf",), ("a.log",), ("x",), (".git/a.rs",)], "p string")
    keep = lambda **c: [r["p"] for r in df.where(indexable(F.col("p"), Config(**c))).collect()]
    assert keep() == ["a.RS"]
    assert keep(include_pdfs=True, include_extensions=("LOG",)) == ["a.RS", "a.pdf", "a.log"]
    assert keep(exclude_extensions=("rs",), include_extensions=("rs",)) == []


def test_pdf():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(Wor) -20 (ld\\051)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj <</Length 1 /Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj"
    assert pdf_text(data) == "Hello\nWorld)"
    with pytest.raises(BadPdf):
        pdf_text(b"no")


def test_config(tmp_path):
    write(tmp_path, {".lexmill.toml": "[index]\nmax_file_size = 5\n", "bad.toml": "max_file_size = 'x'", ".git/HEAD": "", "a/b.txt": ""})
    assert config_for(str(tmp_path)).max_file_size == 5
    with pytest.warns(UserWarning):
        assert read_config(str(tmp_path / "bad.toml")) == Config()
    write(tmp_path, {".lexmill/config.toml": "include_pdfs = true\n"})
    assert config_for(str(tmp_path)).include_pdfs
    assert worktree_root(str(tmp_path / "a")) == str(tmp_path)
    assert repo_id(str(tmp_path)) == repo_id(str(tmp_path)) != repo_id(str(tmp_path / "a"))


def files_df(spark, files):
    return spark.createDataFrame([(p, p, c) for p, c in files.items()], "file_path string, repo_rel_path string, content string")


def feed_df(spark, rows):
    return spark.createDataFrame(rows, "path string, action string, seq long, content string")


def hits(index, pattern):
    return sorted(r["file_path"] for r in tok.search(index.corpus(), pattern).collect())


def test_generations(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    assert index.generations.needs_rebuild()
    with pytest.raises(NoIndex):
        index.corpus()
    first = index.build(files_df(spark, {"a.py": "def alpha():\n    pass\n"}).withColumn("size", F.lit(1)))
    assert not index.generations.needs_rebuild() and index.generations.active() == first
    assert index.build(files_df(spark, {"a.py": "def alpha():\n    pass\n"}).withColumn("size", F.lit(1))) == first
    aside = index.generations.create()
    index.store.write(f"generations/{aside}/report.json", "{}")
    assert index.generations.active() == first and hits(index, "alpha") == ["a.py"]
    assert index.generations.clean() == [aside]
    index.generations.mark_dirty()
    assert index.generations.needs_rebuild()
    second = index.build(files_df(spark, {"b.py": "x = 1\n"}))
    assert second != first and index.store.names("generations") == [second] and not index.generations.dirty
    index.store.write("CURRENT", "gen-gone")
    assert index.generations.active() is None
    index.store.write("CURRENT", "../x")
    assert index.generations.active() is None
    index.generations.activate(second)
    index.store.write(f"generations/{second}/report.json", json.dumps({"version": 1}))
    assert index.generations.needs_rebuild()


def test_updates_equal_a_rebuild(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    index.build(files_df(spark, {"a.rs": "alpha initialize", "b.rs": "beta", "c.py": "def c():\n    pass\n"}))
    events: list = []
    rows = [("a.rs", "index", 1, "gamma"), ("a.rs", "index", 2, "delta connect"), ("c.py", "remove", 3, None), ("d.py", "index", 4, "def d():\n    pass\n"), ("gone.rs", "index", 5, None), ("missing", "remove", 6, None)]
    apply_batch(index, feed_df(spark, rows), 0, listener=events.append)
    assert events == [{"event": "batch_saved", "batch": 0, "indexed": 2, "removed": 3, "skipped": 0}]
    expected = {"a.rs": "delta connect", "b.rs": "beta", "d.py": "def d():\n    pass\n"}
    other = Index(spark, str(tmp_path / "other"))
    other.build(files_df(spark, expected))
    for table in ("postings", "lengths", "symbols"):
        key = lambda r: json.dumps(r.asDict(True), sort_keys=True, default=str)
        assert sorted(map(key, index.table(table).collect())) == sorted(map(key, other.table(table).collect())), table
    for pattern in ("alpha", "init%", "%ize", "%niti%", "gamma"):
        assert hits(index, pattern) == []
    before = index.generations.report()
    apply_batch(index, feed_df(spark, [("b.rs", "remove", 9, None)]), 0)
    assert index.generations.report() == before and len(before["segments"]) == 2
    assert spark.read.parquet(index.store.path("events")).where("event = 'removed'").count() == 3
    index.apply(feed_df(spark, [("b.rs", "index", 1, "")]).select("path", "action"), files_df(spark, {"b.rs": "x" * 50}), Config(max_file_size=10))
    assert hits(index, "beta") == [] and index.table("files").count() == 2
    assert hits(index, "delta") == ["a.rs"] and not index.should_compact()
    for i in range(2):
        index.apply(feed_df(spark, [("a.rs", "index", 1, "")]).select("path", "action"), files_df(spark, {"a.rs": f"again{i} delta"}))
    assert index.should_compact() and hits(index, "again0") == [] and hits(index, "again1") == ["a.rs"]
    index.compact()
    assert hits(index, "again1") == ["a.rs"] and hits(index, "delta") == ["a.rs"] and not index.should_compact()
    assert index.status()["n_files"] == 2 and index.status()["segments"] == ["base"] and index.last_batch == 0
    again = index.generations.report()
    index._write(index.generations.active(), "s-crashed", files_df(spark, {"z": "zeta"}), files_df(spark, {"a.rs": ""}).select("file_path"))
    assert hits(index, "again1") == ["a.rs"] and hits(index, "zeta") == [] and index.generations.report() == again


def test_stream(spark, tmp_path):
    index = Index(spark, str(tmp_path / "idx"))
    index.build(files_df(spark, {"a.rs": "fn original() {}"}))
    feed = tmp_path / "feed"
    feed.mkdir()
    for i in range(5):
        row = {"path": "a.rs", "action": "index", "seq": i, "content": f"fn cycle_{i}() {{}}"}
        (feed / f"{i}.json").write_text(json.dumps(row))
    watch(spark, str(feed), index, str(tmp_path / "cp"), once=True, files_per_batch=2).awaitTermination(120)
    assert hits(index, "cycle_4") == ["a.rs"] and hits(index, "cycle_3") == [] and hits(index, "original") == []
    (feed / "9.json").write_text(json.dumps({"path": "a.rs", "action": "remove", "seq": 9}))
    watch(spark, str(feed), index, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert index.table("files").count() == 0


def test_change_rules(spark):
    events = spark.createDataFrame([("create", "a", None, 1), ("metadata", "b", None, 2), ("rename_both", "c", "d", 3), ("remove", "a", None, 4)], "kind string, path string, new_path string, seq long")
    changes = upd.rename_pairs(events)
    assert sorted(map(tuple, upd.latest(changes, "seq").select("path", "action").collect())) == [("a", "remove"), ("c", "remove"), ("d", "index")]
    gone = upd.vanished_to_remove(changes.where("path = 'd'"), spark.createDataFrame([("x",)], "path string"))
    assert gone.first()["action"] == "remove"


def test_fingerprint(spark):
    one = files_df(spark, {"a": "1", "b": "2"}).withColumn("size", F.lit(1))
    same = fingerprint(one.orderBy(F.desc("file_path"))).first()
    assert fingerprint(one).first() == same
    assert fingerprint(one.where("file_path = 'a'")).first() != same
    assert fingerprint(one, Config(include_pdfs=True)).first()["signature"] != same["signature"]
    assert fingerprint(one.limit(0)).first()["n_files"] == 0
    assert glob_files(one, "a").count() == 1


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("svc") / "idx"))
    index.build(files_df(spark, {"src/lib.rs": "ctx_before\nfn search_hit() { search_hit(); }\nctx_after\n", "src/b.rs": "fn other() {}\n" + "x\n" * 5 + "fn other_two() {}\n", "top.py": "def handle_it():\n    pass\n"}))
    return Service(index)


def run(service, pattern, **more):
    out = io.StringIO()
    return search(service, pattern, out=out, **more), out.getvalue()


def test_cli_output(service):
    assert run(service, "search_hit", no_snippets=True) == (0, "Found 1 results for pattern: search_hit\n\n1. src/lib.rs\n")
    assert run(service, "nowhere") == (1, "No results found for pattern: nowhere\n")
    assert run(service, "nowhere", style="plain") == (1, "")
    assert run(service, "search_hit", style="plain", context=1)[1].splitlines() == ["src/lib.rs-1-ctx_before", "src/lib.rs:2:fn search_hit() { search_hit(); }", "src/lib.rs-3-ctx_after"]
    assert run(service, "other%", style="plain", context=0)[1].splitlines() == ["src/b.rs:1:fn other() {}", "--", "src/b.rs:7:fn other_two() {}"]
    assert run(service, "search_hit", context=1)[1].splitlines()[-4:] == ["src/lib.rs", "  1 | ctx_before", "  2 | fn search_hit() { search_hit(); }", "  3 | ctx_after"]
    assert run(service, "fn", count=True) == (0, "2\n")
    assert run(service, "fn", files_only=True, glob="src/*.rs") == (0, "src/b.rs\nsrc/lib.rs\n")
    assert json.loads(run(service, "fn other", regex=True, style="json")[1]) == {"pattern": "fn other", "type": "regex", "count": 2, "results": [{"path": "src/b.rs", "line": 1, "content": "fn other() {}"}, {"path": "src/b.rs", "line": 7, "content": "fn other_two() {}"}]}
    assert run(service, "[invalid", regex=True)[0] == 2
    assert run(service, "kind:callable x")[0] == 2
    code, text = run(service, "kind:fn lang:py handle%")
    assert code == 0 and text.splitlines() == ["Found 1 symbols for: kind:fn lang:py handle%", "", "1. handle_it (function)", "   top.py:1  lang:python", "   def handle_it():"]
    assert json.loads(run(service, "kind:fn lang:py", style="json")[1])["results"][0]["kind"] == "function"
    assert run(service, "kind:fn", symbol_regex="search_hit", files_only=True) == (0, "src/lib.rs\n")
    assert run(service, "fn .*two", regex=True, count=True) == (0, "1\n")


def test_rpc(service, tmp_path, spark):
    call = lambda name, **a: answer(service, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert {t["name"] for t in answer(service, {"id": 1, "method": "tools/list"})["result"]["tools"]} == {"search_tokens", "search_regex", "search_symbols"}
    assert json.loads(call("search_tokens", pattern="search_hit")["result"]["content"][0]["text"])["count"] == 1
    assert json.loads(call("search_tokens", pattern="fn", limit=1, glob="src/*.rs")["result"]["content"][0]["text"])["count"] == 1
    assert json.loads(call("search_regex", pattern="OTHER", ignore_case=True)["result"]["content"][0]["text"])["count"] == 2
    assert json.loads(call("search_symbols", query="kind:fn", symbol_regex="two")["result"]["content"][0]["text"])["results"][0]["name"] == "other_two"
    for bad in (call("search_tokens"), call("search_regex", pattern="[invalid"), call("search_symbols", query="kind:zzz"), call("nope"), call("search_tokens", pattern="x", limit=-1)):
        assert bad["error"]["code"] == -32602
    assert answer(service, {"id": 1, "method": "x"})["error"]["code"] == -32601
    assert answer(service, {"method": "notifications/initialized"}) is None
    empty = Service(Index(spark, str(tmp_path / "none")))
    assert answer(empty, {"id": 1, "method": "tools/call", "params": {"name": "search_tokens", "arguments": {"pattern": "x"}}})["error"]["code"] == -32002
    out = io.StringIO()
    serve(service, io.StringIO('not json\n{"id": 2, "method": "ping"}\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [None, 2]


def test_main(spark, tmp_path, capsys):
    write(tmp_path, {".git/HEAD": "", "a.py": "def alpha():\n    pass\n"})
    root = ["--root", str(tmp_path)]
    assert main([*root, "build"], spark) == 0
    assert json.loads(capsys.readouterr().out)["n_files"] == 1
    assert main([*root, "search", "alpha", "-l"], spark) == 0
    assert main([*root, "search", "kind:fn"], spark) == 0
    assert main([*root, "search", "nothing_here"], spark) == 1
    capsys.readouterr()
    write(tmp_path, {"b.bin": "x"})
    assert main([*root, "status", "--text"], spark) == 0 and "Files:    1" in capsys.readouterr().out
    assert main([*root, "skipped"], spark) == 0 and "extension: 1\n  b.bin" in capsys.readouterr().out
    assert main([*root, "clean"], spark) == 0 and json.loads(capsys.readouterr().out) == {"recovered": [], "removed": []}
    write(tmp_path, {"c.py": "x = 1\n"})
    assert main([*root, "feed", str(tmp_path / ".feed")], spark) == 0 and capsys.readouterr().out == "1\n"


def test_formats():
    assert (output.format_bytes(10), output.format_bytes(2048), output.format_duration(61), output.format_duration(3700)) == ("10 B", "2.0 KB", "1m 1s", "1h 1m")
    assert output.symbol_lines([], "x") == ["No symbols found for: x"]
    assert [output.format_ago(0, s * 10**9) for s in (5, 61, 7300, 200_000)] == ["5s ago", "1m ago", "2h ago", "2d ago"]
    assert output.status_lines({"active": None, "repo": "r"}) == ["r: no index"]
    assert output.status_lines({"active": "g", "repo": "r", "needs_rebuild": False, "n_files": 3, "segments": ["base"], "bytes": 2048, "built_ns": time.time_ns()}) == ["r: ready", "Files:    3", "Segments: 1", "Size:     2.0 KB", "Built:    0s ago"]
