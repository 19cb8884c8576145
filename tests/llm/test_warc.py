import base64
import gzip
import hashlib
from collections import defaultdict

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from lexmill.llm import skew, warc
from lexmill.llm.warc import Parser, archived, export_archives, import_archives, read_archives, record_of, write_archives

PAGES = [(1, "http://a/", "x" * 999), (2, "http://b/", "x" * 999), (3, "u", "y" * 1000), (4, "u", "y" * 1000), (9, None, "y" * 1000), (5, "u", None), (6, "u", ""), (7, "u\r\nX: 1", "é" * 70_000), (8, "u", "WARC/1.1\r\n\r\n" * 9000),
         (None, "u", "z" * 1200), (10, "u", "z" * 1200), (11, "u", "q" * 1500), (11, "u", "q" * 1500), (12, "u", "q" * 1500), (12, "u", "q" * 1500)]


def brute(pages):
    largest = defaultdict(lambda: -1)
    for i, _, html in pages:
        largest[html] = max(largest[html], -1 if i is None else i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and i != largest[html]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(pages):
    got = archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(PAGES)


def test_empty_table(pages):
    assert archived(pages.limit(0)).collect() == []


def test_archives_are_warc_files(spark, pages, tmp_path):
    """Chunks stay small, carry the running digest, and concatenate to a stream of records."""
    target = str(tmp_path / "w")
    write_archives(pages, target, chunk=1000, archive_bytes=50_000)
    rows = sorted(ds.dataset(target).to_table().to_pylist(), key=lambda r: (r["archive"], r["seq"], r["chunk"]))
    assert len({r["archive"] for r in rows}) > 3 and max(len(r["data"]) for r in rows) < 2200
    payloads = {f"<urn:page:{'null' if i is None else i}>": (h or "").encode() for i, _, h in PAGES}
    whole: dict[int, bytes] = defaultdict(bytes)
    for r in rows:
        whole[r["archive"]] += r["data"]
        assert b"\r\nX: 1\r\n" not in r["data"][:600]
        if r["data"].endswith(b"\r\n\r\n") and b"WARC-Type: revisit" not in r["data"]:
            last = r
            if payloads[r["record_id"]].endswith(r["data"][-14:-4]):
                assert last["digest"] == hashlib.sha1(payloads[r["record_id"]]).hexdigest()
    found = [record_of(x) for data in whole.values() for x in Parser().feed(data)]
    assert len(found) == len(PAGES)
    assert read_archives(spark, target).count() == len(PAGES)


def test_parser_takes_any_pieces():
    head, http = warc._head(1, "u", 5, hashlib.sha1(b"hello").hexdigest(), None)
    data = (head + http + b"hello" + b"\r\n\r\n") * 2
    for size in (1, 7, len(data)):
        parser = Parser()
        out = [x for i in range(0, len(data), size) for x in parser.feed(data[i : i + size])]
        assert [record_of(x)["payload_bytes"] for x in out] == [5, 5]
    with pytest.raises(ValueError, match="digest"):
        list(map(record_of, Parser().feed(data.replace(b"hello", b"jello"))))
    with pytest.raises(ValueError, match="not a WARC"):
        list(Parser().feed(b"HTTP/1.1\r\n\r\n"))


def test_files_round_trip(spark, pages, tmp_path):
    target, folder = str(tmp_path / "w"), f"file://{tmp_path}/out"
    write_archives(pages, target, archive_bytes=50_000)
    names = export_archives(spark, target, folder)
    assert names and all(n.endswith(".warc") for n in names)
    plain = (tmp_path / "out" / names[0]).read_bytes()
    (tmp_path / "out" / (names[0] + ".gz")).write_bytes(gzip.compress(plain))
    (tmp_path / "out" / names[0]).unlink()
    columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, import_archives(spark, folder, chunk=100).select(columns).collect()), key=str) == brute(PAGES)


def record(kind, name, body, content="text/plain", **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"Content-Type: {content}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_files_of_other_makers(spark, tmp_path):
    """warcinfo, request, metadata and resource records, base 32 digests, wrong ones, ids of another kind, an HTTP block without an end, gzip members."""
    http, page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n", b"<p>hello</p>" * 300
    b32 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    made = [
        record("warcinfo", "a", b"software: x\r\n\r\nformat: y", "application/warc-fields"),
        record("request", "b", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"),
        record("response", "c", http + page, "application/http; msgtype=response", WARC_Target_URI="http://a/", WARC_Payload_Digest=f"sha1:{b32}"),
        record("response", "d", http + page, "application/http; msgtype=response", WARC_Payload_Digest="sha1:" + "0" * 40),
        record("response", "e", b"HTTP/1.1 204 No Content", "application/http"),
        record("metadata", "f", b"", "application/warc-fields"),
        record("resource", "g", b"plain\r\n\r\nbytes", "text/plain", WARC_Payload_Digest="md5:abc"),
        record("revisit", "h", http, "application/http; msgtype=response", WARC_Refers_To="<urn:uuid:c>", WARC_Payload_Digest=f"sha1:{b32}"),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(made))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    got = import_archives(spark, f"file://{tmp_path}", chunk=64).collect()
    assert len(got) == 2 * len(made)
    for found in (got[: len(made)], got[len(made) :]):
        rows = {r["record_id"][10:-1]: r for r in found}
        sizes = {n: rows[n]["payload_bytes"] for n in "abcdefgh"}
        assert sizes == {"a": 24, "b": 0, "c": len(page), "d": len(page), "e": 23, "f": 0, "g": 14, "h": None}
        assert [rows[n]["digest_ok"] for n in "abcdefgh"] == [None, None, True, False, None, None, None, None]
        assert rows["h"]["refers_to_record"] == "<urn:uuid:c>" and rows["h"]["payload_digest"] == rows["c"]["payload_digest"] == hashlib.sha1(page).hexdigest()
        assert all(r["id"] is None and r["refers_to"] is None for r in found)


def test_damaged_chunks_are_found(spark, pages, tmp_path):
    write_archives(pages, str(tmp_path / "w"), chunk=1000)
    chunks = spark.read.parquet(str(tmp_path / "w"))
    gone = chunks.where("not (record_id = '<urn:page:7>' and chunk = 3)")
    gone.write.parquet(str(tmp_path / "gone"))
    changed = F.when((F.col("record_id") == "<urn:page:8>") & (F.col("chunk") == 5), F.expr("encode(translate(decode(data, 'ISO-8859-1'), 'W', 'V'), 'ISO-8859-1')")).otherwise(F.col("data"))
    chunks.withColumn("data", changed).write.parquet(str(tmp_path / "changed"))
    for name in ("gone", "changed"):
        with pytest.raises(Exception, match="running digest"):
            read_archives(spark, str(tmp_path / name)).collect()


def test_many_repeated_digests(pages, monkeypatch):
    """Digests that are too many to be broadcast, and a hot one."""
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    for hot in (1, 100_000):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == brute(PAGES)


def test_payload_larger_than_a_batch(spark):
    big = "é" * 3_000_000
    got = archived(spark.createDataFrame([(1, "u", big), (2, "u", big)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got] == [(6_000_000, "revisit", 2), (6_000_000, "response", None)]
