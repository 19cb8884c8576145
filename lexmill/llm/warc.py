"""WARC archives as a chunked record table.

A record's bytes (header block, payload, two line ends) are cut into chunks of at most CHUNK bytes, one row
each: archive, seq (the record's place in its archive), chunk, record_id, data, and the payload's digest so far
(its SHA-1 up to and with this chunk).  An archive's rows in the order
(seq, chunk) are the bytes of a WARC 1.1 file.  No more than one chunk of a record is copied at a time, and
the reader parses chunks as they come.

Of records with equal payloads of at least LEAST_REVISIT bytes the one with the largest id is a response, the
others are revisits that refer to it and hold no payload; smaller payloads are always responses.

A reader checks every chunk against the digest that is stored with it, so a damaged or missing chunk is found
where it is.  Files of other makers are read too: any record type and record id, digests in base 32 or hex, and
responses whose header block has no end (then all of it is payload).  Which rows are revisits is decided on ids,
digests and sizes; payloads are shuffled only if the repeated digests are too many to be broadcast.

A null payload is empty.  Rows with a null id are written with the id "null" and read back as null; they are
never referred to unless no other row has their payload.  Rows that repeat the largest id are all responses.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import few, keyed_join

CHUNK = 64 << 10
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
#: Most repeated digests that are broadcast (about 100 bytes each).
MOST_BROADCAST = 200_000
CHUNK_SCHEMA = "archive long, seq int, chunk int, record_id string, data binary, digest string"
_CHUNK = pa.schema([("archive", pa.int64()), ("seq", pa.int32()), ("chunk", pa.int32()), ("record_id", pa.string()), ("data", pa.binary()), ("digest", pa.string())])
_END = b"\r\n\r\n"


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None) -> DataFrame:
    """id, url, payload, digest, refers_to (null for responses)."""
    scratch = Scratch(pages.sparkSession, "revisits")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    large = F.octet_length(payload) >= LEAST_REVISIT
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"), large.alias("large")).withColumn("digest", F.sha1("payload"))
    repeated = rows.where("large").groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    repeated = scratch.save(repeated, "repeated")
    if few(repeated, MOST_BROADCAST):
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        unique = rows.where("large").join(repeated, "digest", "left_anti").unionByName(rows.where("not large"))
        joined = keyed_join(rows.where("large"), repeated, ["digest"], "n").unionByName(unique, allowMissingColumns=True)
    refers = F.when(F.col("large") & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _head(row_id, url, size: int, digest: str, refers_to) -> tuple[bytes, bytes]:
    """The record's header block, and the HTTP head that precedes the payload."""
    name = "null" if row_id is None else str(row_id)
    http = b"" if refers_to is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    length = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END, http


def _chunker(chunk: int, archive_bytes: int, rows: int = 512, most: int = 4 << 20):
    """The first chunk also holds the header block, the last one the record's end."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, seq, filled = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            for i, row_id in enumerate(ids):
                payload = memoryview(batch.column(2)[i].as_buffer())
                head, http = _head(row_id, urls[i], len(payload), digests[i], refers[i])
                record, archive = f"<urn:page:{'null' if row_id is None else row_id}>", (part << 32) + number
                body = payload if refers[i] is None else payload[:0]
                so_far = hashlib.sha1()
                for n, at in enumerate(range(0, max(len(body), 1), chunk)):
                    piece = body[at : at + chunk]
                    so_far.update(piece)
                    data = b"".join(((head + http) if at == 0 else b"", piece, _END if at + chunk >= len(body) else b""))
                    held.append((archive, seq, n, record, data, so_far.hexdigest()))
                    size += len(data)
                    filled += len(data)
                    if len(held) >= rows or size >= most:
                        yield _rows(held)
                        held, size = [], 0
                seq += 1
                if filled >= archive_bytes:
                    number, seq, filled = number + 1, 0, 0
        if held:
            yield _rows(held)

    return write


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CHUNK, strict=True)], schema=_CHUNK)


def write_archives(pages: DataFrame, target: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> None:
    rows = with_revisits(pages, id_col, payload_col, url_col)
    rows.mapInArrow(_chunker(chunk, archive_bytes), CHUNK_SCHEMA).write.option("compression", "zstd").parquet(target)


class Parser:
    """Parses a stream of WARC bytes given piece by piece; yields finished records without their payloads.

    A record is a dict of its header fields with "payload_bytes" and "payload_digest" as read."""

    def __init__(self):
        self.held = b""
        self.state = "warc"

    def feed(self, data: bytes) -> Iterator[dict]:
        self.held += data
        while True:
            if self.state == "warc":
                at = self.held.find(_END)
                if at < 0:
                    return
                block, self.held = self.held[:at], self.held[at + 4 :]
                lines = block.decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left, self.size, self.sum = int(self.fields["content-length"]), 0, hashlib.sha1()
                http = self.fields.get("content-type", "").startswith("application/http")
                self.state = "end" if not self.left else "http" if http else "body"
            elif self.state == "http":
                at = self.held.find(_END, 0, self.left)
                if at < 0 and len(self.held) < self.left:
                    return
                skipped = at + 4 if at >= 0 else 0
                self.held, self.left = self.held[skipped:], self.left - skipped
                self.state = "body" if self.left else "end"
            elif self.state == "body":
                part, self.held = self.held[: self.left], self.held[self.left :]
                self.sum.update(part)
                self.size += len(part)
                self.left -= len(part)
                if self.left:
                    return
                self.state = "end"
            else:
                if len(self.held) < 4:
                    return
                if self.held[:4] != _END:
                    raise ValueError("a record does not end in two line ends")
                self.held, self.state = self.held[4:], "warc"
                yield self.fields | {"payload_bytes": self.size, "payload_digest": self.sum.hexdigest()}


def _page(name: str | None) -> int | None:
    """The id of a record of our own; null for others."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def sha1_hex(declared: str | None) -> str | None:
    """A declared SHA-1, in hex or base 32, as lower-case hex; null for other algorithms and forms."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except binascii.Error:
        return None


def any_record(found: dict) -> dict:
    """The row of a parsed record of any maker; digest_ok is null without a digest to compare, and for revisits."""
    declared, revisit = sha1_hex(found.get("warc-payload-digest")), found.get("warc-type") == "revisit"
    size = found.get("warc-payload-length", "")
    return {
        "id": _page(found.get("warc-record-id")), "url": found.get("warc-target-uri") or None, "payload_bytes": (int(size) if size.isdigit() else None) if revisit else found["payload_bytes"],
        "payload_digest": declared if revisit else found["payload_digest"], "record_type": found.get("warc-type"), "refers_to": _page(found.get("warc-refers-to")),
        "record_id": found.get("warc-record-id"), "refers_to_record": found.get("warc-refers-to"), "digest_ok": None if revisit or declared is None else declared == found["payload_digest"],
    }


def record_of(found: dict) -> dict:
    """The row of a record of our own; a response whose payload differs from its declared digest is an error."""
    row = any_record(found)
    if row["digest_ok"] is False:
        raise ValueError(f"{found['warc-record-id']}: the payload does not match its digest")
    return {n: row[n] for n in _RECORD.names}


_RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


_ANY = pa.schema([*_RECORD, ("record_id", pa.string()), ("refers_to_record", pa.string()), ("digest_ok", pa.bool_())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records are whole and in order within a partition; a parser takes one after another and compares its running digest with each chunk's."""
    parser = Parser()
    for batch in batches:
        out = []
        for data, name, digest in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            out += [record_of(x) for x in parser.feed(data.as_buffer().to_pybytes())]
            if parser.sum.hexdigest() != digest:
                raise ValueError(f"{name}: a chunk does not match its running digest")
        yield pa.RecordBatch.from_pylist(out, _RECORD)
    if parser.held or parser.state != "warc":
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """id, url, payload_bytes, payload_digest, record_type, refers_to of every record, parsed from the chunks in order."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(target)
    ordered = chunks.repartition("archive", "seq").sortWithinPartitions("archive", "seq", "chunk").select("archive", "seq", "data", "record_id", "digest")
    return ordered.mapInArrow(_parse, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Writes all pages into the shared folder and reads the archives back."""
    target = Scratch(pages.sparkSession, "warc").path("chunks")
    write_archives(pages, target, id_col, payload_col, url_col)
    return read_archives(pages.sparkSession, target).withColumnRenamed("id", id_col)


def _folder_files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def export_archives(spark: SparkSession, target: str, folder: str) -> list[str]:
    """Writes each archive of a data set as <folder>/<archive>.warc, on any file system that Arrow knows; a file takes its name once it is whole."""
    ordered = spark.read.schema(CHUNK_SCHEMA).parquet(target).repartition("archive").sortWithinPartitions("archive", "seq", "chunk").select("archive", "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _folder_files(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        at, stream, done = None, None, []

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(f"{root}/{at:016x}.{attempt}.part", f"{root}/{at:016x}.warc")
                done.append(f"{at:016x}.warc")

        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive != at:
                    close()
                    at, stream = archive, files.open_output_stream(f"{root}/{archive:016x}.{attempt}.part")
                stream.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    return sorted(r["name"] for r in ordered.mapInArrow(write, "name string").collect())


def import_archives(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Records of the .warc and .warc.gz files of a folder, of any maker: as read_archives gives them, and record_id, refers_to_record, digest_ok.  Each file is streamed piece by piece."""
    files, root = _folder_files(folder)
    from pyarrow import fs

    names = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith((".warc", ".warc.gz"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _folder_files(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                parser, out = Parser(), []
                with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
                    while data := stream.read(chunk):
                        out += map(any_record, parser.feed(data))
                        if len(out) >= 1000:
                            yield pa.RecordBatch.from_pylist(out, _ANY)
                            out = []
                yield pa.RecordBatch.from_pylist(out, _ANY)
                if parser.held.strip(b"\r\n") or parser.state != "warc":
                    raise ValueError(f"{path} ends within a record")

    listed = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)))
    return listed.mapInArrow(read, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, digest_ok boolean")
