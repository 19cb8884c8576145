"""A persisted index: tables in versioned generations, of which a pointer names the active one.

    root/CURRENT                           the active generation's name
    root/DIRTY                             there while an update runs
    root/generations/gen-<number>/
        report.json                        version, segments in order, last batch, signature
        <segment>/                         files, grouped, postings, reversed, terms, lengths, symbols, gone (Parquet)

A generation is built aside and becomes active by renaming the pointer's new text over the old.  An update
costs what it changes: it adds a segment with the changed files' rows and the list of all changed paths, whose
rows in earlier segments no longer count; then the report is replaced as a whole, together with the number of
the batch, so that a batch is applied once.  Readers drop outdated rows by an anti join with the changed paths
since the last compaction, which merges the segments into a new generation.  postings of a base segment is
sorted by token in ranges, so that exact and prefix searches read few row groups; reversed is a slim copy sorted
by the reversed token, for suffixes; terms holds each token's frequencies, by which regex searches are planned.
They are all made from grouped, which holds each file's postings as they come from one pass over its text.

A crash within an update leaves the report as it was, and a segment that no report names; recover() removes it.
Updates and compaction exclude each other within a process.
"""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions.analyzers import extension
from lexmill.sources.extract import SCANNERS, symbols_of
from lexmill.sources.listing import fingerprint

from .corpus import Corpus, grouped_files, postings_of, term_table
from .symbols import search_columns
from .updates import within_size

VERSION = 3


class NoIndex(RuntimeError):
    """There is no usable index."""


class Store:
    """Small files and folders next to the tables, on whatever file system the root is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        # An instance of its own without side files for checksums, which a rename cannot replace together with their file.
        self.fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)
        self.fs.setVerifyChecksum(False)
        self._rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._array = spark.sparkContext._gateway.new_array

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.path(name)))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(self.path(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file is renamed over the old one."""
        new = self._path(self.path(f"{name}.new"))
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._overwrite
        self._rename.rename(new, self._path(self.path(name)), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.path(name)), True)

    def names(self, folder: str) -> list[str]:
        at = self._path(self.path(folder))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(self.path(name))).getLength() if self.exists(name) else 0


class Generations:
    """Which generation is active, and what may go."""

    def __init__(self, store: Store):
        self.store = store

    def create(self) -> str:
        return f"gen-{time.time_ns()}"

    def activate(self, name: str) -> None:
        self.store.write("CURRENT", name)

    def active(self) -> str | None:
        """None if the pointer is missing, malformed, or names a generation that is gone."""
        name = (self.store.read("CURRENT") or "").strip()
        return name if name.startswith("gen-") and "/" not in name and self.store.exists(f"generations/{name}") else None

    def clean(self) -> list[str]:
        """Removes all but the active generation; nothing if none is active."""
        active = self.active()
        gone = [g for g in self.store.names("generations") if g != active] if active else []
        for g in gone:
            self.store.remove(f"generations/{g}")
        return gone

    def mark_dirty(self) -> None:
        self.store.write("DIRTY", "")

    def clear_dirty(self) -> None:
        self.store.remove("DIRTY")

    @property
    def dirty(self) -> bool:
        return self.store.exists("DIRTY")

    def report(self, name: str | None = None) -> dict | None:
        name = name or self.active()
        text = self.store.read(f"generations/{name}/report.json") if name else None
        return json.loads(text) if text else None

    def needs_rebuild(self) -> bool:
        report = self.report()
        return report is None or self.dirty or report.get("version") != VERSION


@dataclass
class Index:
    """Build, open, update and describe the index under a root folder."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.store = Store(self.spark, self.root)
        self.generations = Generations(self.store)
        self._lock = threading.RLock()

    def _at(self, generation: str, segment: str, table: str) -> str:
        return self.store.path(f"generations/{generation}/{segment}/{table}")

    def _write(self, generation: str, segment: str, files: DataFrame, gone: DataFrame | None = None) -> None:
        """files: file_path, repo_rel_path, content and any listing columns; gone: the paths whose earlier rows no longer count."""
        put = lambda df, table: df.write.mode("overwrite").parquet(self._at(generation, segment, table))
        put(files, "files")
        files = self.spark.read.schema(files.schema).parquet(self._at(generation, segment, "files"))
        slim = files.select("file_path", "content")
        put(grouped_files(slim), "grouped")
        grouped = self.spark.read.parquet(self._at(generation, segment, "grouped"))
        postings = postings_of(grouped)
        by = lambda df, *keys: df.sortWithinPartitions(*keys) if gone is not None else df.repartitionByRange(keys[0]).sortWithinPartitions(*keys)
        put(by(postings, "token", "file_path"), "postings")
        put(by(postings.select("token_rev", "token", "file_path"), "token_rev", "file_path"), "reversed")
        put(by(term_table(postings), "token"), "terms")
        put(grouped.select("file_path", "dl"), "lengths")
        sources = files.where(extension(F.col("repo_rel_path")).isin(*SCANNERS))
        put(search_columns(symbols_of(sources, "file_path")), "symbols")
        put(gone if gone is not None else files.select("file_path").limit(0), "gone")

    def _report(self, generation: str, **fields) -> None:
        self.store.write(f"generations/{generation}/report.json", json.dumps({"version": VERSION, "segments": ["base"], "batch": -1, "signature": None, "built_ns": time.time_ns()} | fields))

    def build(self, files: DataFrame, config: Config | None = None) -> str:
        """A new active generation; the active one is kept if it is clean and has the same files and configuration."""
        signature = fingerprint(files.drop("content"), config).first()["signature"]
        report = self.generations.report()
        if report and not self.generations.needs_rebuild() and report["signature"] == signature:
            return self.generations.active()
        return self._activate(files, signature, -1)

    def _activate(self, files: DataFrame, signature: str | None, batch: int) -> str:
        name = self.generations.create()
        self._write(name, "base", files)
        n_files = self.spark.read.parquet(self._at(name, "base", "lengths")).count()
        self._report(name, signature=signature, batch=batch, n_files=n_files)
        self.generations.activate(name)
        self.generations.clear_dirty()
        self.generations.clean()
        return name

    def _active(self) -> tuple[str, dict]:
        name = self.generations.active()
        report = self.generations.report(name) if name else None
        if report is None:
            raise NoIndex(f"no index under {self.root}; build one first")
        return name, report

    def table(self, name: str) -> DataFrame:
        """A table of the active generation as of now: the rows of each segment but those of files that a later one changed."""
        generation, report = self._active()
        segments = report["segments"]
        parts = [self.spark.read.parquet(self._at(generation, s, name)) for s in segments]
        if len(parts) == 1:
            return parts[0]
        gone = [self.spark.read.parquet(self._at(generation, s, "gone")).withColumn("_later", F.lit(i)) for i, s in enumerate(segments) if i]
        last = reduce(DataFrame.unionByName, gone).groupBy("file_path").agg(F.max("_later").alias("_later")).withColumnRenamed("file_path", "_gone")
        rows = reduce(DataFrame.unionByName, [p.withColumn("_segment", F.lit(i)) for i, p in enumerate(parts)])
        return rows.join(last, (F.col("file_path") == F.col("_gone")) & (F.col("_segment") < F.col("_later")), "left_anti").drop("_segment")

    def terms(self) -> DataFrame:
        """token, df, cf as the segments counted them: a row a segment, replaced files included, so an upper bound."""
        generation, report = self._active()
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(generation, s, "terms")) for s in report["segments"]])

    def corpus(self) -> Corpus:
        report = self._active()[1]
        return Corpus(self.table("files").select("file_path", "content"), self.table("postings"), self.table("lengths"), self.table("reversed"), self.terms(), report.get("n_files"))

    def recover(self) -> list[str]:
        """After a crash: removes segments that the report does not name, and the dirty mark.  The names removed."""
        if not self.generations.dirty:
            return []
        name, report = self._active()
        left = [s for s in self.store.names(f"generations/{name}") if s not in report["segments"] and s != "report.json"]
        for s in left:
            self.store.remove(f"generations/{name}/{s}")
        self.generations.clear_dirty()
        return left

    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @property
    def last_batch(self) -> int:
        return self._active()[1]["batch"]

    def apply(self, changes: DataFrame, new: DataFrame, config: Config | None = None, batch: int | None = None) -> str:
        """One batch: paths to be indexed get new's rows, those to be removed, or grown past the size limit, go.  The new segment's name.

        changes: path, action; one row a path.  new: columns of the files table."""
        with self._lock:
            return self._apply(changes, new, config or Config(), batch)

    def _apply(self, changes: DataFrame, new: DataFrame, config: Config, batch: int | None) -> str:
        self.recover()
        name, report = self._active()
        segment = f"s{time.time_ns()}"
        self.generations.mark_dirty()
        wanted = changes.where("action = 'index'").select(F.col("path").alias("file_path"))
        fresh = within_size(new.join(wanted, "file_path", "left_semi"), config.max_file_size)
        columns = self.spark.read.parquet(self._at(name, report["segments"][0], "files")).columns
        self._write(name, segment, fresh.select(*columns), changes.select(F.col("path").alias("file_path")))
        self._report(name, **report | {"segments": [*report["segments"], segment], "signature": None, "batch": report["batch"] if batch is None else batch})
        self.generations.clear_dirty()
        return segment

    def compact(self) -> str:
        """The active generation's tables as one segment of a new generation."""
        with self._lock:
            _, report = self._active()
            return self._activate(self.table("files"), report["signature"], report["batch"])

    def should_compact(self, baseline: int = 1, factor: int = 3) -> bool:
        """True if there are many more segments than after a build."""
        return len(self._active()[1]["segments"]) > factor * baseline

    def status(self) -> dict:
        name = self.generations.active()
        report = self.generations.report() or {}
        shown = {k: report.get(k) for k in ("version", "segments", "batch", "signature", "built_ns")}
        return {"active": name, "dirty": self.generations.dirty, "needs_rebuild": self.generations.needs_rebuild(), "bytes": self.store.size(f"generations/{name}") if name else 0, "n_files": self.table("files").count() if report else None, **shown}
