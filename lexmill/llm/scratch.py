"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A written table cuts lineage, outlives lost executors and lets adaptive execution see exact sizes.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Scratch of the pipeline stages of each session that ran so far, and whether a stage is being set up.
_STAGES: dict[str, list[Scratch]] = {}
_OPEN: set[str] = set()
#: After so many tables the driver lets go of the plans and broadcasts of those before.
LET_GO = 6


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="lexmill-")
        _on_exit(spark, _OWN[app])
    return _OWN[app]


def _on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


class Scratch:
    """Tables of one operator call.  They go when the session ends, or earlier through drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _on_exit(spark, self.root)
        if spark.sparkContext.applicationId in _OPEN:
            _STAGES.setdefault(spark.sparkContext.applicationId, []).append(self)

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def save(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexmill_path = path
        if self._n % LET_GO == 0:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._lexmill_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Around the set-up of a pipeline stage.  Its predecessors' results are written by then, so their scratch goes; its own stays until the next stage begins."""
    app = spark.sparkContext.applicationId
    for old in _STAGES.pop(app, []):
        old.drop_all()
    _OPEN.add(app)
    try:
        yield
    finally:
        _OPEN.discard(app)
