"""Folders that the whole cluster shares, for tables that queries and streams write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="lexmill-work-")
        _on_exit(spark, _OWN[app])
    return _OWN[app]


def _on_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a folder of its own, which goes when the session ends."""
    path = f"{shared_folder(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
    _on_exit(spark, path)
    return path
