"""A change feed as a stream: every micro-batch is reduced to the last change of each path and applied at once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.config import Config
from lexmill.operators.index import Index
from lexmill.operators.updates import latest
from lexmill.sources.listing import changed, listing, scan, store_of
from lexmill.workspace import new_folder

#: Rows of a feed: path, action ("index" or "remove"), seq, content (of paths to be indexed), repo_rel_path (the path, if it is left out).
FEED_SCHEMA = "path string, action string, seq long, content string, repo_rel_path string"

Listener = Callable[[dict], None]


def apply_batch(index: Index, feed: DataFrame, batch: int, config: Config | None = None, listener: Listener | None = None) -> None:
    """Applies a batch once: the index keeps the last batch's number, and one that is delivered again is passed over.

    Every path gets a row in the index's events table: indexed, removed or skipped (too large).  A batch's events are written
    ahead of its number, in a folder of the batch, so a crash in between writes them again rather than losing them.  An
    error is told to the listener and raised."""
    if batch <= index.last_batch:
        return
    config = config or Config()
    rel = F.coalesce("repo_rel_path", "path") if "repo_rel_path" in feed.columns else F.col("path")
    last = latest(feed.withColumn("repo_rel_path", rel), "seq").cache()
    try:
        # What has no content any more has vanished.
        last_known = last.withColumn("action", F.when((F.col("action") == "index") & F.col("content").isNull(), "remove").otherwise(F.col("action")))
        event = F.when(F.col("action") == "remove", "removed").when(F.octet_length("content") > config.max_file_size, "skipped").otherwise("indexed")
        events = last_known.select("path", event.alias("event"))
        counts = {r["event"]: r["n"] for r in events.groupBy("event").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts:
            files = index.table("files")
            new = last_known.where("action = 'index'").select(F.col("path").alias("file_path"), "repo_rel_path", "content")
            known = {"size": F.octet_length("content").cast("long"), "modified": F.current_timestamp()}
            for c in files.columns:
                if c not in new.columns:
                    new = new.withColumn(c, known.get(c, F.lit(None)).cast(files.schema[c].dataType))
            events.write.mode("overwrite").parquet(index.store.path(f"events/batch={batch}"))
            index.apply(last_known.select("path", "action"), new, config, batch)
            if listener:
                listener({"event": "batch_saved", "batch": batch, **{e: counts.get(e, 0) for e in ("indexed", "removed", "skipped")}})
    except Exception as e:
        if listener:
            listener({"event": "error", "batch": batch, "message": str(e)})
        raise
    finally:
        last.unpersist()


def latest_from_stream(changes: DataFrame, *order: str) -> DataFrame:
    """The last change of each path over all that a stream has now; the state is one row a path, and the result a table in the shared folder."""
    spark, at = changes.sparkSession, new_folder(changes.sparkSession, "latest")
    last: list[int] = []

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/{n}")
        last.append(n)

    made = latest(changes, *order)
    made.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/{last[-1]}") if last else spark.createDataFrame([], made.schema)


def write_feed(index: Index, root: str, feed_folder: str, config: Config | None = None) -> int:
    """Appends to a feed what changed under root since the index was built or updated; the number of changes.

    Paths are those of the index's files, and contents are read of changed files only by the join."""
    spark = index.spark
    changes = changed(listing(spark, root, config), index.table("files"), root)
    content = scan(spark, root, config).select("repo_rel_path", "content")
    base = store_of(root)[1]
    rows = changes.join(content, changes["path"] == content["repo_rel_path"], "left").select(F.concat(F.lit(f"{base.rstrip('/')}/"), "path").alias("path"), "action", F.lit(time.time_ns()).alias("seq"), "content", F.col("path").alias("repo_rel_path"))
    rows = rows.cache()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").json(feed_folder)
        return n
    finally:
        rows.unpersist()


def watch(spark: SparkSession, feed_folder: str, index: Index, checkpoint: str, config: Config | None = None, listener: Listener | None = None, once: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
    """Follows a folder of JSON change files.  once: applies what is there and stops."""
    index.recover()
    reader = spark.readStream.schema(FEED_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    feed = reader.json(feed_folder)
    writer = feed.writeStream.foreachBatch(lambda df, n: apply_batch(index, df, n, config, listener)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="50 milliseconds")).start()


def stop_when_idle(query: StreamingQuery, seconds: int, poll: float = 1.0, index: Index | None = None, compact_after: float | None = None) -> None:
    """Returns when the query has had no rows for so long and was stopped, or has ended; 0 never stops it.

    index and compact_after: an index with many segments is compacted once the query has been idle that long, while the stream goes on."""
    last, seen = time.monotonic(), None
    while query.isActive:
        query.awaitTermination(poll)
        progress = query.lastProgress
        if progress and progress["numInputRows"] and progress["batchId"] != seen:
            last, seen = time.monotonic(), progress["batchId"]
        idle = time.monotonic() - last
        if index is not None and compact_after is not None and idle >= compact_after and index.should_compact():
            index.compact()
        if seconds and idle >= seconds:
            query.stop()
