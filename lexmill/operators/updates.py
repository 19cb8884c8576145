"""Change feeds as table operations.

A change has path, action ("index" or "remove") and seq; within a batch the last change of a path wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of file event does; metadata events do nothing.
EVENT_ACTIONS = {"create": "index", "modify_data": "index", "rename_to": "index", "rename_other": "index", "rename_from": "remove", "remove": "remove"}


def action_of(event: Column) -> Column:
    """The action of an event kind, null for events that change nothing."""
    out = F.lit(None).cast("string")
    for kind, action in EVENT_ACTIONS.items():
        out = F.when(event == kind, F.lit(action)).otherwise(out)
    return out


def rename_pairs(events: DataFrame) -> DataFrame:
    """path, action, seq from events (kind, path, new_path, seq): a rename with both ends removes the old path and indexes the new one."""
    change = lambda p, a: F.struct(p.alias("path"), a.alias("action"))
    both = F.array(change(F.col("path"), F.lit("remove")), change(F.col("new_path"), F.lit("index")))
    one = F.array(change(F.col("path"), action_of(F.col("kind"))))
    made = events.select("seq", F.explode(F.when(F.col("new_path").isNotNull(), both).otherwise(one)).alias("c"))
    return made.select("c.path", "c.action", "seq").where("action is not null")


def latest(changes: DataFrame, *order: str) -> DataFrame:
    """One row a path: the change that is last by the given columns.  An aggregate, so that a busy path is reduced before the shuffle."""
    rest = [c for c in changes.columns if c != "path"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select("path", "x.*")


def vanished_to_remove(changes: DataFrame, present: DataFrame) -> DataFrame:
    """An "index" of a path that is not present any more becomes a "remove"."""
    here = present.select(F.col("path"), F.lit(True).alias("here")).distinct()
    joined = changes.join(here, "path", "left")
    gone = (F.col("action") == "index") & F.col("here").isNull()
    return joined.withColumn("action", F.when(gone, F.lit("remove")).otherwise(F.col("action"))).drop("here")


def without(table: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows of the table whose path is not among paths."""
    return table.join(paths.select(F.col(paths.columns[0]).alias(column)).distinct(), column, "left_anti")


def upserted(table: DataFrame, new: DataFrame, changes: DataFrame, column: str = "file_path") -> DataFrame:
    """The table without the changed paths, and the new rows of those to be indexed."""
    index = changes.where("action = 'index'").select(F.col("path").alias(column))
    return without(table, changes.select("path"), column).unionByName(new.join(index, column, "left_semi").select(*table.columns))


def within_size(files: DataFrame, most: int) -> DataFrame:
    """Files of at most so many bytes of content; an update removes the rows of a file that has outgrown it."""
    return files.where(F.octet_length("content") <= most)
