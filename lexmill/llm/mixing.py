"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in id order, are cut into blocks.  Over a period of Q slots source s has an integer share
a of them; its block j is released at slot floor(j Q / a) and due at ceil((j + 1) Q / a), and every slot goes
to the released block with the earliest deadline.  The shares add up to Q, so every deadline is met and at any
slot t each source has been given a t / Q blocks, give or take less than one.  The schedule of one period is
repeated, so it is made once for any number of blocks.

When a source has no blocks left, the shares of the others are scaled to fill Q and a new phase begins; so
every row gets exactly one place.  There are at most as many phases as sources.  The schedule is made on the driver
from one count a source and sent out as arrays of at most MOST_PLACES numbers; a block finds its phase and slot in
them by bisection.  More sources than that allows are an error.

Weights are finite and not negative; a source of weight 0 gets the least share, one block a period, and if all
are 0 they are equal.  Other weights are a ValueError, a source without one a KeyError.

A null source is a source of its own (shown as null), a null id comes first; rows that repeat an id get
places of their own, in the order of the input.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK_ROWS = 64
SLOTS = 1000
TEMPERATURE = 0.5
MOST_PLACES = 20_000_000


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Integer shares that add up to slots, at least one each: largest remainders, ties by name."""
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    slots = max(slots, len(weights))
    total = sum(weights.values())
    if not total:
        weights, total = dict.fromkeys(weights, 1.0), float(len(weights))
    free = slots - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: slots - sum(out.values())]:
        out[s] += 1
    return out


def period(share: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot of one period, earliest deadline first; ties by name."""
    q = sum(share.values())
    at: list[list[tuple[int, str, int]]] = [[] for _ in range(q)]
    for s, a in share.items():
        for j in range(a):
            at[j * q // a].append((-(-(j + 1) * q // a), s, j))
    ready: list[tuple[int, str, int]] = []
    out = []
    for released in at:
        for block in released:
            heapq.heappush(ready, block)
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], slots: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (phase, source, first block, end block, first slot, share, slots of a period), and rows (phase, source, block within the period, slot within the period)."""
    spans, places = [], []
    done = dict.fromkeys(blocks, 0)
    begin = phase = 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        share = shares({s: weights[s] for s in left}, slots)
        order = period(share)
        at: dict[str, list[int]] = {s: [] for s in left}
        for t, (s, _) in enumerate(order):
            at[s].append(t)
        last = {s: (n - 1) // share[s] * len(order) + at[s][(n - 1) % share[s]] for s, n in left.items()}
        length = min(last.values()) + 1
        for s in left:
            whole, rest = divmod(length, len(order))
            took = whole * share[s] + sum(t < rest for t in at[s])
            spans.append((phase, s, done[s], done[s] + took, begin, share[s], len(order)))
            places += [(phase, s, j, t) for j, t in enumerate(at[s]) if whole or t < rest]
            done[s] += took
        begin += length
        phase += 1
    return spans, places


def _by_source(spans: list[tuple], offsets: list[tuple]) -> dict[str, tuple]:
    """Per source its phases in order: rows (first block, first slot, share, slots of a period, phase, where its slots begin), and the slots within a period."""
    slots: dict[str, dict[int, list[int]]] = {}
    for phase, s, _, t in offsets:
        slots.setdefault(s, {}).setdefault(phase, []).append(t)
    rows: dict[str, list[tuple]] = {}
    flat: dict[str, list[int]] = {}
    for phase, s, lo, hi, begin, share, q in spans:
        if hi > lo:
            rows.setdefault(s, []).append((lo, begin, share, q, phase, len(flat.setdefault(s, []))))
            flat[s] += slots[s][phase]
    return {s: (np.array(r, np.int64), np.array(flat[s], np.int32)) for s, r in rows.items()}


def _slotter(sent):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, blocks = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            phase, slot = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int64)
            for s in set(names.tolist()):
                at = np.flatnonzero(names == s)
                rows, flat = sent.value[s]
                lo, begin, share, q, number, first = rows[np.searchsorted(rows[:, 0], blocks[at], side="right") - 1].T
                cycle, j = np.divmod(blocks[at] - lo, share)
                phase[at], slot[at] = number, begin + cycle * q + flat[first + j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(phase), pa.array(slot)], ["s", "block_no", "phase", "slot"])

    return find


def places(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, slots: int = SLOTS) -> DataFrame:
    """Per row: id, source, block_no, row_in_block, phase, slot, position (slot * block_rows + row_in_block: the order of the mix).

    weights: the target weight of each source that the table has; by default the square root of its rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")).select("id", name.alias("s"), F.monotonically_increasing_id().alias("at"))
    keys = ["s", F.col("id").asc_nulls_first(), "at"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = scratch.save(ordered.select("id", "s", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ordered")
    runs = ordered.groupBy("part", "s").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("part")) - F.col("n")
    runs = scratch.save(runs.select("part", "s", "first", before.alias("before")), "runs")
    ranked = ordered.join(runs, ["part", "s"]).select("id", "s", (F.col("place") - F.col("first") + F.col("before")).alias("rank"))
    ranked = ranked.select("id", "s", F.floor(F.col("rank") / block_rows).alias("block_no"), (F.col("rank") % block_rows).cast("int").alias("row_in_block"))

    blocks = scratch.save(ordered.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "counts")
    counted = {r["s"]: r["n"] for r in blocks.collect()}
    wanted = {s: n**TEMPERATURE for s, n in counted.items()} if weights is None else {s: float(weights[s[1:] if s else None]) for s in counted}
    spans, offsets = phases({s: -(-n // block_rows) for s, n in counted.items()}, wanted, slots)
    if len(offsets) + 7 * len(spans) > MOST_PLACES:
        raise ValueError(f"{len(counted)} sources are too many for a period of {slots} slots")
    sent = spark.sparkContext.broadcast(_by_source(spans, offsets))
    numbered = ranked.where("row_in_block = 0").select("s", "block_no")
    slotted = scratch.save(numbered.mapInArrow(_slotter(sent), "s string, block_no long, phase int, slot long"), "slots")
    out = ranked.join(slotted, ["s", "block_no"])
    source = F.when(F.col("s") != "", F.substring("s", 2, 1 << 30))
    return out.select(F.col("id").alias(id_col), source.alias(source_col), "block_no", "row_in_block", "phase", "slot", (F.col("slot") * block_rows + F.col("row_in_block")).alias("position"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """All rows of docs, columns as they are, in the order of the mix (one sort; written files keep it in their names and rows).

    Rows that repeat an id and a source stand together at the place of the first."""
    at = places(docs, id_col=id_col, source_col=source_col, **more).groupBy(F.col(id_col).alias("_id"), F.col(source_col).alias("_source")).agg(F.min("position").alias("_position"))
    at = Scratch(docs.sparkSession, "order").save(at, "order")
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_key"), F.col(source_col).cast("string").alias("_of"))
    both = both.join(at, F.col("_key").eqNullSafe(F.col("_id")) & F.col("_of").eqNullSafe(F.col("_source")))
    return both.orderBy("_position").select("_row.*")
