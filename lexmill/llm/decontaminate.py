"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Normal form: A-Z lower-cased; words are runs of 0-9, a-z and non-ASCII characters, joined by one space.  An
item's windows are its runs of 10 words (an item of fewer words is one window).  The automaton holds anchors of
7 words, one at every fourth word of an item, between spaces: every window contains a whole anchor.  A text is
scanned once, whole; where an anchor is found, the run of equal words around it is measured, and a run of 10 or
more is a span, which is mapped back to offsets in the text.  Items of fewer words are anchors as they are.
An anchor costs about two automaton nodes for each byte of an item, where whole windows would cost ten.

The items are sent to the executors in blocks of at most ITEM_BYTES of text, each with an automaton of its
own.  Texts flow through CHAINED blocks in one task; if there are more, they are written in between.  So any
number of items works in bounded memory.

Nulls and blank texts have no words and no hits; an item that is null or has no words is skipped; a null
item_id counts as the text "null"; repeated items count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .words import slices

WINDOW = 10
#: Anchors are placed at every STRIDE-th word.
STRIDE = 4
ITEM_BYTES = 2 << 20
CHAINED = 4

#: To normal form, byte by byte: every byte of a non-ASCII character is 0x80 or more.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN = pa.struct([("item", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


_BUILT: dict[int, Items] = {}


class Items:
    """The automaton of a block of items."""

    def __init__(self, block: list[tuple[str, str]], width: int):
        self.width, self.anchor = width, max(1, width - STRIDE + 1)
        same: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for name, text in block:
            if words := tuple(text.encode().translate(_NORMAL).split()):
                same[words].append(name)
        self.words = list(same)
        self.names = [sorted(set(n)) for n in same.values()]
        places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(self.words):
            if len(words) < width:
                places[b" ".join(words)].append((i, -1))
            else:
                for at in range(0, len(words) - self.anchor + 1, STRIDE):
                    places[b" ".join(words[at : at + self.anchor])].append((i, at))
        self.known, self.meaning = ahocorasick.Automaton(), []
        for text, at in places.items():
            self.known.add_word(f" {text.decode('latin-1')} ", len(self.meaning))
            self.meaning.append((text.count(b" ") + 1, at))
        if self.meaning:
            self.known.make_automaton()

    def runs(self, words: list[bytes]) -> set[tuple[int, int, int]]:
        """(item, first word, end word) of every run of matching words."""
        line = f" {b' '.join(words).decode('latin-1')} "
        hits = list(self.known.iter(line)) if self.meaning else []
        if not hits:
            return set()
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        found: set[tuple[int, int, int]] = set()
        measured: dict[tuple[int, int], int] = {}  # up to which word each alignment of an item is measured
        for at, which in hits:
            length, places = self.meaning[which]
            end = int(np.searchsorted(gaps, at))
            for i, place in places:
                if place < 0:
                    found.add((i, end - length, end))
                    continue
                item, shift = self.words[i], end - length - place
                if measured.get((i, shift), -1) >= end:
                    continue
                first, last = end - length, end
                while first and first > shift and words[first - 1] == item[first - 1 - shift]:
                    first -= 1
                while last < len(words) and last - shift < len(item) and words[last] == item[last - shift]:
                    last += 1
                measured[i, shift] = last
                if last - first >= self.width:
                    found.add((i, first, last))
        return found

    def spans(self, raw: bytes, words: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """(item, first word, end word, begin, end): merged runs of an item; begin and end count code points."""
        runs = self.runs(words)
        if not runs:
            return []
        found: dict[str, list[list[int]]] = defaultdict(list)
        for i, first, end in sorted(runs, key=lambda r: r[1:]):
            for name in self.names[i]:
                merged = found[name]
                if merged and first < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([first, end])
        data = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
        edges = np.flatnonzero(np.diff(data, prepend=False, append=False))
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        return sorted((name, a, b, int(points[edges[2 * a]]), int(points[edges[2 * b - 1]])) for name, merged in found.items() for a, b in merged)


def _items(block: list[tuple[str, str]], width: int, key: int) -> Items:
    """A block's automaton; a worker holds one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(block, width)
    return _BUILT[key]


def _scanner(block, width: int, key: int, text_at: str, first: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(block.value, width, key)
        for batch in batches:
            for part, texts in slices(batch, text_at):
                counts, spans = [], []
                for raw in texts:
                    words = raw.translate(_NORMAL).split()
                    counts.append(len(words))
                    spans.append([dict(zip(_SPAN.names, s, strict=True)) for s in items.spans(raw, words)])
                if first:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN))], [*part.schema.names, "n_words", "spans"])
                else:
                    had = part.column(part.num_columns - 1).to_pylist()
                    spans = [(a or []) + b for a, b in zip(had, spans, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spans, pa.list_(_SPAN))], part.schema.names)

    return scan


def _item_blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.select(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = 1 + 2 * total // most if total > most else 1
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in part.collect()]


def benchmark_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """struct "row" (all columns of docs as they are), "n_words", and "spans" of benchmark windows in the text."""
    spark = docs.sparkSession
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    names = T.StructType(list(out.schema.fields))
    for b, block in enumerate(_item_blocks(items, item_col, item_text_col, item_bytes)):
        if b == 0:
            names = T.StructType([*names.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS)])
        elif b % CHAINED == 0:
            out = Scratch(spark, "spans").save(out, "spans")
        sent = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_scanner(sent, width, sent._jbroadcast.id() if sent._jbroadcast else b, "text", b == 0), names)
    return out.drop("text")


def n_hit(spans: Column) -> Column:
    """Words inside any span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first_word"].alias("a"), s["end_word"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["b"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("n"))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = benchmark_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, **more)
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return found.select(F.col("row.id").alias(id_col), "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def without_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns as they are."""
    return benchmark_spans(docs, items, text_col, **more).where(F.size("spans") == 0).select("row.*")
