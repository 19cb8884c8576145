"""Token-id files compressed by a Re-Pair grammar per shard.

Texts are encoded by a public tokenizer, an end id is appended, and blocks of about BLOCK_TOKENS ids, in
ascending document order, become one row each of a Parquet data set (so that writing is committed by Spark
and works on any store).  A block holds

    rules      uint16 or uint32 pairs: rule r stands for the id FIRST + r
    expanded   uint32 per rule: how many ids it stands for
    symbols    uint16 or uint32: the documents' symbols, one document after another
    ends       uint32 per document: where its symbols end
    n_tokens   uint32 per document: how many ids it has

so that any document, or any range of its ids, is decoded from its own symbols and the rules alone.

Re-Pair runs in rounds.  A round counts adjacent pairs exactly, makes rules for those at most SPREAD times rarer
than the most frequent one, and replaces their occurrences that don't overlap; no pair crosses documents.  It ends
when no pair is left that occurs LEAST_COUNT times.  A pair that was once too rare stays so, as a replacement only
adds pairs with a new symbol; so later rounds count only pairs that are frequent or new.

Pieces of text are told apart by a hash, and by their bytes wherever a hash is met again.  Tokenizers whose
pre-tokenizer is not the byte-level one encode whole texts.

Null and empty texts are the end id alone.  Rows with a null id come first; rows of one id keep their order
in the input.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import BYTE_VALUE, U64, run_hashes, slices

END_ID = 2
BLOCK_TOKENS = 1 << 20
LEAST_COUNT = 24
SPREAD = 16
PIECES_HELD = 2_500_000
JOINED = 256
#: Slots, a power of two, that rule out rare pairs before the rest is sorted and counted exactly.
SLOTS = 1 << 17
BLOCK_SCHEMA = "shard int, block int, first long, symbol_bytes int, base int, ids array<long>, n_tokens binary, ends binary, rules binary, expanded binary, symbols binary, total long"

#: Bytes after a space at which the pre-tokenizer surely starts a token with that space: not white space, and no first byte of a character that may be.
_STARTS = np.ones(256, bool)
_STARTS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """Encodes texts piece by piece; a piece runs from one space that surely starts a token to the next.

    The byte-level pre-tokenizer starts a token at every such space, so pieces can be encoded apart and
    kept, or many at once: their ids are told apart by the bytes that each id stands for.  Pieces are looked
    up by a 64-bit hash and their length; distinct ones are encoded once while at most PIECES_HELD are held; beyond that, those met in one chunk only
    are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        added = self.model.get_added_tokens_decoder()
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.model.get_vocab().items():
            self.bytes_of[i] = len(token.encode()) if i in added else len(token)
        self.by_pieces = _byte_level(json.loads(self.model.to_str()))
        self._clear()

    def _clear(self) -> None:
        #: Sorted hashes of the pieces held, and for each its row in start, count, length and at.
        self.known, self.row = np.empty(0, U64), np.empty(0, np.int64)
        self.start, self.count, self.length, self.seen, self.at = (np.empty(0, np.int64) for _ in range(5))
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.raw, self.filled = np.empty(1 << 16, np.uint8), 0

    def _forget(self) -> None:
        """Keeps the pieces that came up in two chunks or more, if they are few enough to leave room."""
        kept = self.seen > 1
        if 2 * kept.sum() > PIECES_HELD:
            self._clear()
            return
        flat, raw = take_runs(self.flat, self.start[kept], self.count[kept]), take_runs(self.raw, self.at[kept], self.length[kept])
        place = np.cumsum(kept) - 1
        held = kept[self.row]
        self.known, self.row = self.known[held], place[self.row[held]]
        self.count, self.length, self.seen = self.count[kept], self.length[kept], self.seen[kept]
        self.start, self.at = np.cumsum(self.count) - self.count, np.cumsum(self.length) - self.length
        self.flat, self.used, self.raw, self.filled = flat, len(flat), raw, len(raw)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has.  Pieces with a space ahead are joined; a text's first piece is not."""
        texts, ends, last = [], [], ""
        for at in range(0, len(pieces), JOINED):
            for piece in pieces[at : at + JOINED]:
                if piece[:1] != b" " and last:
                    texts.append(last)
                    last = ""
                last += piece.decode()
            texts.append(last)
            last = ""
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1, prepend=0)

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids, counts = self._encoded(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.flat, self.raw = _roomy(self.flat, self.used + len(ids)), _roomy(self.raw, self.filled + int(lengths.sum()))
        self.flat[self.used : self.used + len(ids)] = ids
        self.raw[self.filled : self.filled + int(lengths.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        rows = len(self.start) + np.arange(len(pieces))
        self.start = np.concatenate([self.start, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.length = np.concatenate([self.length, lengths])
        self.at = np.concatenate([self.at, self.filled + np.cumsum(lengths) - lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int64)])
        self.used, self.filled = self.used + len(ids), self.filled + int(lengths.sum())
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, rows)

    def _rows(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct hashes, -1 for pieces that are not held."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        rows = self.row[at]
        return np.where((self.known[at] == hashes) & (self.length[rows] == lengths), rows, -1)

    def __call__(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has, its end id included."""
        ids, totals = (self._pieced(texts) if self.by_pieces else None) or self._whole(texts)
        if end is None:
            return ids, totals
        return np.insert(ids, np.cumsum(totals), np.uint32(end)), totals + 1

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32), np.fromiter((len(e.ids) for e in found), np.int64, len(texts))

    def _pieced(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """As __call__ without ends; None if two different pieces have one hash."""
        if len(self.start) > PIECES_HELD:
            self._forget()
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(sizes)
        opens = np.zeros(len(data) + 1, bool)
        opens[:-2][(data[:-1] == 32) & _STARTS[data[1:]]] = True
        opens[text_ends - sizes] = True
        starts = np.flatnonzero(opens[: len(data)])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes, first, of = np.unique(run_hashes(data, starts, ends, BYTE_VALUE), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        rows = self._rows(hashes, lengths)
        new = np.flatnonzero(rows < 0)
        if len(new):
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._add(hashes[new], [whole[a:b] for a, b in spans])
            rows = self._rows(hashes, lengths)
        if (rows < 0).any() or not self._same(data, starts, ends, first, of, rows):
            return None
        self.seen[rows] += 1
        row = rows[of]
        counts = self.count[row]
        ids = take_runs(self.flat, self.start[row], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[np.searchsorted(starts, text_ends)], prepend=0)

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, of: np.ndarray, rows: np.ndarray) -> bool:
        """Whether every piece has the bytes of the first one with its hash, and those the bytes that are held."""
        lengths = (ends - starts)[first]
        if not np.array_equal(lengths[of], ends - starts):
            return False
        return np.array_equal(take_runs(data, starts[first[of]], ends - starts), data) and np.array_equal(take_runs(data, starts[first], lengths), take_runs(self.raw, self.at[rows], lengths))


def _roomy(values: np.ndarray, n: int) -> np.ndarray:
    """values, or a copy at least twice as long if n don't fit."""
    return values if n <= len(values) else np.concatenate([values, np.empty(max(n - len(values), len(values)), values.dtype)])


def _byte_level(made: dict) -> bool:
    """Whether texts may be cut ahead of a space: no normaliser, the byte-level pre-tokenizer, and no added token that takes in spaces."""
    ahead = made.get("pre_tokenizer") or {}
    plain = not made.get("normalizer") and ahead.get("type") == "ByteLevel" and ahead.get("use_regex", True) and not ahead.get("add_prefix_space")
    return plain and not made["model"].get("dropout") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens", []))


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each s and n, joined."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    at = np.ones(ends[-1], np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    at[0] = s[0]
    at[np.cumsum(n)[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return values[np.cumsum(at)]


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(33 - SLOTS.bit_length())


def _places(pairs: np.ndarray, keys: np.ndarray, home: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Each key's row in the sorted pairs, -1 without one; home and slot: the slots of both.  A pair that shares its slot with a later one is found by bisection."""
    row = np.arange(len(pairs), dtype=np.int32)
    table = np.full(SLOTS, -1, np.int32)
    table[home] = row
    of = table[slot]
    of[pairs[of] != keys] = -1
    shared = np.zeros(SLOTS, bool)
    shared[home[table[home] != row]] = True
    left = np.flatnonzero(shared[slot] & (of < 0))
    at = np.minimum(np.searchsorted(pairs, keys[left]), len(pairs) - 1)
    of[left] = np.where(pairs[at] == keys[left], at, -1)
    return of


def repair(ids: np.ndarray, counts: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expanded, symbols, ends) of a block; a rule's id is base plus its row.  rounds: None until no pair occurs least times."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    live = ~last  # where a pair begins that may be frequent
    rules: list[np.ndarray] = []
    size, made, done = np.ones(base, np.uint32), 0, 0
    while rounds is None or done < rounds:
        done += 1
        at = np.flatnonzero(live)
        slot = _slots(symbols[at], symbols[at + 1])
        fits = np.bincount(slot, minlength=SLOTS)[slot] >= least
        live[at[~fits]] = False
        at, slot = at[fits], slot[fits]
        key_type, bits = (np.uint32, 16) if base + made <= 1 << 16 else (np.uint64, 32)
        keys = (symbols[at].astype(key_type) << key_type(bits)) | symbols[at + 1]
        found = np.sort(keys)
        begin = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
        n = np.diff(begin, append=len(found))
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        pairs, n = found[begin[often]], n[often]
        mask = key_type((1 << bits) - 1)
        of = _places(pairs, keys, _slots((pairs >> key_type(bits)).astype(np.uint32), (pairs & mask).astype(np.uint32)), slot)
        same = of >= 0
        live[at[~same]] = False
        at, of = at[same], of[same]
        # The rank of each pair that is replaced now, most frequent first.
        order = np.argsort(-n, kind="stable")
        order = order[n[order] >= n[order[0]] // SPREAD]
        rank = np.full(len(pairs), -1)
        rank[order] = np.arange(len(order))
        of = rank[of]
        at, of = at[of >= 0], of[of >= 0]
        # Of two occurrences that overlap the more frequent pair's stays; in a run of one pair, every other.
        joined = np.diff(at, prepend=-2) == 1
        same = joined & (np.diff(of, prepend=-1) == 0)
        place = np.arange(len(at))
        begun = np.maximum.accumulate(np.where(same, 0, place))
        weight = 2 * of + (place - begun) % 2
        keep = np.ones(len(at), bool)
        keep[1:] &= ~joined[1:] | (weight[1:] < weight[:-1])
        keep[:-1] &= ~joined[1:] | (weight[:-1] < weight[1:])
        at, of = at[keep], of[keep]
        used = np.flatnonzero(np.bincount(of, minlength=len(order)))
        new = np.empty(len(order), np.int64)
        new[used] = np.arange(len(used))
        pair = pairs[order[used]]
        rules.append(np.stack([pair >> key_type(bits), pair & mask], 1).astype(np.uint32))
        size = np.concatenate([size, size[rules[-1][:, 0]] + size[rules[-1][:, 1]]])
        symbols[at] = (base + made + new[of]).astype(np.uint32)
        last[at] = last[at + 1]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        live &= ~last
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last, live = symbols[stay], last[stay], live[stay]
        made += len(used)
    rule = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    ends = np.zeros(len(counts), np.uint32)
    ends[counts > 0] = np.flatnonzero(last) + 1
    return rule, size[base : base + made], symbols, np.maximum.accumulate(ends)


class Block:
    """Random access to one row of the data set."""

    def __init__(self, row: dict):
        kind = np.dtype(f"<u{row['symbol_bytes']}")
        self.base, self.ids = row["base"], row["ids"]
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
        self.expanded = np.frombuffer(row["expanded"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], kind)
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.n_tokens = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
        self._flat: np.ndarray | None = None

    def _tables(self) -> None:
        """Every symbol's expansion, side by side: rules in turns, each after the two symbols that it stands for."""
        self.starts = np.concatenate([np.arange(self.base), np.full(len(self.rules), -1)])
        self.lengths = np.concatenate([np.ones(self.base, np.int64), self.expanded])
        flat, left = np.arange(self.base, dtype=np.uint32), np.arange(len(self.rules))
        while len(left):
            ready = (self.starts[self.rules[left]] >= 0).all(1)
            now, left = left[ready], left[~ready]
            pair = self.rules[now].reshape(-1)
            made = take_runs(flat, self.starts[pair], self.lengths[pair])
            sizes = self.expanded[now]
            self.starts[self.base + now] = len(flat) + np.cumsum(sizes) - sizes
            flat = np.concatenate([flat, made])
        self._flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._tables()
        symbols = symbols.astype(np.int64)
        return take_runs(self._flat, self.starts[symbols], self.lengths[symbols])

    def document(self, j: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[j - 1] if j else 0 : self.ends[j]])

    def part(self, j: int, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of document j; only the symbols that cover them are expanded."""
        own = self.symbols[self.ends[j - 1] if j else 0 : self.ends[j]].astype(np.int64)
        sizes = np.where(own >= self.base, self.expanded[np.maximum(own - self.base, 0)] if len(self.expanded) else 1, 1)
        upto = np.cumsum(sizes)
        a, b = int(np.searchsorted(upto, begin, side="right")), int(np.searchsorted(upto, end, side="left")) + 1
        skipped = int(upto[a - 1]) if a else 0
        return self.expand(own[a:b])[begin - skipped : end - skipped]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(path: str, end: int | None, block_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = _encoder(path), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        schema = None

        def flush() -> pa.RecordBatch:
            ids, n = np.concatenate(held), np.concatenate(counts)
            rules, expanded, symbols, ends = repair(ids, n, encode.size)
            width = 2 if encode.size + len(rules) <= 1 << 16 else 4
            row = {"shard": shard, "block": block, "first": names[0], "symbol_bytes": width, "base": encode.size, "ids": list(names), "n_tokens": n.astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "expanded": expanded.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(), "total": len(ids)}
            names.clear(), held.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("symbol_bytes", pa.int32()), ("base", pa.int32()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("n_tokens", "ends", "rules", "expanded", "symbols")], ("total", pa.int64())])
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, n = encode(texts, end)
                names += part.column(0).to_pylist()
                held.append(ids)
                counts.append(n)
                if sum(map(len, held)) >= block_tokens:
                    yield flush()
                    block += 1
        if names:
            yield flush()

    return write


def write_tokens(docs: DataFrame, target: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order: list | None = None, end: int | None = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the data set at target, documents in ascending id order (or by the given columns)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order or [F.col(id_col)])], F.monotonically_increasing_id().alias("at"))
    keys = [c for c in rows.columns if c not in ("id", "text")]
    parted = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    parted.mapInArrow(_writer(tokenizer, end, block_tokens), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(target)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            block = Block(row)
            ids = block.expand(block.symbols).astype("<u4")
            ends = np.cumsum(block.n_tokens)
            begun = ends - block.n_tokens
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begun.tolist(), ends.tolist(), strict=True)]
            n = len(block.ids)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(block.ids, pa.int64()), pa.array(begun, pa.int64()), pa.array(block.n_tokens, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.diff(block.ends, prepend=0), pa.int64())], ["shard", "block", "id", "begun", "n_tokens", "ids_crc32", "n_symbols"])


def read_digests(spark: SparkSession, target: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32, n_symbols (its length in the grammar)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(target)
    totals = blocks.select("shard", "block", "total")
    shards = totals.groupBy("shard").agg(F.sum("total").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("ahead"))
    within = totals.select("shard", "block", (F.sum("total").over(Window.partitionBy("shard").orderBy("block")) - F.col("total")).alias("inside"))
    offsets = within.join(before, "shard").select("shard", "block", (F.col("ahead") + F.col("inside")).alias("offset"))
    rows = blocks.mapInArrow(_reader, "shard int, block int, id long, begun long, n_tokens long, ids_crc32 long, n_symbols long")
    return rows.join(offsets, ["shard", "block"]).select(F.col("id").alias(id_col), (F.col("offset") + F.col("begun")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order: list | None = None, **more) -> DataFrame:
    """Writes the data set into the shared folder and reads it back."""
    target = Scratch(docs.sparkSession, "tokens").path("blocks")
    write_tokens(docs, target, tokenizer, id_col, text_col, order, **more)
    return read_digests(docs.sparkSession, target, id_col)
