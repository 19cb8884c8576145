"""A Katz back-off n-gram model of the corpus, and the probability of every text under it.

Tokens are a text's words (A-Z lower-cased) and then one end; a begin mark stands ahead of the first token.  A
token's context is what precedes it, at most ORDER - 1 symbols, the begin mark included.  With c the training
counts, N the number of training tokens, d the Good-Turing discounts of an order, and h' the context h without
its first symbol,

    p(w)     = d c(w) / N             for words of the training texts; the mass left is that of unknown words
    p(w | h) = d c(h w) / c(h)        for n-grams of the training texts
    p(w | h) = a(h) p(w | h')         otherwise, a(h) = (1 - sum of the seen p(w | h)) / (1 - sum of their p(w | h'))

recursively, and a(h) = 1 for contexts that were never seen.  So the probabilities of all tokens, "unknown"
counting as one token, sum to 1 in every context.  Discounts follow Katz for counts up to MAX_DISCOUNTED; above
it 0.01 of a count is set aside, so that every context keeps mass for unseen words.  Where counts of counts are
too few for Good-Turing, fewer of them are discounted.

Counts live in tables that are partitioned by ranges of a hash of the n-gram or the context; the number of
partitions follows the number of tokens.  Texts are cut into blocks of up to BLOCK_WORDS words.  A block asks the
partitions for the counts of its distinct n-grams, as one packed row a partition, and gets packed answers; so an
n-gram crosses the network once a block, however frequent it is, and no partition holds a context's n-grams
together.  From three words on, a block asks only for n-grams whose first and last part both occur in other
blocks as well: the others are its own, and it counts them itself.  Of the blocks that ask for an n-gram one is
named its owner and reports it to its context, if any text that is not learnt from goes on after that context.
Reports are whole numbers, how many n-grams have each count, so a(h) is as exact as one division.

Null and empty texts are the end alone.  Rows that repeat an id are scored, and learnt from, each.
A null id counts as the empty text in the hash that splits training from held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import U64, mix, slices, word_hashes

ORDER = 3
BLOCK_WORDS = 3 << 19
#: Tokens of all texts to a partition of the tables.
PART_TOKENS = 4 << 20
MAX_DISCOUNTED = 5
SET_ASIDE = 0.01
END, BEGIN = (mix(np.array([x], U64))[0] for x in (1, 2))


def pack(values: np.ndarray) -> bytes:
    """Byte planes, then zstd: small and sorted values shrink."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=U64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the partitions begin in sorted keys: partition p holds the p-th of so many equal ranges of hashes."""
    bounds = np.array([(p << 64) // parts for p in range(parts)], U64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def discounts(n: list[int]) -> np.ndarray:
    """d for the counts 0..MAX_DISCOUNTED from the counts of counts n[1], n[2], ..; 0 stands for larger counts' place and is 1."""
    d = np.ones(MAX_DISCOUNTED + 1)
    for k in range(MAX_DISCOUNTED, 0, -1):
        if min(n[1 : k + 2]) > 0:
            common = (k + 1) * n[k + 1] / n[1]
            found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in found):
                d[1 : k + 1] = found
                return d
    d[1] = 0.5
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d c of each count."""
    out = np.maximum(counts - SET_ASIDE, 0)
    for r in range(1, MAX_DISCOUNTED + 1):
        if d[r] < 1:
            out[counts == r] = r * d[r]
    return out


def _blocks(block_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        hashes, lengths, ids, train = [], [], [], []

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            tokens = np.insert(np.concatenate(hashes), np.cumsum(n), END)
            words, seq, freq = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-freq, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            row = {"block": part + number, "tokens": len(tokens), "ids": list(ids), "lengths": pack((n + 1).astype("<u4")), "train": pack(np.array(train, np.uint8)), "words": pack_sorted(words), "rank": pack(rank), "seq": pack(rank[seq])}
            for x in (hashes, lengths, ids, train):
                x.clear()
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                found, n = word_hashes(texts)
                hashes.append(found)
                lengths.append(n)
                ids += piece.column(0).to_pylist()
                train += piece.column(2).to_pylist()
                if sum(map(len, hashes)) >= block_words:
                    yield flush()
                    number += 1
        if ids:
            yield flush()

    return cut


_BLOCK = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "train", "words", "rank", "seq")]])
BLOCK_SCHEMA = "block long, tokens long, ids array<long>, lengths binary, train binary, words binary, rank binary, seq binary"


@dataclass
class Level:
    """The distinct n-grams of a block for one n, in the order of their hashes."""

    keys: np.ndarray
    #: Each token's n-gram, -1 where there are too few symbols ahead.
    of: np.ndarray
    #: Each n-gram's first n - 1 symbols as a place in the level below (for pairs, len(words) is the begin mark), its last word, and its last n - 1 symbols.
    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    #: Counts in the block's training texts.
    local: np.ndarray


class Block:
    """Tokens of a block as places in its sorted words, and its n-grams."""

    def __init__(self, row: dict, order: int):
        self.number, self.ids = row["block"], row["ids"]
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.train = np.repeat(unpack(row["train"], "u1").astype(bool), self.lengths)
        self.words = unpack_sorted(row["words"])
        place = np.empty(len(self.words), np.int32)
        place[unpack(row["rank"], "<u4")] = np.arange(len(self.words), dtype=np.int32)
        self.tokens = place[unpack(row["seq"], "<u4")]
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        none = np.empty(0, np.int32)
        self.levels = [None, Level(self.words, self.tokens, none, none, none, np.bincount(self.tokens[self.train], minlength=len(self.words)).astype(np.int32))]
        for n in range(2, order + 1):
            self.levels.append(self._level(n))

    def contexts(self, n: int) -> np.ndarray:
        """Hashes of the contexts of n-grams."""
        return np.append(self.words, BEGIN) if n == 2 else self.levels[n - 1].keys

    def _level(self, n: int) -> Level:
        v, below = len(self.words), self.levels[n - 1]
        begins = np.cumsum(self.lengths) - self.lengths
        late = np.ones(len(self.tokens), bool)  # has n - 1 symbols ahead
        for k in range(n - 2):
            late[(begins + k)[self.lengths > k]] = False
        at = np.flatnonzero(late).astype(np.int32)
        before = below.of[at - 1].astype(np.int64)
        if n == 2:
            before[begins] = v
        before *= v
        before += self.tokens[at]
        by_gram = np.argsort(before)
        before = before[by_gram]
        new = np.diff(before, prepend=-1) != 0
        distinct, first = before[new], by_gram[new]
        del before
        inverse = np.empty(len(at), np.int32)
        inverse[by_gram] = np.cumsum(new, dtype=np.int32) - 1
        del by_gram, new
        context, word = (distinct // v).astype(np.int32), (distinct % v).astype(np.int32)
        del distinct
        hashed = mix(mix(self.contexts(n)[context]) ^ self.words[word])
        order = np.argsort(hashed)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        of = np.full(len(self.tokens), -1, np.int32)
        of[at] = back[inverse]
        return Level(hashed[order], of, context[order], word[order], below.of[at[first]][order], np.bincount(of[at][self.train[at]], minlength=len(order)).astype(np.int32))


def _stats(counts: np.ndarray) -> list[int]:
    """N, V, n1, n2, .. of counts."""
    few = np.bincount(counts[counts <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)
    return [int(counts.sum()), int((counts > 0).sum()), *map(int, few[1:])]


def _wanted(block: Block, n: int, many: np.ndarray | None) -> np.ndarray:
    """Which n-grams other blocks may hold; many: which (n - 1)-grams they hold, None if every n-gram is to be asked for."""
    level = block.levels[n]
    return np.ones(len(level.keys), bool) if many is None else many[level.context] & many[level.suffix]


def _answers(block: Block, n: int, rows: list[dict], many: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram: its count in all training texts, whether this block is its owner, whether other blocks hold it, whether it is a context in texts that are not learnt from."""
    asked = _wanted(block, n, many)
    told = np.concatenate([np.empty(0, np.int64), *(unpack(r["counts"], "<u8").astype(np.int64) for r in sorted((r for r in rows if r["level"] == n), key=lambda r: r["part"]))])
    counts, owner, others, open_ = block.levels[n].local.astype(np.int64), np.ones(len(asked), bool), np.zeros(len(asked), bool), np.ones(len(asked), bool)
    counts[asked], owner[asked], others[asked], open_[asked] = told >> 3, (told & 1).astype(bool), (told & 2).astype(bool), (told & 4).astype(bool)
    return counts, owner, others, open_


_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("open", pa.binary()), ("stats", pa.list_(pa.int64()))])
ASK_SCHEMA = "part int, block long, keys binary, counts binary, open binary, stats array<long>"


def _asked(block: Block, n: int, parts: int, many: np.ndarray | None) -> Iterator[dict]:
    """One row a partition: the n-grams asked for, their counts in the block's training texts, and whether they are contexts in its other texts; the first row also has the stats of those that are not asked for."""
    level, wanted = block.levels[n], _wanted(block, n, many)
    after = ~block.train
    after[np.cumsum(block.lengths) - block.lengths] = False
    before = level.of[np.flatnonzero(after) - 1]
    open_ = np.zeros(len(level.keys), bool)
    open_[before[before >= 0]] = True
    keys, counts, open_ = level.keys[wanted], level.local[wanted].astype("<u4"), open_[wanted]
    at = cuts(keys, parts)
    own = _stats(level.local[~wanted])
    for p in [p for p in range(parts) if at[p] < at[p + 1]] or [block.number % parts]:
        yield {"part": p, "block": block.number, "keys": pack_sorted(keys[at[p] : at[p + 1]]), "counts": pack(counts[at[p] : at[p + 1]]), "open": pack(np.packbits(open_[at[p] : at[p + 1]])), "stats": own}
        own = None


def _asks(n: int, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(list(_asked(Block(batch.slice(i, 1).to_pylist()[0], n), n, parts, None)), _ASK)

    return ask


def _asks_told(n: int, parts: int):
    """As _asks, for blocks that know the answers to shorter n-grams."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block, rows, many = Block(left.to_pylist()[0], n), right.to_pylist(), None
        for k in range(2, n):
            many = _answers(block, k, rows, many)[2]
        return pa.Table.from_pylist(list(_asked(block, n, parts, many)), _ASK)

    return ask


_TOLD = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])
TOLD_SCHEMA = "kind int, part int, block long, keys binary, counts binary, stats array<long>"
TABLE, ANSWER = 0, 1


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one partition of the tables after another; a task's rows are sorted by part and block."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and held[0]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tell(keep: bool):
    """Per partition its table (kind TABLE: stats, and keys and counts if they are kept) and its answers (kind ANSWER: 8 c + 4 for open contexts + 2 if several blocks ask + 1 for the owner)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            keys = [unpack_sorted(r["keys"]) for r in rows]
            table, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            counts = np.bincount(of, np.concatenate([unpack(r["counts"], "<u4") for r in rows]), len(table)).astype(np.int64)
            open_ = np.concatenate([np.unpackbits(unpack(r["open"], "u1"), count=len(k)) for r, k in zip(rows, keys, strict=True)])
            told = 8 * counts[of] + 4 * (np.bincount(of, open_, len(table)) > 0)[of] + 2 * (np.bincount(of, minlength=len(table)) > 1)[of]
            told[first] += 1
            told, ends = told.astype("<u8"), np.cumsum([len(k) for k in keys])
            stats = np.sum([_stats(counts), *(r["stats"] for r in rows if r["stats"])], 0).tolist()
            seen = counts > 0
            yield pa.RecordBatch.from_pylist([{"kind": TABLE, "part": rows[0]["part"], "block": None, "keys": pack_sorted(table[seen]) if keep else None, "counts": pack(counts[seen].astype("<u8")) if keep else None, "stats": stats}], _TOLD)
            for r, a, b in zip(rows, ends - [len(k) for k in keys], ends, strict=True):
                yield pa.RecordBatch.from_pylist([{"kind": ANSWER, "part": r["part"], "block": r["block"], "keys": None, "counts": pack(told[a:b]), "stats": None}], _TOLD)

    return tell


def _sorted_parts(rows: DataFrame, parts: int, work: Callable, schema: str) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(work, schema)


def _totals(told: DataFrame) -> list[int]:
    """N, V, n1, n2, .. over all partitions."""
    width = MAX_DISCOUNTED + 3
    row = told.where(F.col("kind") == TABLE).agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(width)]).first()
    return [int(x or 0) for x in row]


_SUMS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("small", pa.binary()), ("large", pa.binary()), ("asked", pa.binary()), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("missing", pa.binary())])
SUMS_SCHEMA = "kind int, part int, block long, level int, keys binary, small binary, large binary, asked binary, ids array<long>, numbers binary, missing binary"


_R = np.arange(1, MAX_DISCOUNTED + 1)


def _tallies(context: np.ndarray, counts: np.ndarray, below: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context, of n-grams with these counts, whose last n - 1 symbols have the counts below: how many have the counts 1, 2, .. and more, the same of the counts below; and the sums of the counts that are more."""
    small, large = np.empty((2 * MAX_DISCOUNTED + 2, size), "<u4"), np.empty((2, size), "<u8")
    for i, c in enumerate((counts, below)):
        for r in range(1, MAX_DISCOUNTED + 2):
            small[i * (MAX_DISCOUNTED + 1) + r - 1] = np.bincount(context[np.minimum(c, MAX_DISCOUNTED + 1) == r], minlength=size)
        large[i] = np.bincount(context[c > MAX_DISCOUNTED], c[c > MAX_DISCOUNTED], size)
    return small, large


def _weight(small: np.ndarray, large: np.ndarray, total: np.ndarray, d: np.ndarray, d_below: np.ndarray) -> np.ndarray:
    """log10 a(h) from a context's tallies; total: what the counts below are shares of."""
    k, n, m = MAX_DISCOUNTED, small[: MAX_DISCOUNTED + 1].astype(float), small[MAX_DISCOUNTED + 1 :].astype(float)
    aside = (_R - discounted(_R, d)) @ n[:k] + SET_ASIDE * n[k]
    lower = discounted(_R, d_below) @ m[:k] + large[1] - SET_ASIDE * m[k]
    one_less_seen = aside / np.maximum(_R @ n[:k] + large[0], 1)
    return np.log10(np.maximum(one_less_seen, 1e-300) / np.maximum(1 - lower / np.maximum(total, 1), 1e-300))


def _scorer(order: int, parts: int, totals: list[list[int]], ds: list[np.ndarray], prune: bool):
    """totals and ds: of each n from 1."""
    n, v = totals[0][:2]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per block: documents' sums but for log a(h) of contexts that other blocks hold, and its shares of and requests for those contexts' sums."""
        block, rows = Block(left.to_pylist()[0], order), right.to_pylist()
        word, _, others, open_ = _answers(block, 1, rows, None)
        unknown = 1 - unknown_free(totals[0], ds[0])
        single = np.log10(np.where(word > 0, discounted(word, ds[0]) / max(n, 1), unknown))
        add = lambda x, at=None: np.bincount(block.doc if at is None else block.doc[at], x if at is None else x[at], len(block.lengths))
        known, base = add((word > 0)[block.tokens]), add(np.log10((word + 0.5) / (n + 0.5 * (v + 1)))[block.tokens])
        seen_by = np.append(word, word[np.searchsorted(block.words, END)])  # how often each context was seen
        shared = np.append(others, True) | (not prune)  # whether other blocks hold a context
        told = np.append(open_, True) | (not prune)  # whether any block may ask for it
        total = np.full(len(seen_by), n)  # what counts are shares of one level below
        levels, asking, out, below = [], None, [], word
        for k in range(2, order + 1):
            level = block.levels[k]
            counts, owner, others, open_ = _answers(block, k, rows, asking)
            above = discounted(counts, ds[k - 1]) / np.maximum(seen_by[level.context], 1)
            needed = shared & told  # contexts whose tallies are reported, or used here
            needed[level.context[counts == 0]] = True
            place = np.cumsum(needed, dtype=np.int32) - 1
            mine = np.flatnonzero(owner & (counts > 0) & needed[level.context])
            tallies = _tallies(place[level.context[mine]], counts[mine], below[level.suffix[mine]], int(needed.sum()))
            levels.append((k, level, counts, above, seen_by, shared, shared & told, total, needed, place, *tallies))
            del mine, owner
            total = (word if k == 2 else levels[-2][2])[level.suffix]
            asking, below, seen_by, shared, told = (others if prune else None), counts, counts, others | (not prune), open_ | (not prune)
        value, rest, missing, wants = np.zeros(len(block.tokens)), np.ones(len(block.tokens), bool), [], {}
        for k, level, counts, above, seen_by, shared, _, total, _, place, small, large in reversed(levels):
            at = np.flatnonzero(rest & (level.of >= 0))
            gram = level.of[at]
            found = counts[gram] > 0
            value[at[found]] += np.log10(above[gram[found]])
            rest[at[found]] = False
            at, context = at[~found], level.context[gram[~found]]
            at, context = at[seen_by[context] > 0], context[seen_by[context] > 0]
            away = shared[context]
            own, of = np.unique(context[~away], return_inverse=True)
            value[at[~away]] += _weight(small[:, place[own]], large[:, place[own]], total[own], ds[k - 1], ds[k - 2])[of]
            wants[k] = (at[away], context[away])
        value[rest] += single[block.tokens[rest]]

        begun = 0
        for k, _, _, _, _, shared, reported, total, needed, place, small, large in levels:
            at, context = wants[k]
            asked = np.zeros(len(shared), bool)
            asked[context] = True
            filled = asked.copy()
            filled[needed] |= (small[: MAX_DISCOUNTED + 1] > 0).any(0)
            hashes = block.contexts(k)
            order_ = np.argsort(hashes) if k == 2 else np.arange(len(hashes))
            used = order_[(reported & filled)[order_]]
            turn = np.full(len(hashes), -1)
            wanted = order_[asked[order_]]
            turn[wanted] = begun + np.arange(len(wanted))
            begun += len(wanted)
            missing.append(np.stack([block.doc[at], turn[context]], 1))
            bounds = cuts(hashes[used], parts)
            for p in range(parts):
                some = used[bounds[p] : bounds[p + 1]]
                if len(some):
                    out.append({"kind": TABLE, "part": p, "block": block.number, "level": k, "keys": pack_sorted(hashes[some]), "small": pack(small[:, place[some]].reshape(-1)), "large": pack(np.vstack([large[:, place[some]], total[some][None]]).astype("<u8").reshape(-1)), "asked": pack(asked[some].astype(np.uint8))})
        numbers = np.stack([block.lengths, known, base, add(value)], 1).astype("<f8")
        missing = np.concatenate([np.empty((0, 2), np.int64), *missing]).astype("<u4")
        out.append({"kind": ANSWER, "part": None, "block": block.number, "ids": block.ids, "numbers": pack(numbers.reshape(-1)), "missing": pack(missing.reshape(-1))})
        return pa.Table.from_pylist(out, _SUMS)

    return score


def unknown_free(total: list[int], d: np.ndarray) -> float:
    """The mass of all known words: 1 less what discounts set aside."""
    n, v, *few = total
    if not n:
        return 0.0
    low = [r for r in range(1, MAX_DISCOUNTED + 1) if d[r] < 1]
    aside = sum((1 - d[r]) * r * few[r - 1] for r in low) + SET_ASIDE * (v - sum(few[r - 1] for r in low))
    return 1 - aside / n


_WEIGHT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("weights", pa.binary())])
WEIGHT_SCHEMA = "kind int, part int, block long, level int, keys binary, weights binary"


def _weights(keep: bool, ds: list[np.ndarray]):
    """Per partition log10 a(h) of the contexts that each block asked for (kind ANSWER), and of all if they are kept (kind TABLE)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _by_part(batches):
            for n in sorted({r["level"] for r in every}):
                rows = [r for r in every if r["level"] == n]
                keys = [unpack_sorted(r["keys"]) for r in rows]
                table, of = np.unique(np.concatenate(keys), return_inverse=True)
                whole = lambda c, kind, lines: np.concatenate([unpack(r[c], kind).reshape(lines, -1) for r in rows], 1)  # noqa: E731, B023
                small, large = whole("small", "<u4", 2 * MAX_DISCOUNTED + 2), whole("large", "<u8", 3)
                total = np.zeros(len(table))
                np.maximum.at(total, of, large[2].astype(float))
                added = lambda x: np.stack([np.bincount(of, line, len(table)) for line in x])  # noqa: E731, B023
                weight = _weight(added(small), added(large[:2]), total, ds[n - 1], ds[n - 2])
                if keep:
                    yield pa.RecordBatch.from_pylist([{"kind": TABLE, "part": rows[0]["part"], "block": None, "level": n, "keys": pack_sorted(table), "weights": pack(weight.astype("<f8"))}], _WEIGHT)
                begun = 0
                for r, k in zip(rows, keys, strict=True):
                    asked = unpack(r["asked"], "u1").astype(bool)
                    yield pa.RecordBatch.from_pylist([{"kind": ANSWER, "part": r["part"], "block": r["block"], "level": n, "keys": None, "weights": pack(weight[of[begun : begun + len(k)]][asked].astype("<f8"))}], _WEIGHT)
                    begun += len(k)

    return weigh


def _finisher(n: int):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = sorted(right.to_pylist(), key=lambda r: (r["level"], r["part"]))
        weight = np.concatenate([unpack(r["weights"], "<f8") for r in answers] or [np.empty(0)])
        numbers = unpack(row["numbers"], "<f8").reshape(-1, 4)
        doc, at = unpack(row["missing"], "<u4").reshape(-1, 2).T
        score = numbers[:, 3] + np.bincount(doc, weight[at], len(numbers))
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "n_tokens": numbers[:, 0].astype(np.int64), "n_known": numbers[:, 1].astype(np.int64), "train_tokens": pa.array([n] * len(numbers), pa.int64()), "base_score": numbers[:, 2], "score": score})

    return finish


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, parts: int | None = None, block_words: int = BLOCK_WORDS, keep: str | None = None) -> DataFrame:
    """One row a row of docs: id, n_tokens, n_known, train_tokens, base_score, score (log10), learning from the rows where train holds.

    order: the longest n-grams, 2 or more.  keep: a folder for the model's tables, which Model reads; then blocks ask for all of their n-grams."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    blocks = scratch.save(rows.mapInArrow(_blocks(block_words), BLOCK_SCHEMA), "blocks", "uncompressed")
    if not parts:
        parts = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // PART_TOKENS))
    prune, told = keep is None, []
    cogrouped = lambda answers, work, schema: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    answered = lambda of: union([t.where(F.col("kind") == ANSWER).select("block", "part", F.lit(n).alias("level"), "counts") for n, t in enumerate(told, 1) if n in of])
    for n in range(1, order + 1):
        asks = blocks.mapInArrow(_asks(n, parts), ASK_SCHEMA) if n < 3 or not prune else cogrouped(answered(range(2, n)), _asks_told(n, parts), ASK_SCHEMA)
        told.append(scratch.save(_sorted_parts(asks, parts, _tell(not prune), TOLD_SCHEMA), f"counts{n}"))
    totals = [_totals(t) for t in told]
    ds = [discounts([0, *t[2:]]) for t in totals]
    sums = scratch.save(cogrouped(answered(range(1, order + 1)), _scorer(order, parts, totals, ds, prune), SUMS_SCHEMA), "sums")
    scratch.drop(blocks)
    shares = sums.where(F.col("kind") == TABLE).select("part", "block", "level", "keys", "small", "large", "asked")
    weights = scratch.save(_sorted_parts(shares, parts, _weights(not prune, ds), WEIGHT_SCHEMA), "weights")
    if keep:
        stored = lambda made, level, column: made.where(F.col("kind") == TABLE).select(level.cast("int").alias("level"), "part", "keys", F.col(column).alias("values"))
        union([stored(t, F.lit(n), "counts") for n, t in enumerate(told, 1)]).write.parquet(f"{keep}/counts")
        stored(weights, F.col("level"), "weights").write.parquet(f"{keep}/weights")
        spark.createDataFrame([(parts, order, totals[0], [d.tolist() for d in ds])], "parts int, order int, total array<long>, ds array<array<double>>").write.parquet(f"{keep}/numbers")
    wanted = weights.where(F.col("kind") == ANSWER).select("block", "part", "level", "weights")
    done = sums.where(F.col("kind") == ANSWER).select("block", "ids", "numbers", "missing").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_finisher(totals[0][0]), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", id_col)


class Model:
    """The tables that scored(keep=..) wrote, for single look-ups: partitions are read as they are needed."""

    def __init__(self, spark: SparkSession, folder: str):
        read = spark.read.parquet
        self.tables = {t: read(f"{folder}/{t}") for t in ("counts", "weights")}
        numbers = read(f"{folder}/numbers").first()
        self.parts, self.order, self.total = numbers["parts"], numbers["order"], list(numbers["total"])
        self.ds = [np.array(d) for d in numbers["ds"]]
        self.unknown = 1 - unknown_free(self.total, self.ds[0])
        self._held: dict = {}

    def _value(self, table: str, level: int, key: np.uint64, kind: str) -> float | None:
        part = int(key) * self.parts >> 64
        if (table, level, part) not in self._held:
            row = self.tables[table].where((F.col("level") == level) & (F.col("part") == part)).first()
            self._held[table, level, part] = (unpack_sorted(row["keys"]), unpack(row["values"], kind)) if row else (np.empty(0, U64), np.empty(0))
        keys, values = self._held[table, level, part]
        at = int(np.searchsorted(keys, key))
        return float(values[at]) if at < len(keys) and keys[at] == key else None

    def tokens(self, text: str) -> list[np.uint64]:
        return [*word_hashes([text.encode()])[0], END]

    @staticmethod
    def _hash(gram: tuple) -> np.uint64:
        key = gram[0]
        for word in gram[1:]:
            key = mix(mix(np.array([key])) ^ np.array([word]))[0]
        return key

    def _count(self, gram: tuple) -> int:
        """Training count of an n-gram; the begin mark's is that of the ends."""
        return int(self._value("counts", len(gram), self._hash(gram if gram != (BEGIN,) else (END,)), "<u8") or 0)

    def probability(self, context: tuple, token: np.uint64) -> float:
        """p(token | context), through the longest n-gram that was seen."""
        n = len(context) + 1
        count = self._count((*context, token))
        if n == 1:
            return float(discounted(np.array([count]), self.ds[0])[0]) / self.total[0] if count else self.unknown
        if count:
            return float(discounted(np.array([count]), self.ds[n - 1])[0]) / self._count(context)
        weight = self._value("weights", n, self._hash(context), "<f8")
        return (10**weight if weight is not None else 1.0) * self.probability(context[1:], token)

    def score(self, text: str) -> float:
        """log10 probability of a text and its end."""
        symbols = (BEGIN, *self.tokens(text))
        return float(sum(np.log10(self.probability(symbols[max(0, i - self.order + 1) : i], symbols[i])) for i in range(1, len(symbols))))
