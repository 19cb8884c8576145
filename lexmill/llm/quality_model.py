"""A text classifier of averaged subword embeddings, trained by stochastic gradient descent in numpy.

A word's features are the word, its character n-grams of 3 to 5 characters (with "<" and ">" around the word)
and the pair it makes with the word before, each hashed into one of BUCKETS learned vectors.  A text's vector is
the average over all features of all its words; a softmax over two outputs gives the score, the
probability of label 1.

Training reads at most TRAIN_TEXTS labelled texts of at most TRAIN_BYTES bytes in all, those with the smallest
hash of their id, whole, in one task; the driver sees their ids and sizes, and the model.  Scoring reads every text whole.  As the softmax of an average is linear, each
vector is first projected on the difference of the outputs, so that only BUCKETS numbers are sent out, and a
text costs one look-up for each distinct word of its chunk.

Labels, language, source and id are no inputs of a score.  Labels other than 0 and 1 are no labels.  Null, empty
and blank texts have the zero vector.
Repeated rows are scored each; a text that is labelled twice is trained on twice.  Without training rows of
both labels every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64, combine, mix, slices, word_hashes

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
TRAIN_TEXTS = 3000
TRAIN_BYTES = 16 << 20
EPOCHS = 8
LEAST_STEPS = 1500
BATCH = 16
RATE = 0.5
SEED = 1
THRESHOLD = 0.3


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def word_features(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each word's own feature and its n-grams."""
    spelled = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    points = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    of = np.repeat(np.arange(len(words)), lengths)
    values = mix(points.astype(U64))
    at, buckets = [np.arange(len(words))], [_bucket(mix(hashes))]
    for n in GRAMS:
        inside = of[: len(of) - n + 1] == of[n - 1 :]
        at.append(of[: len(of) - n + 1][inside])
        buckets.append(_bucket(combine(values, n)[inside]))
    return np.concatenate(at), np.concatenate(buckets)


def chunk_features(texts: list[bytes]):
    """Words of a chunk of texts: text of each word, its distinct word, (distinct word, bucket) pairs, and the bucket of each word pair."""
    hashes, counts = word_hashes(texts)
    distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    words = [w for t in texts for w in t.lower().split()]
    doc = np.repeat(np.arange(len(texts)), counts)
    at, buckets = word_features([words[i] for i in first], distinct) if len(distinct) else (np.empty(0, np.int64),) * 2
    starts = np.cumsum(counts) - counts
    pairs = np.ones(len(hashes), bool)
    pairs[starts[counts > 0]] = False
    second = np.flatnonzero(pairs)
    pair = _bucket(mix(mix(hashes[second - 1]) ^ hashes[second]))
    return doc, of, at, buckets, second, pair


def _all_rows(texts: list[bytes], at_once: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    return [r for i in range(0, len(texts), at_once) for r in _rows(texts[i : i + at_once])]


def _rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their weights, which add up to 1."""
    doc, of, at, buckets, second, pair = chunk_features(texts)
    order = np.argsort(at, kind="stable")
    at, buckets = at[order], buckets[order]
    begin = np.searchsorted(at, np.arange(of.max(initial=-1) + 2))
    out = []
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    cut = np.searchsorted(second, edges)
    for t in range(len(texts)):
        words, times = np.unique(of[edges[t] : edges[t + 1]], return_counts=True)
        found = [buckets[begin[w] : begin[w + 1]] for w in words] + [pair[cut[t] : cut[t + 1]]]
        weight = [np.full(begin[w + 1] - begin[w], n) for w, n in zip(words, times, strict=True)] + [np.ones(cut[t + 1] - cut[t])]
        ids, back = np.unique(np.concatenate(found), return_inverse=True)
        sums = np.bincount(back, np.concatenate(weight), len(ids))
        out.append((ids.astype(np.int32), (sums / max(sums.sum(), 1)).astype(np.float32)))
    return out


def train(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Each bucket's projection on the difference of the outputs, and the bias: a text's log odds are the weighted sum plus the bias."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    outputs, bias = np.zeros((2, DIM)), np.log(np.array([1 - share, share]))
    rows = _all_rows(texts)
    a_pass = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_pass))
    steps, done = epochs * a_pass, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            some = order[b : b + BATCH]
            ids = np.concatenate([rows[i][0] for i in some])
            weight = np.concatenate([rows[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            means = np.stack([np.bincount(of, weight * vectors[ids, d], len(some)) for d in range(DIM)], 1)
            logits = means @ outputs.T + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(some)), labels[some]] -= 1
            back = error @ outputs
            outputs -= rate * error.T @ means
            bias -= rate * error.mean(0)
            used, at = np.unique(ids, return_inverse=True)
            for d in range(DIM):
                vectors[used, d] -= rate * np.bincount(at, weight * back[of, d], len(used))
    difference = outputs[1] - outputs[0]
    return vectors @ difference, float(bias[1] - bias[0])


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                doc, of, at, buckets, second, pair = chunk_features(texts)
                size = int(of.max(initial=-1)) + 1
                value, many = np.bincount(at, table[buckets], size), np.bincount(at, minlength=size)
                total = np.bincount(doc, value[of], len(texts)) + np.bincount(doc[second], table[pair], len(texts))
                weight = np.bincount(doc, many[of], len(texts)) + np.bincount(doc[second], minlength=len(texts))
                odds = total / np.maximum(weight, 1) + bias
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-odds)))], ["id", "score"])

    return score


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [t or b"" for t in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    table, bias = train(texts, np.array(labels, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["buckets", "bias"])


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, texts: int = TRAIN_TEXTS, most: int = TRAIN_BYTES) -> DataFrame | None:
    """text, label of the bounded sample, by the hash of the id, without ids whose texts do not fit; the ids are chosen before any text is read.  None if there are no rows."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    sizes = docs.where(learn).select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"))
    sizes = sizes.join(known, "id").groupBy("id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("id"))
    chosen, room, left, after = set(), most, texts, F.lit(True)
    while left > 0 and (page := sizes.where(after & (F.col("size") <= room) & (F.col("n") <= left)).orderBy("h", "id").limit(texts).collect()):
        for r in page:
            if r["size"] <= room and r["n"] <= left:
                chosen.add((r["id"],))
                room, left = room - r["size"], left - r["n"]
        if len(page) < texts:
            break
        after = (F.col("h") > page[-1]["h"]) | ((F.col("h") == page[-1]["h"]) & (F.col("id") > page[-1]["id"]))
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame(sorted(chosen), "id long")
    return rows.join(F.broadcast(picked), "id").join(known, "id").select("id", "text", "label")


def fit(sample: DataFrame | None) -> tuple[np.ndarray, float]:
    if sample is None:
        return train([], np.empty(0, np.int64))
    ordered = sample.repartition(1).sortWithinPartitions("id", "label", "text").select("text", "label")
    row = ordered.mapInArrow(_trainer, "buckets binary, bias double").first()
    return np.frombuffer(row["buckets"], "<f8"), row["bias"]


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row a row of docs: id, score, predicted (1 from THRESHOLD); learning from the rows where learn holds."""
    model = fit(training_rows(docs, labels, learn, id_col, text_col, label_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(sent), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
