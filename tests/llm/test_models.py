import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality_model
from lexmill.llm.ngram_lm import SET_ASIDE, Model, discounts, pack, pack_sorted, scored, unpack, unpack_sorted
from lexmill.llm.quality_model import quality_scores, training_rows, word_features
from lexmill.llm.tables import remainder
from lexmill.llm.words import U64, combine, mix, word_hashes

from .conftest import text


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


class Katz:
    """The same model by plain counting, recursively over all orders."""

    def __init__(self, texts, order=3):
        self.order, self.c, self.after = order, [None, *(Counter() for _ in range(order))], defaultdict(set)
        for t in texts:
            symbols = ("<s>", *self.tokens(t))
            for i in range(1, len(symbols)):
                for n in range(1, min(order, i + 1) + 1):
                    gram = symbols[i - n + 1 : i + 1]
                    self.c[n][gram] += 1
                    self.after[gram[:-1]].add(gram[-1])
        self.n = sum(self.c[1].values())
        self.d = [None, *(discounts([0, *[sum(v == r for v in self.c[n].values()) for r in range(1, 7)]]) for n in range(1, order + 1))]
        self.known = sum(self.less(1, x) for x in self.c[1].values()) / max(self.n, 1)
        self.a = {}
        for h, ws in self.after.items():
            if h:
                self.a[h] = (1 - sum(self.p(h, w) for w in ws)) / (1 - sum(self.p(h[1:], w) for w in ws))

    @staticmethod
    def tokens(t):
        return [*(t or "").encode().lower().split(), "</s>"]

    def less(self, n, c):
        return c * self.d[n][c] if c <= 5 and self.d[n][c] < 1 else c - SET_ASIDE

    def p(self, h, w):
        n = len(h) + 1
        c = self.c[n][*h, w]
        if n == 1:
            return self.less(1, c) / self.n if c else 1 - self.known
        if c:
            return self.less(n, c) / (self.c[1]["</s>",] if h == ("<s>",) else self.c[n - 1][h])
        return self.a.get(h, 1.0) * self.p(h[1:], w)

    def score(self, t):
        symbols = ("<s>", *self.tokens(t))
        return sum(math.log10(self.p(symbols[max(0, i - self.order + 1) : i], symbols[i])) for i in range(1, len(symbols)))

    def base(self, t):
        return sum(math.log10((self.c[1][w,] + 0.5) / (self.n + 0.5 * (len(self.c[1]) + 1))) for w in self.tokens(t))


@pytest.mark.parametrize(("order", "parts", "block_words"), [(3, None, 1 << 20), (3, 7, 500), (4, 3, 2000), (2, 5, 500)])
def test_scores_against_plain_counting(docs, rows, order, parts, block_words):
    model = Katz([r[1] for r in rows if held(r[0]) != 1], order)
    got = scored(docs, remainder() != 1, order=order, parts=parts, block_words=block_words).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[5], 3))
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    expected = sorted(((r[0], len(model.tokens(r[1])), sum(model.c[1][w,] > 0 for w in model.tokens(r[1])), model.n, model.base(r[1]), model.score(r[1])) for r in rows), key=key)
    assert [x[:4] for x in found] == [x[:4] for x in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_kept_model_scores_the_same(spark, make, rows, tmp_path):
    some = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] < 12 or r[0] in (300, 303)]
    got = {r["doc_id"]: r["score"] for r in scored(make(some), remainder() != 1, parts=3, keep=str(tmp_path)).collect()}
    model = Model(spark, str(tmp_path))
    for i, t in some:
        if len(t or "") < 600:
            assert model.score(t or "") == pytest.approx(got[i], rel=1e-9)


def test_probabilities_add_up(rows):
    model = Katz([r[1] for r in rows])
    vocabulary = [*(w for (w,) in model.c[1]), "unknown"]
    for h in [*list(model.a)[:25], *[h for h in model.a if len(h) == 1][:15], ("never", "seen")]:
        assert sum(model.p(h, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_no_training_rows(make, no_docs):
    got = scored(make([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in sorted(got)] == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert scored(no_docs, F.lit(True)).collect() == []


def test_discounts():
    d = discounts([0, 1000, 400, 200, 120, 80, 55])
    assert all(0 < x < 1 for x in d[1:]) and d[0] == 1
    assert discounts([0, 3, 0, 0, 0, 0, 0]).tolist() == [1, 0.5, 1, 1, 1, 1]


def test_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(U64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all()
    assert unpack(pack(np.array([1.5, -2.0])), "<f8").tolist() == [1.5, -2.0]
    assert len(unpack(pack(np.empty(0, "<u4")), "<u4")) == 0


def labelled(spark, make):
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = text(i, 40) if good else (text(i, 40).replace(" ", " ### ") if i % 2 else "again " * 60)
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return make([*rows, (900, None), (901, ""), (None, "x y")]), spark.createDataFrame([*labels, (5000, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int"), dict(x[:2] for x in labels)


def test_held_out_accuracy(spark, make):
    docs, labels, truth = labelled(spark, make)
    got = {r["doc_id"]: r for r in quality_scores(docs, labels, remainder() != 0).collect()}
    assert len(got) == 303
    out = [i for i in truth if held(i) == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality_model.THRESHOLD) for r in got.values())


def test_only_training_labels_count(spark, make):
    """Turning the held-out labels round changes no score."""
    docs, labels, _ = labelled(spark, make)
    turned = labels.withColumn("quality", F.when(remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(quality_scores(docs, x, remainder() != 0).collect(), key=str) for x in (labels, turned))
    assert one == two


def test_without_labels(spark, make, no_docs):
    docs, labels, _ = labelled(spark, make)
    assert {r["score"] for r in quality_scores(docs, labels.limit(0), remainder() != 0).collect()} == {0.5}
    ones = {r["score"] for r in quality_scores(docs, labels.where("quality = 1"), remainder() != 0).collect()}
    assert len(ones) == 1 and ones.pop() > 0.99
    assert quality_scores(no_docs, labels, remainder() != 0).collect() == []


def test_word_features():
    at, buckets = word_features(["aé".encode(), b"b"], np.array([1, 2], U64))
    # the words; 3-grams <aé aé> <b>; the 4-gram <aé>
    assert np.bincount(at).tolist() == [4, 2] and (buckets < quality_model.BUCKETS).all()


def test_sample_leaves_out_texts_that_do_not_fit(spark, make):
    """Whichever ids come first in hash order, the long texts don't end the sample."""
    docs = make([(i, "x" * (500 if i < 10 else 10)) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for texts, expected in [(20, 10), (4, 4)]:
        got = training_rows(docs, labels, F.lit(True), "doc_id", "text", "quality", texts=texts, most=100).collect()
        assert len(got) == expected and all(r["id"] >= 10 for r in got)


def test_labels_other_than_0_and_1_are_none(spark, make):
    docs, labels, _ = labelled(spark, make)
    odd = spark.createDataFrame([(i, q, 0) for i in range(300, 400) for q in (2, -1)] + [(i, 7, 0) for i in range(0, 300, 5)], "doc_id long, quality int, toxic int")
    more = make([(i, "odd " * 50) for i in range(300, 400)])
    one, two = (sorted(quality_scores(docs, x, remainder() != 0).collect(), key=str) for x in (labels, labels.unionByName(odd)))
    assert one == two
    assert {r["score"] for r in quality_scores(more, odd, remainder() != 0).collect()} == {0.5}


def test_repeated_rows_long_texts_and_clashing_columns(spark, make):
    docs, labels, _ = labelled(spark, make)
    more = make([(1000, "word " * 200_000), (1001, "x" * 1_000_000), *[(1002, text(2, 40))] * 3])
    both = docs.unionByName(more)
    for name in ("id", "label", "score", "predicted", "quality", "size", "h"):
        both = both.withColumn(name, F.lit(name))
    got = quality_scores(both, labels, remainder() != 0).collect()
    assert len(got) == 303 + 5 and len({r["score"] for r in got if r["doc_id"] == 1002}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_features(t):
    """Bucket of every feature of a text, one by one."""
    words = t.encode().lower().split()
    hashes = [word_hashes([w])[0][0] for w in words]
    bucket = lambda h: int(h >> U64(64 - 17))
    out = []
    for k, (w, h) in enumerate(zip(words, hashes, strict=True)):
        out.append(bucket(mix(np.array([h]))[0]))
        points = mix(np.array([ord(c) for c in f"<{w.decode()}>"], U64))
        out += [bucket(combine(points[i : i + n], n)[0]) for n in (3, 4, 5) for i in range(len(points) - n + 1)]
        if k:
            out.append(bucket(mix(mix(np.array([hashes[k - 1]])) ^ h)[0]))
    return out


def test_training_against_a_plain_loop(monkeypatch):
    """The same model by loops over texts, features and outputs."""
    monkeypatch.setattr(quality_model, "LEAST_STEPS", 12)
    texts = [text(i, 12) if i % 2 else f"{text(i, 5)} again again Éa" for i in range(20)]
    labels = np.array([i % 2 for i in range(20)])
    table, bias = quality_model.train([t.encode() for t in texts], labels)
    dim, rng = quality_model.DIM, np.random.default_rng(quality_model.SEED)
    vectors = rng.uniform(-1 / dim, 1 / dim, (quality_model.BUCKETS, dim))
    out, b = np.zeros((2, dim)), np.log([0.5, 0.5])
    found = [plain_features(t) for t in texts]
    steps = max(quality_model.EPOCHS, 6) * 2
    done = 0
    for _ in range(steps // 2):
        order = rng.permutation(20)
        for some in (order[:16], order[16:]):
            rate = quality_model.RATE * (1 - done / steps)
            done += 1
            d_vectors, d_out, d_bias = {}, np.zeros((2, dim)), np.zeros(2)
            for i in some:
                mean = sum(vectors[f] for f in found[i]) / len(found[i])
                odds = np.exp(out @ mean + b)
                error = odds / odds.sum() - np.eye(2)[labels[i]]
                d_out += np.outer(error, mean)
                d_bias += error / len(some)
                for f in found[i]:
                    d_vectors[f] = d_vectors.get(f, 0) + error @ out / len(found[i])
            out, b = out - rate * d_out, b - rate * d_bias
            for f, d in d_vectors.items():
                vectors[f] = vectors[f] - rate * d
    assert np.allclose(table, vectors @ (out[1] - out[0]), atol=1e-5) and bias == pytest.approx(b[1] - b[0], abs=1e-5)


def test_tallies_of_a_block_take_little_memory():
    """Two blocks are scored beside each other on an executor: a context's tallies take their 64 bytes, and not much more while they are made."""
    import tracemalloc

    from lexmill.llm.ngram_lm import _tallies

    rng, size = np.random.default_rng(5), 200_000
    context, counts, below = rng.integers(0, size, 2 * size), rng.integers(1, 12, 2 * size), rng.integers(1, 12, 2 * size)
    tracemalloc.start()
    try:
        small, large = _tallies(context, counts, below, size)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150 * size
    assert small[2, 7] == ((context == 7) & (counts == 3)).sum() and small[:6].sum() == 2 * size and large[1].sum() == below[below > 5].sum()
