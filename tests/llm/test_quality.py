import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import quality_rules
from lexmill.llm.quality_rules import passing, quality
from lexmill.llm.scratch import Scratch

from .conftest import SCHEMA, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_statistics(docs, rows):
    got = quality(docs).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key) == sorted(((r[0], *base(r[1])) for r in rows), key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert not next(r for r in got if r["doc_id"] == 402)["kept"]


def features(t):
    n, chars, symbols, dup, repeat, _ = base(t)
    lines = len([x for x in t.split("\n") if WORD.search(x)])
    return [math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(n, 1)), math.sqrt(dup / max(lines, 1)), math.sqrt(repeat / max(n, 1))]


def lower_quantile(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def noise(chars, n, lines):
    return np.array([1 / max(chars, 1), 0.25 / max(n, 1), 0.25 / max(lines, 1), 0.25 / max(lines, 1)])


def squared(x, mean, cov):
    return np.einsum("...i,...ij,...j->...", x - mean, np.linalg.inv(cov), x - mean)


def brute_distances(texts):
    """The estimate by numpy, row by row: no cells, no counts of distinct values."""
    exact = np.floor(np.array([features(t) for t in texts]) * quality_rules.GRID + 0.5) / quality_rules.GRID
    sizes = [(base(t)[1], base(t)[0], len([x for x in t.split("\n") if WORD.search(x)])) for t in texts]
    x = np.minimum(exact, quality_rules.GRID_MOST / quality_rules.GRID)
    words, lines = (lower_quantile([s[k] for s in sizes], 0.5) for k in (1, 2))
    middle = np.array([lower_quantile(c, 0.5) for c in x.T])
    own = np.diag(noise(words * math.exp(middle[0]), words, lines))
    scale = np.maximum([1.4826 * lower_quantile(np.abs(c - m), 0.5) for c, m in zip(x.T, middle, strict=True)], np.sqrt(np.diag(own)))
    moments = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True))
    mean, cov = moments(np.floor(4096 * np.tanh((x - middle) / scale) + 0.5) / 4096)
    starts = [(middle, np.diag(scale**2)), moments(x[(np.abs(x - middle) <= quality_rules.TRIM * scale).all(1)]), (middle + mean * scale, cov * np.outer(scale, scale)), moments(x)]
    ended = []
    for mean, cov in starts:
        for _ in range(quality_rules.STEPS):
            found = np.floor(quality_rules.CLASSES * np.log(squared(x, mean, cov + own) + 1e-9))
            mean, cov = moments(x[found <= lower_quantile(found, quality_rules.SHARE)])
            cov = cov * quality_rules.RAW_FACTOR
        ended.append((np.linalg.det(cov + own), len(ended), mean, cov))
    _, _, mean, cov = min(ended, key=lambda e: e[0])
    mean, cov = moments(x[squared(x, mean, cov + own) <= quality_rules.REWEIGHTED_WITHIN])
    cov = cov * quality_rules.REWEIGHTED_FACTOR
    at = [noise(min(c, words * math.exp(mean[0])), min(n, words), min(k, lines)) for c, n, k in sizes]
    return np.array([squared(e, mean, cov + np.diag(v)) for e, v in zip(exact, at, strict=True)])


def group(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = text(seed * 1000 + i, 60 + rng.randrange(90))
        if i % 10 == 0:
            t = t.replace(" ", " | ")
        if i % 7 == 0:
            t += "\n" + "\n".join([t[:40]] * 2)
        out.append(t)
    return out


def test_distances_against_numpy(spark):
    groups = {("en", "a"): group(1, 120), ("en", None): group(2, 60), (None, "a"): group(3, 45)}
    rows = [(1000 * g + i, t, lang, source, len(t)) for g, ((lang, source), ts) in enumerate(groups.items()) for i, t in enumerate(ts)]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    for g, ts in enumerate(groups.values()):
        ids = [1000 * g + i for i, t in enumerate(ts) if not base(t)[5]]
        expected = brute_distances([ts[i - 1000 * g] for i in ids])
        assert np.allclose([got[i]["distance"] for i in ids], expected, rtol=1e-6, atol=1e-9)
        for i, d in zip(ids, expected, strict=True):
            assert got[i]["kept"] == (d <= quality_rules.CUTOFF)
    rejected = [i for i, r in got.items() if not r["base_failed"] and not r["kept"]]
    assert rejected and all(i % 1000 % 10 == 0 for i in rejected)


def varied(i):
    """A text whose four statistics all vary: symbols, repeated lines and repeated words come at rates of its own."""
    rng = random.Random(i)
    rate = max(0.02, rng.gauss(0.2, 0.03))
    lines = [" ".join(w + "#" * (rng.random() < rate) for w in text(1000 * i + j, rng.randrange(6, 14)).split(" ")) for j in range(20)]
    return "\n".join(lines + rng.sample(lines, k=rng.randrange(1, 6)))


def test_large_group_and_any_partitioning(spark, make):
    """20 000 rows of one group: distances as by numpy, and the same to the last bit in 1, 7 and 64 partitions."""
    texts = [varied(i) for i in range(2000)]
    rows = [(i, texts[i % 2000]) for i in range(19_600)] + [(20_000 + i, " ".join(f"{w}##" for w in text(i, 90).split(" "))) for i in range(400)]
    docs = make(rows)
    seen = [{r["doc_id"]: (r["distance"], r["kept"]) for r in quality(docs.repartition(p)).collect()} for p in (1, 7, 64)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 20_000
    expected = brute_distances([t for _, t in rows])
    got = np.array([seen[0][i][0] for i, _ in rows])
    assert np.allclose(got, expected, rtol=1e-6, atol=1e-9)
    assert not any(seen[0][20_000 + i][1] for i in range(400))
    assert np.mean([seen[0][i][1] for i in range(19_600)]) > 0.98


def test_estimate_of_a_normal_law(spark):
    """20 000 vectors of a correlated normal law and 30 % broken ones: scatter and median distance are those of the clean ones."""
    rng = np.random.default_rng(4)
    cov = np.array([[0.04, 0.01, 0, 0.01], [0.01, 0.09, 0.02, 0], [0, 0.02, 0.05, -0.01], [0.01, 0, -0.01, 0.08]])
    x = np.vstack([rng.multivariate_normal([2, 3, 2.5, 4], cov, 14_000), rng.multivariate_normal([2, 6, 2.5, 6], cov / 9, 6_000)])
    cells = spark.createDataFrame([("g", *map(int, row), 1) for row in np.floor(x * quality_rules.GRID + 0.5)], "grp string, q0 long, q1 long, q2 long, q3 long, w long")
    sizes = spark.createDataFrame([("g", d, 10**7, 20_000) for d in ("n_words", "n_lines")], "grp string, dim string, value long, w long")
    row = quality_rules.estimates(Scratch(spark, "test"), cells, sizes).first()
    found = np.array([[row[f"v{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    mean = np.array([row[f"m{i}"] for i in range(4)])
    assert np.abs(mean - [2, 3, 2.5, 4]).max() < 0.02 and np.abs(found - cov).max() < 0.01
    d = squared(x, mean, found)
    assert abs(np.median(d[:14_000]) - 3.357) < 0.15
    assert np.mean(d[:14_000] > quality_rules.CUTOFF) < 0.003 and (d[14_000:] > quality_rules.CUTOFF).all()


def test_many_groups_join_by_a_shuffle(docs, monkeypatch):
    """Estimates that are too many to be broadcast give the same rows."""
    one = sorted(map(str, quality(docs).collect()))
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", 0)
    assert sorted(map(str, quality(docs).collect())) == one


def test_small_groups_pool(spark):
    """Groups that are too small join their language's pool; a pool that is too small rejects nothing."""
    rows = [(i, text(i, 80), "en", f"s{i}", 0) for i in range(60)] + [(99, text(99, 80).replace(" ", " # "), "en", "odd", 0)] + [(200 + i, text(i, 80).replace(" ", " # "), "fr", "x", 0) for i in range(5)]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[99]["kept"] and got[99]["distance"] > quality_rules.CUTOFF
    assert all(got[i]["kept"] for i in range(60))
    assert all(got[200 + i]["kept"] and got[200 + i]["distance"] is None for i in range(5))


def test_identical_rows_are_kept(make):
    got = quality(make([(i, text(1, 80)) for i in range(80)])).collect()
    assert all(r["kept"] and r["distance"] < 1e-9 for r in got)


def test_empty_table(no_docs, make):
    assert quality(no_docs).collect() == []
    assert [r["kept"] for r in quality(make([(1, None)])).collect()] == [False]


def test_passing_keeps_columns(docs):
    kept = passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality(docs).where("kept").count()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_exact_median_of_counts(spark, n):
    values = [i * i for i in range(n)]
    counts = spark.createDataFrame([("g", v, 1 + v % 3) for v in values], "grp string, value long, w long")
    flat = [v for v in values for _ in range(1 + v % 3)]
    row = quality_rules._median(counts, ["grp"], "value").first()
    assert row["value"] == lower_quantile(flat, 0.5) == statistics.median_low(flat)


@pytest.mark.parametrize("percent", [40])
def test_broken_rows_below_half_of_a_group(make, percent):
    """Clean rows outnumber the broken ones, so all broken rows go and all clean ones stay."""

    def broken(i):
        words = text(i, 80).split(" ")
        return " ".join(f"{w} {'#' * (1 + i % 3)}" if random.Random(1000 * i + j).random() < 0.45 + i % 5 / 10 else w for j, w in enumerate(words))

    made = [(i, broken(i) if i < percent else text(i, 80)) for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in quality(make(made)).collect()}
    assert sorted(i for i, kept in got.items() if kept) == list(range(percent, 100))


def test_repeated_lines_and_moderate_symbols(make):
    """Texts that the base rules pass, each about 3 % of a clean group: symbols in one of five words, and lines repeated with and without words."""

    def symbols(i):
        return " ".join(w + "#" * (j % 5 == 0) for j, w in enumerate(text(i, 80).split(" ")))

    def lines(i, many, words, long):
        short = text(i, words)
        return "\n".join(f"{text(1000 * i + j, long)}\n{short}" for j in range(many))

    def menu(i):
        return "\n".join([text(i, 200), *random.Random(i).choices(["home", "news", "help", "login", "about", "terms"], k=56), text(i + 1, 6)])

    odd = [f(i) for i in range(3) for f in (symbols, lambda i: lines(500 + i, 12, 6, 12), lambda i: lines(600 + i, 16, 6, 8), menu)]
    assert not any(base(t)[5] for t in odd)
    made = [(i, t) for i, t in enumerate(odd)] + [(100 + i, "\n".join(text(1000 * i + j, 12) for j in range(8))) for i in range(120)]
    got = {r["doc_id"]: r["kept"] for r in quality(make(made)).collect()}
    assert sorted(i for i, kept in got.items() if kept) == list(range(100, 220))


def test_too_small_pool_is_judged_by_the_language(spark):
    """39 broken rows of a new source beside a large one of their language; 5 clean rows of another language's only small source."""
    rows = [(i, text(i, 80), "de", "large", 0) for i in range(60)] + [(100 + i, text(i, 80).replace(" ", " # "), "de", "new", 0) for i in range(39)]
    rows += [(200 + i, text(i, 80), "es", "large", 0) for i in range(40)] + [(300 + i, text(i, 81), "es", "new", 0) for i in range(5)]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(i for i, r in got.items() if r["kept"]) == [i for i, *_ in rows if not 100 <= i < 139]
    assert all(r["distance"] is not None for r in got.values())
