import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import mixing
from lexmill.llm.mixing import mixed, period, phases, places, shares


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.floats(0.01, 100), min_size=1), st.integers(1, 60))
def test_shares(weights, slots):
    got = shares(weights, slots)
    assert sum(got.values()) == max(slots, len(weights)) and min(got.values()) >= 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.floats(0.01, 100), min_size=1), st.integers(10, 90))
def test_every_window_is_met(weights, slots):
    """Blocks run inside their windows, so at every slot each source is within one block of its target."""
    share = shares(weights, slots)
    order, q = period(share), sum(share.values())
    given_: Counter = Counter()
    assert Counter(s for s, _ in order) == share
    for t, (s, j) in enumerate(order):
        a = share[s]
        assert j == given_[s] and j * q // a <= t < -(-(j + 1) * q // a)
        given_[s] += 1
        assert all(abs(given_[x] - share[x] * (t + 1) / q) < 1 for x in share)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 70), min_size=1))
def test_phases_place_every_block_once(blocks):
    spans, offsets = phases(blocks, {s: n**0.5 for s, n in blocks.items()}, 20)
    at = {(p, s, j): t for p, s, j, t in offsets}
    slots, seen = set(), Counter()
    for phase, s, lo, hi, begin, share, q in spans:
        for b in range(lo, hi):
            slots.add(begin + (b - lo) // share * q + at[phase, s, (b - lo) % share])
            seen[s] += 1
    assert seen == blocks and slots == set(range(sum(blocks.values())))


def test_places(docs, rows):
    got = places(docs, block_rows=4, slots=10).collect()
    assert len(got) == len(rows) == len({r["position"] for r in got})
    by_source = defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        by_source[r["source"]].append(r)
    assert Counter(r[3] for r in rows) == {s: len(x) for s, x in by_source.items()}
    for found in by_source.values():
        ids = [r["doc_id"] for r in found]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert [(r["block_no"], r["row_in_block"]) for r in found] == [divmod(i, 4) for i in range(len(found))]


def test_given_weights(make, spark):
    df = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(200)] + [(1000, "t", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = places(df, {"a": 3, "b": 1, None: 1}, block_rows=1, slots=20).orderBy("position").collect()
    first = Counter(r["source"] for r in got[:101] if r["source"])
    assert first["a"] > 2.5 * first["b"]
    with pytest.raises(KeyError):
        places(df, {"a": 1})


def test_empty_table(no_docs):
    assert places(no_docs).collect() == []
    assert mixed(no_docs).collect() == []


def test_mixed_keeps_rows_in_order(docs, rows):
    out = mixed(docs, block_rows=4, slots=10)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["source"]) for r in out.collect()]
    assert Counter(got) == Counter((r[0], r[3]) for r in rows)
    order = {}
    for r in places(docs, block_rows=4, slots=10).orderBy("position").collect():
        order.setdefault((r["doc_id"], r["source"]), len(order))
    assert [order[x] for x in got] == sorted(order[x] for x in got)


def brute_positions(sizes, weights, block_rows, slots):
    """source -> its blocks' slots: one slot after another, always the released block with the earliest deadline."""
    left, out, t = {s: -(-n // block_rows) for s, n in sizes.items()}, {s: [] for s in sizes}, 0
    while any(left.values()):
        share = shares({s: weights[s] for s, n in left.items() if n}, slots)
        q, given_, begin = sum(share.values()), dict.fromkeys(share, 0), t
        while all(left[s] for s in share):
            ready = []
            for s, a in share.items():
                cycle, j = divmod(given_[s], a)
                if cycle * q + j * q // a <= t - begin:
                    ready.append((cycle * q - (-(j + 1) * q // a), s))
            s = min(ready)[1]
            given_[s], left[s], t = given_[s] + 1, left[s] - 1, t + 1
            out[s].append(t - 1)
    return out


def test_positions_against_a_plain_schedule(spark):
    rng = random.Random(8)
    sizes = {s: rng.randrange(1, 400) for s in "abcdefghij"}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(7)
    weights = {s: rng.random() + 0.05 for s in sizes} | {"c": 0.0}
    for given_ in (None, weights):
        got: dict = defaultdict(dict)
        for r in places(df, given_, block_rows=4, slots=30).collect():
            got[r["source"]][r["block_no"]] = r["slot"]
            assert r["position"] == 4 * r["slot"] + r["row_in_block"]
        expected = brute_positions({f"={s}": n for s, n in sizes.items()}, {f"={s}": (n**0.5 if given_ is None else given_[s]) for s, n in sizes.items()}, 4, 30)
        assert {s: [b[j] for j in range(len(b))] for s, b in got.items()} == {s[1:]: x for s, x in expected.items()}


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_bad_weights(bad):
    with pytest.raises(ValueError, match="weights"):
        shares({"a": bad, "b": 1.0}, 10)


def test_weights_of_zero():
    assert shares({"a": 0.0, "b": 0.0}, 10) == {"a": 5, "b": 5}
    assert shares({"a": 0.0, "b": 2.0}, 10) == {"a": 1, "b": 9}


def test_too_many_sources(make, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PLACES", 5)
    with pytest.raises(ValueError, match="sources"):
        places(make([(1, "t"), (2, "t")]))
