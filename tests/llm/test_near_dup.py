import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import near_dup, skew
from lexmill.llm.near_dup import near_duplicates
from lexmill.llm.words import combine, word_hashes

from .conftest import near, text


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{id: (n, component)} over ids that are not null; rows of an id are one node."""
    nodes = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(nodes):
        for j, r in nodes[:a]:
            both = len(s & r)
            if s and r and 100 * both >= 75 * (len(s) + len(r) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in nodes}


def check(df, rows):
    got = df.collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(shingles(t))) for i, t in rows)
    expected = brute(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]][1], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_rows(docs, rows):
    check(near_duplicates(docs), [(r[0], r[1]) for r in rows])


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_large_group_without_a_hub(make):
    """Copies of copies: no member is near to all others, and some stand just beyond the threshold."""
    rng, rows, last = random.Random(3), [], text(77, 90)
    for i in range(160):
        rows.append((i, last if i % 4 else near(last, i, 3)))
        last = near(last, 1000 + i, 1 + rng.randrange(3))
    check(near_duplicates(make(rows)), rows)


def test_many_rounds(make, monkeypatch):
    monkeypatch.setattr(near_dup, "PIVOT_GROWTH", 2)
    base = text(5, 60)
    rows = [(i, near(base, i, i % 9)) for i in range(90)]
    check(near_duplicates(make(rows)), rows)


def test_small_sketches_lose_nothing(make):
    """Sets of up to k shingles are compared exactly, whatever k is."""
    rows = [(i, " ".join(f"a{j}" for j in range(i % 7, i % 7 + 20))) for i in range(30)]
    check(near_duplicates(make(rows), k=16), rows)


def test_threshold_is_exact(make):
    words = [f"x{i}" for i in range(24)]
    a = " ".join(words)  # 20 shingles
    rows = [(1, a), (2, " ".join(words[:19])), (3, " ".join(words[:18]))]  # 15 and 14 of them
    check(near_duplicates(make(rows)), rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(rows[:2])).collect()}
    assert got == {1: 1, 2: 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_hashes_agree_with_words(texts):
    hashes, counts = word_hashes([t.encode() for t in texts])
    words = [t.encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    seen: dict = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(combine(hashes, 3)) == max(0, len(flat) - 2)


def test_link_whose_sketches_underestimate(make):
    """A pair of exactly the threshold whose union sketch holds only 28 of 64 common values."""
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in rng.integers(0, 10**6, 304)]

    def tailed(name):
        words = list(common)
        for i in range(50):
            ways = [f"{name}{i}x{j}" for j in range(200)]
            hashes = [s[0] for s in near_dup.shingle_sets([" ".join([*words[-4:], w]).encode() for w in ways], 5)]
            words.append(ways[int(np.argmin(hashes) if i < 18 else np.argmax(hashes))])
        return " ".join(words)

    texts = [tailed("a"), tailed("b")]
    a, b = near_dup.shingle_sets([t.encode() for t in texts], 5)
    both = np.intersect1d(a, b)
    assert len(both) == 300 and len(np.union1d(a, b)) == 400
    assert len(np.intersect1d(np.union1d(a, b)[: near_dup.K], both)) == 28
    got = near_dup.near_duplicates(make(list(enumerate(texts)))).collect()
    assert [r["component_id"] for r in got] == [0, 0]


def repeated_ids():
    """Ids that repeat with different texts, linked through one of them, both or none, or empty."""
    a, b, c = text(1, 60), text(2, 70), text(3, 80)
    rows = [(1, a), (1, b), (2, near(a, 5, 1)), (3, near(b, 6, 1)), (4, c), (4, near(c, 7, 1)), (4, None), (5, "solo words"), (5, "other"), (5, ""), (6, near(c, 8, 1)), (7, ""), (7, None), (2, near(a, 5, 1))]
    return rows + [(20, text(9, 50)), (21, text(10, 50)), (22, text(9, 50)), (22, text(10, 50)), (20, "")]


def test_ids_that_repeat_with_different_texts(make):
    rows = repeated_ids()
    check(near_duplicates(make(rows)), rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(rows)).collect()}
    assert got[2] == got[3] == 1 and got[6] == 4 and got[21] == got[22] == 20


def test_repeated_ids_against_sql(make):
    import duckdb

    from lexmill.llm.oracles import ORACLES

    documents = make([*repeated_ids(), (None, "a b c"), (None, None)]).toArrow()  # noqa: F841  DuckDB reads it by its name
    names = ["doc_id", "n_shingles", "component_id", "kept", "class_id"]
    want = duckdb.sql(ORACLES["op7_minhash_near_dedup"]).select(*names).fetchall()
    got = near_duplicates(make([*repeated_ids(), (None, "a b c"), (None, None)])).select(names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_hot_keys(make, monkeypatch, docs, rows):
    """Keys of more rows than one task should hold: the same components by broadcast and salts."""
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    check(near_duplicates(docs), [(r[0], r[1]) for r in rows])


def test_one_text_of_each_group_stays(spark, make):
    from lexmill.llm.stages import near_dedup

    rows = repeated_ids()
    left = [(r["doc_id"], r["text"]) for r in near_dedup(spark, make([*rows, (None, "a b"), (None, "a b")]), "").collect()]
    named = [x for x in left if x[0] is not None]
    links = lambda s, r: 100 * len(s & r) >= 75 * (len(s) + len(r) - len(s & r))
    assert len(left) == len(named) + 2 and len(set(named)) == len(named) and set(named) <= set(rows)
    kept = [shingles(t) for _, t in named]
    assert not any(links(s, r) for i, s in enumerate(kept) for r in kept[:i] if s and r)
    assert all(any(links(shingles(t), s) for s in kept if s) for _, t in rows if shingles(t))


def template_pages(n):
    """80 shared words, then 20 of their own: no two pages link."""
    shared = " ".join(f"t{i}" for i in range(80))
    return [(p, f"{shared} " + " ".join(f"p{p}x{i}" for i in range(20))) for p in range(n)]


def test_template_pages_make_no_pairs(make, monkeypatch):
    """The tables from which pairs are made grow with the pages, not with their square, and stay empty here."""
    made: dict[str, int] = {}
    save = near_dup.Scratch.save

    def counted(self, df, tag, *more):
        out = save(self, df, tag, *more)
        if tag in ("listed", "lists", "members", "pivots", "pairs"):
            made[tag] = made.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup.Scratch, "save", counted)
    n = 8000
    got = near_duplicates(make(template_pages(n))).collect()
    assert all(r["kept"] for r in got) and len(got) == n
    assert made["listed"] <= 10 * n and made["lists"] == made["pairs"] == made["pivots"] == 0


def test_recall_on_long_texts(make):
    """Copies of texts of 300 to 900 words, edited to both sides of the threshold: every exact link is found."""
    rng, rows = random.Random(11), []
    for g in range(40):
        base = text(5000 + g, rng.randrange(300, 900))
        size = len(base.split(" "))
        rows += [(10 * g + j, near(base, 100 * g + j, int(size * (0.005 + 0.004 * j)))) for j in range(10)]
    check(near_duplicates(make(rows)), rows)
