import hashlib
import random
import re

import pytest

from lexmill.llm.decontaminate import Items, benchmark_spans, contamination, without_benchmark

from .conftest import text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows: dict = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[p : p + 10]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if x := windows.get(tuple(w[p : p + size])):
                    found |= x
                    hit |= set(range(p, p + size))
        names = sorted(found)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, text(50, 25)), (2, "Solo!"), (10, text(51, 12)), (2, "Solo!"), (3, None), (4, "?!"), (5, text(50, 25) + " more words at the end of it all here"), (None, "Straße naïve"), (6, text(52, 10))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def planted(rows):
    made = [(r[0], r[1]) for r in rows]
    return made + [
        (500, "before " + text(50, 25).upper().replace("É", "é") + ", after"), (501, text(60, 30) + "\n" + text(50, 25).replace(" ", " -- ") + " tail " + text(51, 12)), (502, " ".join(text(50, 25).split()[:9])),
        (503, "solo solo"), (504, "solos"), (505, text(52, 10) + " " + text(52, 10)), (506, "x straße, NAïVE y"),
    ]


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("item_bytes", [8 << 20, 200])
def test_against_brute_force(make, rows, items, item_bytes):
    docs = planted(rows)
    got = contamination(make(docs), items, item_bytes=item_bytes).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, ITEMS)


def test_runs_against_all_windows():
    """Random words of a small vocabulary, so that items repeat themselves and each other."""
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    for _ in range(150):
        block = [(str(i), some(rng.randrange(1, 24))) for i in range(4)]
        words = some(rng.randrange(1, 60)).encode().split()
        expected = set()
        for name, t in block:
            w = t.encode().split()
            size = min(10, len(w))
            windows = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)}
            expected |= {(name, q) for p in range(len(words) - size + 1) if tuple(words[p : p + size]) in windows for q in range(p, p + size)}
        found = Items(block, 10).spans(b" ".join(words), words)
        assert {(n, q) for n, a, b, *_ in found for q in range(a, b)} == expected


def test_spans_point_into_the_text(make, items):
    t = "é… " + text(60, 5) + " (" + text(51, 12).replace(" ", " -- ") + ")!"
    (row,) = benchmark_spans(make([(1, t)]), items).collect()
    (span,) = [s for s in row["spans"] if s["item"] == "10"]
    assert words(t[span["begin"] : span["end"]]) == words(text(51, 12))
    assert words(t)[span["first_word"] : span["end_word"]] == words(text(51, 12))


def test_empty_tables(spark, no_docs, items, make):
    assert contamination(no_docs, items).collect() == []
    none = items.limit(0)
    (row,) = contamination(make([(1, "a b")]), none).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"], row["items_sha256"]) == (2, 0, False, hashlib.sha256(b"").hexdigest())


def test_columns_stay(docs, items, rows):
    kept = without_benchmark(docs, items)
    assert kept.columns == docs.columns
    clean = [d for d, *_, bad in brute([(i, r[1]) for i, r in enumerate(rows)], ITEMS) if not bad]
    assert kept.count() == len(clean)
