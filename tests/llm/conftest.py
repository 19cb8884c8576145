"""A small documents table with every awkward case, in two layouts."""

import random

import pytest

WORDS = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "ÉCOLE", "中文"]


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(base, seed, edits):
    rng, words = random.Random(seed), base.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def awkward_rows():
    """(doc_id, text, lang, source, n_chars)"""
    rows = [(i, text(i, 30 + 7 * i), "en", f"s{i % 3}") for i in range(40)]
    base = text(999, 120)
    rows += [(100 + i, base, "en", "s0") for i in range(30)]
    rows += [(200 + i, near(base, i, 1 + i % 6), "en", "s0") for i in range(40)]
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, " \t\n\r\x0b ", None, "s1"), (303, "one two", "de", None), (304, "One  two", "de", None), (305, "a b c d", None, None), (306, "solo", "de", "s1")]
    rows += [(None, text(5, 60), "en", "s1"), (None, None, None, None), (7, text(7, 30 + 49), "en", "s1"), (7, text(7, 30 + 49), "en", "s1")]
    rows += [(400, text(400, 20000), "en", "s2"), (401, "x" * 50_000, "en", "s2"), (402, "Of%%% the*** " * 60, "en", "s0"), (403, "loop " * 300, "en", "s0"), (404, "\n".join([text(1, 8)] * 12), "en", "s0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars")
    for name in ("id", "n", "v", "row", "kept", "n_words", "spans", "block", "position", "part", "root", "words", "score", "label"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda made: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], SCHEMA)
