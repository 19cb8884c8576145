"""Analyzer cases, the same on the driver and in columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import analyzers as an

BODY = [("my_variable other_var", ["my_variable", "other_var"]), ("a ab abc", ["ab", "abc"]), ("MyFunction CONSTANT", ["myfunction", "constant"]), ("K", []), ("", []), ("a.b", [])]
PARTS = [
    ("getPayingUsers", ["get", "paying", "users"]), ("new_webhook_token", ["new", "webhook", "token"]), ("SharedInformerFactory", ["shared", "informer", "factory"]),
    ("MAX_RETRY_COUNT", ["max", "retry", "count"]), ("Http2Server", ["http", "server"]), ("HTTPServer", ["http", "server"]), ("handler", ["handler"]),
    ("Server::handleRequest", ["server", "handle", "request"]), ("pkg.api.Handler", ["pkg", "api", "handler"]), ("pkg/api/handler", ["pkg", "api", "handler"]),
    ("pkg.api.Server::handleRequest", ["pkg", "api", "server", "handle", "request"]),
]


@pytest.mark.parametrize(("text", "expected"), BODY)
def test_query_tokens(text, expected):
    assert an.query_tokens(text) == expected


@pytest.mark.parametrize(("text", "expected"), PARTS)
def test_query_parts(text, expected):
    assert an.query_parts(text) == expected


def test_columns_agree(spark):
    df = spark.createDataFrame([(t,) for t, _ in BODY + PARTS], "t string")
    rows = df.select("t", an.body_tokens(F.col("t")).alias("b"), an.identifier_parts(F.col("t")).alias("p"), an.reversed_tokens(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r["b"] == an.query_tokens(r["t"])
        assert r["p"] == an.query_parts(r["t"])
        assert r["r"] == [x[::-1] for x in r["b"]]


def test_positions_keep_gaps(spark):
    assert an.query_positions("a bc d ef") == [("bc", 1), ("ef", 3)]
    row = spark.createDataFrame([("a bc d ef",)], "t string").select(an.token_positions(F.col("t")).alias("x")).first()
    assert [(x["token"], x["pos"]) for x in row["x"]] == [("bc", 1), ("ef", 3)]


def test_offsets():
    assert an.query_offsets("fn main()") == [("fn", 0), ("main", 3)]
    assert an.query_offsets("é main") == [("é", 0), ("main", 3)]


def test_lines_extension_paths(spark):
    df = spark.createDataFrame([("hit\r\nmiss\r\n", "/r/a.b/C.TXT", "&mut Server<T>")], "t string, p string, y string")
    row = df.select(an.lines(F.col("t")).alias("l"), an.extension(F.col("p")).alias("e"), an.relative_path(F.col("p"), "/r").alias("rel"), an.clean_type(F.col("y")).alias("y"), an.byte_line(F.col("t"), F.lit(5)).alias("n")).first()
    assert row["l"] == ["hit", "miss", ""]
    assert (row["e"], row["rel"], row["y"], row["n"]) == ("txt", "a.b/C.TXT", "Server", 2)
    none = spark.createDataFrame([("/a.b/c",), (".hidden",), ("x.",)], "p string").select(an.extension(F.col("p")).alias("e")).collect()
    assert [r["e"] for r in none] == ["", "", ""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB_1 .é中\n", max_size=20), min_size=1, max_size=8))
def test_any_text_agrees(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", an.body_tokens(F.col("t")).alias("b")).collect()
    assert all(r["b"] == an.query_tokens(r["t"]) for r in rows)
