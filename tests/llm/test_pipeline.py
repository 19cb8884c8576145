import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import quality_rules, stages
from lexmill.llm.mixing import places
from lexmill.llm.oracles import ORACLES
from lexmill.llm.queries import QUERIES

from .conftest import SCHEMA
from .test_decontaminate import brute as contaminated
from .test_near_dup import brute as components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1][:120]), (2, "nothing of the kind")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages_one_by_one(spark, folder, tmp_path):
    """Each stage against a brute-force version of its own input; the last against the tokenizer."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            ids = {r["doc_id"] for r in quality_rules.quality(spark.createDataFrame(before, SCHEMA)).where("kept").collect()}
            assert {r["doc_id"] for r in after} == ids and 403 not in ids and 402 not in ids and 400 in ids
        elif k == 1:
            found = components([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(i for i, (_, c) in found.items() if i == c)
            assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
        elif k == 2:
            bad = {x[0] for x in contaminated([(r["doc_id"], r["text"]) for r in before], items) if x[-1]}
            assert bad == {3} and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
        elif k == 3:
            order = [r["doc_id"] for r in places(spark.createDataFrame(before, SCHEMA)).orderBy("position").collect()]
            mixed = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).orderBy(*stages.in_file_order(docs)).collect()]
            assert mixed == order
        else:
            model, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
            texts = {r["doc_id"]: r["text"] for r in before}
            for i, r in zip(mixed, sorted(after, key=lambda r: r["start"]), strict=True):
                ids = [*model.encode(texts[i] or "", add_special_tokens=False).ids, 2]
                assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({r["start"] for r in got}) == len(got) > 0


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"e{k}"))
        docs = spark.read.parquet(str(tmp_path / f"e{k}"))
        assert docs.count() == 0


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        names = sorted(want.columns)
        key = lambda rows: sorted(map(str, rows))
        got = QUERIES[name](spark, sf_dir)
        assert sorted(got.columns) == names, name
        assert key(tuple(r) for r in got.select(names).collect()) == key(want.select(*[f'"{n}"' for n in names]).fetchall()), name


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
