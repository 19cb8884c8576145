"""Every search query against its SQL, on the smallest tables; and what remains without the training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexmill import oracles, queries, written, written_oracles

QUERIES = queries.QUERIES | written.QUERIES
ORACLES = oracles.ORACLES | written_oracles.ORACLES
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, sf_dir, name):
    assert table(QUERIES[name](spark, sf_dir).toPandas()) == table(db.sql(ORACLES[name]).df())


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLES):
        QUERIES[name](spark, sf_dir).collect()


def test_entry_without_the_training_part(tmp_path):
    """The entry module imports and lists the searches if the training-data part is deleted."""
    (tmp_path / "lexmill").mkdir()
    for p in (ROOT / "lexmill").iterdir():
        if p.name != "llm":
            (tmp_path / "lexmill" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; import __spark_entry__ as e; q = e.queries(); assert 'tok_exact' in q and not any(x.startswith('op') for x in q if x[2:3].isdigit()); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
