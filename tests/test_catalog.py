"""Registered queries against their SQL, on the smallest driver tables where these are there."""

import os

import duckdb
import pytest

from quillspan.catalog import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6g}" if isinstance(v, int) and abs(v) < 10**5 else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name in SQL:
        found = duck.execute(SQL[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == columns
        want = sorted(tuple(plain(dict(zip(order, r))[c]) for c in columns) for r in found.fetchall())
        assert got == want
    else:
        assert got


def test_model_ranking_equals_its_sql_bit_by_bit(spark, tmp_path):
    rows = [("a", -10.0, 1), ("b", 10.0, 1), ("c", 2850.0, 2), ("d", 2900.0, 0), ("e", -2850.0, 1), ("f", -0.0, 1), ("g", 50.0, 4), (None, 50.0, 4), ("h", 50.0, None), ("i", None, 3), ("j", float("nan"), 3)]
    spark.createDataFrame(rows, "s_name string, s_acctbal double, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = QUERIES["model_ranking"](spark, str(tmp_path)).select("model", "f1", "failures", "rank").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(SQL["model_ranking"]).fetchall()))  # repr tells -0.0 from 0.0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
