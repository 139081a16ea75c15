"""Every query that has SQL gives the rows of its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lexmill.catalog import ORACLES, QUERIES
from tests.conftest import SF


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (bool,)) or str(type(v)).endswith("bool_'>"):
            return bool(v)
        if isinstance(v, float) or "float" in str(type(v)):
            return round(float(v), 6)
        return int(v) if "int" in str(type(v)) else str(v)

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_components_of_all_orders(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pd.read_parquet(f"{SF}/lineitem.parquet")[["l_partkey", "l_suppkey"]].drop_duplicates().itertuples(index=False):
        x, y = sorted((find(a), find(b + 1000000)))
        root[y] = x
    got = {r.node: r.component for r in QUERIES["connected_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_sign_test_of_many_pairs(spark):
    from lexmill.operators import evaluate

    d = spark.range(2000).selectExpr("'a' AS pair", "CASE WHEN id < 960 THEN 1.0D ELSE -1.0D END AS delta")
    want = 2 * sum(math.comb(2000, i) for i in range(961)) / 2**2000
    assert evaluate.sign_test(d).first().p == pytest.approx(want, abs=1e-6)


def test_leakage_of_long_documents(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "alpha beta gamma delta epsilon " * 100), (8, "alpha beta " + " ".join(f"w{i}" for i in range(400)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["leakage_near_dups"](spark, str(tmp_path)).collect()] == [(1, 7, 1.0)]
