"""Every query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from pitspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([x[i] for i in order]) for x in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_risk_parity_sums_to_one(spark):
    assert abs(sum(x["w"] for x in catalog.risk_parity_weights(spark, SF).collect()) - 1) < 1e-9
