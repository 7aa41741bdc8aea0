"""Every registered query of the library against its SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from lavra.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(clean, r)) for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equal(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, DATA).toPandas())
    assert got == rows(duck.sql(registry.SQL[name]).df())
