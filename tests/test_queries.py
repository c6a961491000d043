"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pandas as pd
import pytest

from editstrata.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) or x != x:
            return "null"
        if type(x).__name__ in ("bool", "bool_"):
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__ in ("float64", "float32", "Decimal"):
            return f"{float(x):.6g}"
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_is_listed():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 80
