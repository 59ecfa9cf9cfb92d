"""Every query with SQL agrees with it on the test tables."""

import os

import pandas as pd
import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "~"
        return repr(round(float(v), 4) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, con, name):
    ours = __spark_entry__.queries()[name](spark, SF).toPandas()
    theirs = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_with_sql_exists():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
