"""Queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corvane import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind == "f":
            df[k] = df[k].map(lambda v: "None" if pd.isna(v) else repr(float(v)))
    return sorted(map(tuple, df.astype(str).replace(" 00:00:00", "", regex=True).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, sf, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns) and plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, sf, name):
    """Queries without SQL run to their last row; their values are compared in test_search_index and test_importance."""
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0 and len(got.columns) > 0 and not got.isna().all().any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
