"""The driver's contract: names, SQL and the flagship."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from silvaspark import catalog

TABLES = "lineitem".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)
