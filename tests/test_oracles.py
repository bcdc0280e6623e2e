"""Every query with SQL gives the same rows in Spark and in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lessonlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)) or value is pd.NA:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(repr(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r)) for r in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_matches_duckdb(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())
