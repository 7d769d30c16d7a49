"""Every registered query with SQL equals that SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLE[name])
    sql_columns = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(sql_columns) == columns
    place = [sql_columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == expected


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "Crop_Soil_combo", "fold", "encoded"]
    assert df.count() > 0
