"""Every query with an oracle, on the smallest tables, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def value(v):
        if v is None or v != v:
            return ""
        return repr(round(v, 5) + 0.0) if isinstance(v, float) and math.isfinite(v) else repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted([value(r[c]) for c in columns] for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF).toPandas()
    expected = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert plain(found.to_dict("records"), columns) == plain(expected.to_dict("records"), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
