"""Every registered query with an oracle matches DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SLOW = {"full_analysis", "rf_predictions", "rf_metrics", "model_report", "safe_region_rf"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(v)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(str(_norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    want = res.fetchall()
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(got, df.columns) == _rows(want, ocols)


def test_every_query_has_callable(spark):
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert len(q) >= 40


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r["scope"] for r in rows].count("overall") == 1
    assert df.columns == ["scope", "column", "CQI", "UQI", "VQI", "DQI", "grade", "total_rows",
                          "columns_evaluated"]
