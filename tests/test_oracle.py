"""Every registered query against its SQL on DuckDB, and its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    diff, _ = compare(df, con, entry.oracle_sql().get(name))
    assert diff is None


def test_only_procedures_lack_sql():
    missing = set(entry.QUERIES) - set(entry.ORACLES)
    assert missing == {"rung_async", "stream_rungs"}


def test_flagship_smoke(spark):
    assert entry.entry(spark).count() > 0
