"""Registered queries: plan shape and the DuckDB oracle at sf0.001."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_registry_and_oracle_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


@needs_data
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


@needs_data
def test_no_python_udfs_no_cross_joins_and_pushdown(spark):
    from relmon.plans.queries import QUERIES
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = E.queries()["hourly_ingestion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


@needs_data
def test_oracle_sf0001(spark):
    import duckdb

    from tools.oracle_compare import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = []
    from relmon.plans.oracle import SQL
    for name, sql in SQL.items():
        df = E.queries()[name](spark, SF)
        a = rows_of(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(sql)
        b = rows_of([c[0] for c in cur.description], cur.fetchall())
        if sorted(df.columns) != sorted(c[0] for c in cur.description) or a != b:
            bad.append(name)
    assert bad == []
