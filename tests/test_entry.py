"""The driver's contract: queries import without a session, and agree with their SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_own_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from spanloom import queries as own

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")

    def rows(names, values):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)

    for name in ("delta_findings", "facet_report", "trace_assembly", "pending_alerts", "assign_frozen", "luhn_cards", "unassigned_pool", "eval_cases"):
        got = own.QUERIES[name](spark, SF)
        want = con.sql(own.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_span_lines_are_read_after_events_are_dealt_to_tasks(spark):
    from spanloom import queries

    lines = queries.span_lines(spark, "/root/testdata/sf0.001")
    plan = lines.where("value rlike 'resource[A-Z]pans'")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("resource[A-Z]pans") < plan.index("RepartitionByExpression"), plan
    assert lines.count() == spark.read.parquet(f"{SF}/events.parquet").count()
