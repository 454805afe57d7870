"""Plan shape: no cartesian products, no row-at-a-time Python, filters and
column pruning reach the scans, top-N per key is limited before the shuffle."""

import pytest

from conftest import SF_SMALL
from quadflow.plans.catalog import queries

Q = queries()
PYTHON_OK = {"stock_reserve", "audit_reservations", "stock_after_reserve", "dq_audit_foreign_key", "trade_log"}  # sequential folds
SKIP = {"stream_like_toggle", "stream_registrations", "stream_status_audit", "stream_sweep", "stream_sweep_schedule"}  # run a stream when built


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q) - SKIP))
def test_no_cartesian_no_row_udf(spark, name):
    text = plan(Q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON_OK:
        assert "MapInPandas" not in text and "FlatMapGroupsInPandas" not in text


def test_filter_and_projection_pushdown(spark):
    text = plan(Q["src_activity"](spark, SF_SMALL))
    assert "EqualTo(status,published)" in text
    text = plan(Q["borrow_open_orders"](spark, SF_SMALL))
    assert "In(order_status, [approved,borrowed,overdue,pending]" in text
    assert "ReadSchema: struct<order_id:bigint,order_status:string>" in text


def test_top_n_is_limited_map_side(spark):
    text = plan(Q["club_activity_perf"](spark, SF_SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sources_and_stored_tables_are_read_with_declared_schemas(spark):
    from quadflow.sources.domain import Campus
    from quadflow.sources.schemas import SOURCES, TABLES
    c = Campus(spark, SF_SMALL)
    assert all(dict(c.raw(n).dtypes) == dict(f.split() for f in s.split(", ")) for n, s in SOURCES.items())
    assert all(c.table(n).dtypes == [(f.name, f.dataType.simpleString()) for f in s.fields] for n, s in TABLES.items() if n != "audit_log")
