"""Streaming forms: replaying the event log in several micro-batches gives
the one-batch result (STR-2, STR-3), and the sweep stream converges to a
single sweep at its last tick (STR-1)."""

import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quadflow.operators import admission, settlement
from quadflow.operators.listings import user_dim
from quadflow.sources.domain import Campus
from quadflow.sources.requests import Requests
from quadflow.streaming import jobs


def _split_events(spark, c, parts=3):
    src = tempfile.mkdtemp(prefix="quadflow-events-")
    events = c.raw("events")
    b = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (b.b - b.a) / parts
    for i in range(parts):
        lo, hi = b.a + step * i, b.a + step * (i + 1)
        part = events.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < parts - 1 else F.lit(True)))
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    return (spark.readStream.schema(jobs.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(src))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_admission_stream_equals_one_batch(spark):
    c = Campus(spark, SF_SMALL)
    ckpt, out = jobs.scratch_paths(spark, "admission-test")
    jobs.admission_stream(spark, c, _split_events(spark, c), out, ckpt).awaitTermination()
    streamed = jobs.stored(spark, out, "registration_outcome", jobs.OUTCOMES)
    batch = admission.admit_registrations(Requests(c).registration, c.activity, c.student, c.activity_registration)
    assert _same(streamed.select(*batch.columns), batch)


def test_audit_stream_equals_one_batch(spark):
    """The last status of an activity comes from Spark's state store: batches
    after the first know it without reading what was written."""
    c = Campus(spark, SF_SMALL)
    ckpt, out = jobs.scratch_paths(spark, "audit-test")
    query = jobs.audit_stream(spark, c, _split_events(spark, c), out, ckpt)
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 2 and query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
    viewers = user_dim(c.user_account, c.student, c.club)
    batch = settlement.status_changes(Requests(c).status_change, c.activity, viewers)
    steps = jobs.status_steps(spark, out)
    assert _same(steps.select(*batch.columns), batch)
    assert _same(settlement.status_audit(steps), settlement.status_audit(batch))


def test_sweep_without_events_follows_the_clock(spark):
    """Ticks of a rate-micro-batch clock sweep orders in a period without any event."""
    c = Campus(spark, SF_SMALL)
    ckpt, out = jobs.scratch_paths(spark, "sweep-clock-test")
    start = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    query = jobs.sweep_stream(spark, c, jobs.clock(spark, int(start.timestamp() * 1000), 24 * 60), out, ckpt, {"processingTime": "0 seconds"})
    try:
        deadline = time.time() + 120
        while (query.lastProgress or {"batchId": -1})["batchId"] < 3 and query.isActive and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    got = jobs.stored(spark, out, "penalty", jobs._schema(c.penalty))
    ticks = [(start + dt.timedelta(days=k)).replace(tzinfo=None) for k in range(4)]
    _, want = settlement.sweep_ticks(c.borrow_order, c.penalty, c.student, ticks)
    some = got.filter(F.col("create_time") <= F.lit(ticks[-1].isoformat(sep=" ")).cast("timestamp_ntz"))
    assert want.select("create_time").distinct().count() > 1
    assert _same(some.select("order_id", "student_id", "create_time"), want.select("order_id", "student_id", "create_time"))


def test_sweep_ticks_equal_one_sweep_after_the_other(spark):
    c = Campus(spark, SF_SMALL)
    ticks = [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 0, 30), dt.datetime(2024, 1, 20), dt.datetime(2024, 3, 1)]
    marked, new = settlement.sweep_ticks(c.borrow_order, c.penalty, c.student, ticks)
    orders, penalty, rows = c.borrow_order, c.penalty, None
    for t in ticks:
        orders, own = settlement.overdue_sweep(orders, penalty, c.student, F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz"))
        penalty = penalty.unionByName(own)
        rows = own if rows is None else rows.unionByName(own)
    assert _same(new, rows)
    ids = orders.join(c.borrow_order.select("order_id", F.col("order_status").alias("o")), "order_id").filter("o <> order_status").select("order_id")
    assert _same(marked, ids)


class _State:
    """A bucket's entry of the state store."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_bucket_of_pairs_is_toggled_at_once():
    """One call of the like kernel takes many pairs, null users among them, and
    finds what earlier batches left of them (one call per pair took most of
    the time)."""
    import pandas as pd
    state, t = _State(), pd.Timestamp("2024-01-01")

    def batch(*rows):
        frame = pd.DataFrame([(r, t, p, u or 0, u is None, e) for r, p, u, e in rows],
                             columns=["request_id", "ts", "post_id", "_user", "_anonymous", "_e"])
        out = pd.concat(jobs._toggles((0,), iter([frame]), state))
        return dict(zip(out["request_id"].tolist(), out["liked"].tolist()))
    assert batch((1, 7, 1, False), (2, 7, 2, True), (3, 7, 1, False), (4, 7, None, False), (5, 7, 1, False), (6, 8, 0, False)) == {
        1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    assert batch((10, 7, 1, False), (11, 7, 0, False), (12, 7, None, False), (13, 9, 2, True)) == {10: False, 11: True, 12: False, 13: False}
    assert batch((20, 7, 2, True), (21, 8, 0, False), (22, 9, 2, True)) == {20: True, 21: False, 22: True}


def test_a_bucket_of_activities_steps_at_once():
    import pandas as pd
    state, t = _State(), pd.Timestamp("2024-01-01")

    def batch(*rows):
        frame = pd.DataFrame([(r, t, a, s, c) for r, a, s, c in rows], columns=["request_id", "ts", "activity_id", "status", "_current"])
        out = pd.concat(jobs._steps((0,), iter([frame]), state))
        return dict(zip(out["request_id"].tolist(), out["old_status"].tolist()))
    assert batch((1, 5, "ongoing", "draft"), (2, 6, "cancelled", None), (3, 5, "finished", "draft")) == {1: "draft", 2: None, 3: "ongoing"}
    assert batch((4, 6, "draft", None), (5, 5, "draft", "draft"), (6, 7, "draft", "ongoing")) == {4: "cancelled", 5: "finished", 6: "ongoing"}
