"""Scenario and property tests of the transitions on the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quadflow.operators import admission, settlement
from quadflow.sources.domain import AS_OF, Campus, ts_lit
from quadflow.sources.requests import Requests


def test_admission_never_overfills_and_queues_continue(spark):
    c = Campus(spark, SF_SMALL)
    out = admission.admit_registrations(Requests(c).registration, c.activity, c.student, c.activity_registration)
    new = admission.registrations_after(c.activity_registration, out)
    before = c.activity_registration.groupBy("activity_id").agg(
        F.count(F.when(F.col("reg_status") == "confirmed", 1)).alias("b"))
    after = new.groupBy("activity_id").agg(F.count(F.when(F.col("reg_status") == "confirmed", 1)).alias("a"))
    bad = (after.join(before, "activity_id", "left").join(c.activity.select("activity_id", "max_capacity"), "activity_id")
           .filter((F.col("a") > F.greatest(F.col("max_capacity"), F.coalesce("b", F.lit(0))))))
    assert bad.count() == 0
    dup_pairs = new.groupBy("activity_id", "student_id").count().filter("count > 1")
    assert dup_pairs.count() == 0


def test_overdue_sweep_is_idempotent(spark):
    c = Campus(spark, SF_SMALL)
    as_of = ts_lit(AS_OF)
    orders1, pen1 = settlement.overdue_sweep(c.borrow_order, c.penalty, c.student, as_of)
    orders2, pen2 = settlement.overdue_sweep(orders1, c.penalty.unionByName(pen1), c.student, as_of)
    assert pen2.count() == 0
    assert pen1.count() > 0
    assert orders1.exceptAll(orders2).count() == 0


def test_like_stream_in_three_batches_equals_batch(spark):
    from quadflow.streaming import jobs
    c = Campus(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="quadflow-events-")
    events = c.raw("events")
    bounds = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (bounds.b - bounds.a) / 3
    for i in range(3):
        lo, hi = bounds.a + step * i, bounds.a + step * (i + 1)
        part = events.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < 2 else F.lit(True)))
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(jobs.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    ckpt, out = jobs.scratch_paths(spark, "likes-test")
    query = jobs.like_stream(spark, c, stream, out, ckpt)
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 2
    streamed = jobs.likes_after(spark, c, out)
    batch = admission.toggle_likes(Requests(c).like, c.post, c.post_like)
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0 and streamed.count() == batch.count()


def test_settlement_scenario_on_seed_rows(spark):
    """Fixture scenario 4: settle an ongoing activity with one checked and one
    absent confirmed student (+5 points/credit+1, violation/credit-5)."""
    T = "timestamp_ntz"
    act = spark.createDataFrame([(3, "ongoing")], "activity_id long, status string") \
        .withColumn("end_time", F.expr(f"TIMESTAMP_NTZ '2024-06-13 12:00:00'"))
    regs = spark.createDataFrame([(10, 3, 1, "confirmed", "checked"), (11, 3, 2, "confirmed", "absent")],
                                 "reg_id long, activity_id long, student_id long, reg_status string, checkin_status string")
    students = spark.createDataFrame([(1, 4, 0, 0, 100), (2, 5, 0, 0, 100)],
                                     "student_id long, user_id long, points int, violation_count int, credit_score int")
    orders = spark.createDataFrame([], f"order_id long, activity_id long, applicant_user_id long, order_status string, "
                                       f"expected_return_time {T}")
    as_of = F.expr("TIMESTAMP_NTZ '2024-06-15 12:00:00'")
    guard = settlement.finish_guard(act.select("activity_id"), act, as_of)
    s = settlement.Settlement(guard, regs, students, orders, as_of)
    got = {r.student_id: (r.points, r.violation_count, r.credit_score) for r in s.students().collect()}
    assert got == {1: (5, 0, 101), 2: (0, 1, 95)}
    pen = s.penalties(F.lit(0)).collect()
    assert [(p.student_id, p.penalty_type, p.status) for p in pen] == [(2, "no_show", "closed")]


def test_new_queue_numbers_continue_without_gaps(spark):
    """REG-1 queues after the current maximum with no gaps; REG-3 then
    renumbers every waitlist to 1..n."""
    c = Campus(spark, SF_SMALL)
    out = admission.admit_registrations(Requests(c).registration, c.activity, c.student, c.activity_registration)
    old_max = c.activity_registration.filter(F.col("reg_status") == "waiting").groupBy("activity_id") \
        .agg(F.max("queue_no").alias("m"))
    new = out.filter(F.col("outcome") == "waiting").groupBy("activity_id").agg(
        F.min("queue_no").alias("lo"), F.max("queue_no").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = new.join(old_max, "activity_id", "left").collect()
    for r in rows:
        assert r.lo == (r.m or 0) + 1 and r.hi - r.lo + 1 == r.n
    after = admission.registrations_after(c.activity_registration, out)
    promoted = admission.promote_waitlist(after).filter(F.col("reg_status") == "waiting")
    per = promoted.groupBy("activity_id").agg(F.min("queue_no").alias("lo"), F.max("queue_no").alias("hi"),
                                              F.count(F.lit(1)).alias("n")).collect()
    assert all(r.lo == 1 and r.hi == r.n for r in per)
