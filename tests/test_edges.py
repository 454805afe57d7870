"""Edge cases called out for the reference's rules, on tiny fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quadflow.functions.scalar import field_position, json_of, order_uid, ts_text
from quadflow.operators import admission, listings, reports

T0 = dt.datetime(2024, 6, 15, 12, 0)
ACT = "activity_id long, status string, signup_deadline timestamp_ntz, max_capacity int, category string"
STU = "student_id long, credit_score int"
REG = "reg_id long, activity_id long, student_id long, reg_status string, queue_no int, checkin_status string"
REQ = "request_id long, ts timestamp_ntz, activity_id long, student_id long"


def _admit(spark, acts, studs, regs, reqs):
    out = admission.admit_registrations(spark.createDataFrame(reqs, REQ), spark.createDataFrame(acts, ACT),
                                        spark.createDataFrame(studs, STU), spark.createDataFrame(regs, REG))
    return {r.request_id: (r.outcome, r.queue_no, r.reg_id) for r in out.collect()}


def test_registration_rules(spark):
    later = T0 + dt.timedelta(days=1)
    acts = [(1, "published", later, 2, None), (2, "published", later, 1, "hot"), (3, "draft", later, 5, None),
            (4, "published", T0, 5, None)]
    studs = [(1, 100), (2, 100), (3, 30), (4, None), (5, 100)]
    regs = [(10, 1, 1, "cancelled", None, "not_checked"), (11, 1, 2, "confirmed", None, "not_checked"),
            (12, 2, 5, "waiting", 4, "not_checked")]
    reqs = [
        (1, T0, 1, 1),   # existing cancelled registration -> duplicate
        (2, T0, 1, 5),   # last seat of activity 1
        (3, T0, 1, 4),   # full -> waiting, queue 1
        (4, T0, 2, 3),   # hot + credit 30 -> low credit
        (5, T0, 2, 4),   # hot + NULL credit -> admitted; the existing row only waits, so the seat is free
        (6, T0, 3, 1),   # draft -> not published
        (7, later, 4, 1),  # after the deadline
        (8, T0, 9, 1),   # missing activity
        (9, T0, 1, 99),  # unknown student
        (10, later - dt.timedelta(hours=1), 1, 4),  # same pair again after admission -> duplicate
    ]
    got = _admit(spark, acts, studs, regs, reqs)
    assert got[1][0] == "duplicate"
    assert got[2] == ("confirmed", None, 13)
    assert got[3] == ("waiting", 1, 14)
    assert got[4][0] == "low_credit"
    assert got[5] == ("confirmed", None, 15)
    assert got[6][0] == "not_published" and got[7][0] == "deadline_passed"
    assert got[8][0] == "missing" and got[9][0] == "unknown_student" and got[10][0] == "duplicate"


def test_rejected_request_does_not_block_a_later_one(spark):
    later = T0 + dt.timedelta(days=1)
    acts = [(1, "published", later, 5, "hot")]
    got = _admit(spark, acts, [(1, 100)], [], [(1, T0, 1, 99), (2, T0, 1, 1), (3, T0, 1, 1)])
    assert got[1][0] == "unknown_student" and got[2][0] == "confirmed" and got[3][0] == "duplicate"


def test_shuffled_input_same_outcome(spark):
    later = T0 + dt.timedelta(days=1)
    acts = [(a, "published", later, 1 + a % 3, None) for a in range(5)]
    studs = [(s, 100) for s in range(30)]
    reqs = [(i, T0 + dt.timedelta(seconds=i % 17), i % 5, i % 30) for i in range(200)]
    df = spark.createDataFrame(reqs, REQ)
    a = admission.admit_registrations(df, spark.createDataFrame(acts, ACT), spark.createDataFrame(studs, STU),
                                      spark.createDataFrame([], REG))
    b = admission.admit_registrations(df.repartition(7, F.rand(3)), spark.createDataFrame(acts, ACT),
                                      spark.createDataFrame(studs, STU), spark.createDataFrame([], REG))
    assert sorted(a.collect()) == sorted(b.collect())


def test_waitlist_renumbers_from_one_with_null_first(spark):
    regs = spark.createDataFrame([(1, 7, 1, "waiting", 5, "x"), (2, 7, 2, "waiting", None, "x"),
                                  (3, 7, 3, "waiting", 2, "x"), (4, 8, 4, "confirmed", None, "x")], REG)
    got = {r.reg_id: (r.reg_status, r.queue_no) for r in admission.promote_waitlist(regs).collect()}
    assert got == {2: ("confirmed", None), 3: ("waiting", 1), 1: ("waiting", 2)}


def test_field_order_and_club_scope(spark):
    df = spark.createDataFrame([("published",), ("cancelled",), ("weird",), (None,)], "status string")
    pos = {r.status: r.p for r in df.select("status", field_position("status", listings.ACTIVITY_LIST_ORDER)
                                            .alias("p")).collect()}
    assert pos == {"published": 1, "cancelled": 5, "weird": 0, None: 0}
    act = spark.createDataFrame([(1, 1, 1, "a", "published")], "activity_id long, club_id long, venue_id long, "
                                "title string, status string")
    viewers = spark.createDataFrame([(5, "club", None)], "user_id long, role string, club_id long")
    club = spark.createDataFrame([(1, "c")], "club_id long, club_name string")
    venue = spark.createDataFrame([(1, "v")], "venue_id long, venue_name string")
    assert listings.activity_manage(act.withColumn("start_time", F.lit(T0)).withColumn("end_time", F.lit(T0))
                                    .withColumn("signup_deadline", F.lit(T0)).withColumn("max_capacity", F.lit(1)),
                                    club, venue, viewers).count() == 0


def test_json_keeps_null_and_uid_is_not_truncated(spark):
    row = spark.range(1).select(
        json_of(order_status=F.lit("borrowed"), actual_return_time=ts_text(F.lit(None).cast("timestamp_ntz")))
        .alias("j"), order_uid(F.lit(1234567).cast("long"), F.lit(T0)).alias("u"),
        order_uid(F.lit(42).cast("long"), F.lit(T0)).alias("v")).first()
    assert row.j == '{"order_status":"borrowed","actual_return_time":null}'
    assert row.u == "BOR-20240615-1234567" and row.v == "BOR-20240615-000042"


def test_club_utilisation_fan_out(spark):
    club = spark.createDataFrame([(1, "a"), (2, "b")], "club_id long, club_name string")
    act = spark.createDataFrame([(10, 1), (11, 1)], "activity_id long, club_id long")
    orders = spark.createDataFrame([(100, 10, "overdue"), (101, 10, "borrowed")],
                                   "order_id long, activity_id long, order_status string")
    det = spark.createDataFrame([(100, 4, 1), (100, 6, 0), (101, 10, 0)], "order_id long, borrow_qty int, damage_qty int")
    got = {r.club_id: (r.total_borrow_qty, r.total_damage_qty, r.damage_rate_pct, r.overdue_rate_pct)
           for r in reports.club_resource_utilization(club, act, orders, det).collect()}
    # joined rows of club 1: order 100 twice (overdue), order 101 once, activity 11 once -> 2 / 4
    assert got == {1: (20, 1, 5.0, 50.0), 2: (0, 0, 0.0, 0.0)}


def test_the_audit_key_derives_each_table_it_reads_once(spark, tmp_path):
    """The lines are cut out once, for loans and requests, and no sign-ups are
    derived for audit rows of orders: on large tables these fill the disk."""
    import shutil
    from quadflow.plans.catalog import queries
    from quadflow.sources.domain import Campus
    source = shutil.copytree(SF_SMALL, tmp_path / "source", copy_function=shutil.copyfile)
    assert queries()["dq_audit_foreign_key"](spark, str(source)).count() == 0
    stored = set(Campus(spark, str(source)).cache._commits())
    assert "line_first" in stored and not stored & {"borrow_detail", "activity_registration", "checkin"}
