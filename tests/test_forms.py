"""Form rules on bad input: one bad form never aborts a batch or creates an invalid row."""

import datetime as dt

from conftest import SF_SMALL
from pyspark.sql import functions as F
from quadflow.operators import lending, quality, settlement
from quadflow.plans.q_transitions import viewers
from quadflow.sources.domain import Campus

T = dt.datetime(2024, 1, 1)


def _outcomes(df):
    return {r.request_id: r.outcome for r in df.collect()}


def test_product_prices_and_titles(spark):
    c = Campus(spark, SF_SMALL)
    cat = str(c.table("product_category").select(F.min("category_id")).first()[0])
    forms = [("t", "1e12"), ("t", "nan"), ("t", "-Infinity"), ("t", "5d"), ("t", "1_0.5"), ("t", "\t7\n"), ("\t\n", "1"), ("x" * 121, "1"), ("t", None), ("t", "-1")]
    df = spark.createDataFrame([(i, T, 1, title, cat, price) for i, (title, price) in enumerate(forms)],
                               "request_id long, ts timestamp_ntz, actor_user_id long, title string, category_id string, price string")
    got = _outcomes(quality.ingest_products(df, c.product, c.table("product_category")))
    assert got == {0: "db_error", 1: "db_error", 2: "db_error", 3: "bad_price", 4: "created", 5: "created", 6: "invalid_form", 7: "db_error", 8: "bad_price", 9: "db_error"}


def test_activity_forms_need_valid_rows(spark):
    c = Campus(spark, SF_SMALL)
    good = dict(title="t", category="c", venue_id="0", start_time=T, end_time=T + dt.timedelta(hours=1), signup_deadline=T, max_capacity="5", description="", club_id="0")
    venue = str(c.table("venue").select(F.min("venue_id")).first()[0])
    club = str(c.table("club").select(F.min("club_id")).first()[0])
    good |= {"venue_id": f" {venue}\t", "club_id": club}
    cases = [{}, {"max_capacity": "99999999999"}, {"start_time": None}, {"title": "x" * 201}, {"title": "\n"}, {"category": "x" * 51}]
    rows = [(i, T, 0, *(good | case).values()) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, actor_user_id long, title string, category string, venue_id string, start_time timestamp_ntz, "
                               "end_time timestamp_ntz, signup_deadline timestamp_ntz, max_capacity string, description string, club_id string").withColumn("activity_id", F.lit(None).cast("long"))
    got = _outcomes(settlement.ingest_activity(df, c.activity, c.table("venue"), c.table("club"), viewers(c)))
    assert got == {0: "created", 1: "db_error", 2: "db_error", 3: "db_error", 4: "invalid_form", 5: "db_error"}


def test_borrow_orders_strip_and_need_a_return_time(spark):
    c = Campus(spark, SF_SMALL)
    act = str(c.activity.select(F.min("activity_id")).first()[0])
    df = spark.createDataFrame([(0, T, 0, act, T, " pending\t"), (1, T, 0, act, None, "pending"), (2, T, 0, act, T, None), (3, T, 0, act, T, "")],
                               "request_id long, ts timestamp_ntz, actor_user_id long, activity_ref string, expected_return_time timestamp_ntz, order_status string")
    got = _outcomes(lending.ingest_borrow_orders(df, c.borrow_order, c.activity, viewers(c)))
    assert got == {0: "created", 1: "db_error", 2: "created", 3: "invalid_form"}
