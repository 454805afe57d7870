"""Reporting views: activity summary, hot-activity ranking, club utilisation.

Every fact input is aggregated to the join key *before* it is joined
(eager aggregation), so joins never multiply rows and the shuffles carry
per-key partials instead of raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.functions.scalar import rate_pct


def registration_counts(registration: DataFrame, with_checked: bool = True) -> DataFrame:
    aggs = [F.count(F.when(F.col("reg_status") == "confirmed", 1)).alias("confirmed_count"),
            F.count(F.when(F.col("reg_status") == "waiting", 1)).alias("waiting_count")]
    if with_checked:
        aggs.append(F.count(F.when(F.col("checkin_status") == "checked", 1)).alias("checked_count"))
    return registration.groupBy("activity_id").agg(*aggs)


def borrow_totals(borrow_order: DataFrame, borrow_detail: DataFrame) -> DataFrame:
    per_order = borrow_detail.groupBy("order_id").agg(F.sum("borrow_qty").alias("qty"))
    return (borrow_order.select("order_id", "activity_id").join(per_order, "order_id")
            .groupBy("activity_id").agg(F.sum("qty").alias("borrow_total_qty")))


def activity_summary(activity: DataFrame, club: DataFrame, venue: DataFrame, registration: DataFrame,
                     borrow_order: DataFrame, borrow_detail: DataFrame) -> DataFrame:
    """REP-1. Inner joins to club and venue, zero-filled left joins to the two
    pre-aggregated inputs. ``checked_count`` ignores ``reg_status``."""
    regs = registration_counts(registration)
    borrow = borrow_totals(borrow_order, borrow_detail)
    # The three activity-keyed inputs join first (one hash partitioning on
    # activity_id serves both joins); the dimensions follow and are broadcast
    # by AQE only when their measured size is under the threshold.
    base = (activity.select("activity_id", "title", "status", "club_id", "venue_id")
            .join(regs, "activity_id", "left").join(borrow, "activity_id", "left")
            .join(club.select("club_id", "club_name"), "club_id")
            .join(venue.select("venue_id", "venue_name"), "venue_id"))
    return base.select(
        "activity_id", F.col("title").alias("activity_title"), "club_name", "venue_name", "status",
        F.coalesce("confirmed_count", F.lit(0)).alias("confirmed_count"),
        F.coalesce("waiting_count", F.lit(0)).alias("waiting_count"),
        F.coalesce("checked_count", F.lit(0)).alias("checked_count"),
        F.coalesce("borrow_total_qty", F.lit(0)).cast("long").alias("borrow_total_qty"))


def hot_activity_top(summary: DataFrame, n: int = 10) -> DataFrame:
    """REP-2. Ranked by confirmed desc, check-in rate desc; ``activity_id``
    ascending breaks the ties the reference leaves open. ``orderBy + limit``
    plans as TakeOrderedAndProject: each task keeps its own top n."""
    ranked = summary.select(
        "activity_id", "activity_title", "club_name", "confirmed_count", "checked_count",
        rate_pct("checked_count", "confirmed_count").alias("checkin_rate_pct"))
    return ranked.orderBy(F.desc("confirmed_count"), F.desc("checkin_rate_pct"), F.asc("activity_id")).limit(n)


def club_resource_utilization(club: DataFrame, activity: DataFrame, borrow_order: DataFrame,
                              borrow_detail: DataFrame) -> DataFrame:
    """REP-3 with the fan-out of ``club ⟕ activity ⟕ order ⟕ detail`` kept.

    The reference averages the overdue flag over *joined rows*: an order
    weighs once per detail (at least once), an activity without orders and a
    club without activities each add one zero row. Instead of materialising
    that join, each level carries (rows, overdue rows, borrow, damage) up one
    key at a time, which gives the same sums with per-key partial aggregates.
    """
    det = borrow_detail.groupBy("order_id").agg(
        F.sum("borrow_qty").alias("b"), F.sum("damage_qty").alias("d"), F.count(F.lit(1)).alias("n"))
    orders = borrow_order.select("order_id", "activity_id", "order_status").join(det, "order_id", "left")
    o_rows = F.coalesce("n", F.lit(1))
    per_activity = orders.groupBy("activity_id").agg(
        F.sum(o_rows).alias("rows"),
        F.sum(F.when(F.col("order_status") == "overdue", o_rows).otherwise(0)).alias("od"),
        F.sum("b").alias("b"), F.sum("d").alias("d"))
    acts = activity.select("activity_id", "club_id").join(per_activity, "activity_id", "left")
    per_club = acts.groupBy("club_id").agg(
        F.sum(F.coalesce("rows", F.lit(1))).alias("rows"), F.sum(F.coalesce("od", F.lit(0))).alias("od"),
        F.sum("b").alias("b"), F.sum("d").alias("d"))
    joined = club.select("club_id", "club_name").join(per_club, "club_id", "left")
    borrow = F.coalesce(F.col("b"), F.lit(0)).cast("long")
    damage = F.coalesce(F.col("d"), F.lit(0)).cast("long")
    rows = F.coalesce(F.col("rows"), F.lit(1))
    od = F.coalesce(F.col("od"), F.lit(0))
    return joined.select(
        "club_id", "club_name", borrow.alias("total_borrow_qty"), damage.alias("total_damage_qty"),
        rate_pct(damage, borrow).alias("damage_rate_pct"), rate_pct(od, rows).alias("overdue_rate_pct"))
