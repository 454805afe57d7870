"""Registered reporting views (REP-1..3) and sources (SRC-1..4, SCH-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadflow.operators import reports
from quadflow.plans.catalog import query
from quadflow.sources import tables
from quadflow.sources.schemas import TABLES

# Every sign-up, check-in mark and lent quantity as a fact of its activity, counted by kind.
SUMMARY_SQL = """
WITH fact AS (
  SELECT activity_id, unnest(['reg ' || reg_status, 'mark ' || checkin_status]) AS kind, 0 AS qty FROM activity_registration
  UNION ALL
  SELECT activity_id, 'lent', borrow_qty FROM borrow_detail JOIN borrow_order USING (order_id))
SELECT act.activity_id, act.title AS activity_title, club_name, venue_name, act.status,
       count(*) FILTER (kind = 'reg confirmed') AS confirmed_count, count(*) FILTER (kind = 'reg waiting') AS waiting_count,
       count(*) FILTER (kind = 'mark checked') AS checked_count, CAST(COALESCE(sum(qty), 0) AS BIGINT) AS borrow_total_qty
FROM activity act JOIN club USING (club_id) JOIN venue USING (venue_id) LEFT JOIN fact USING (activity_id)
GROUP BY ALL"""


def summary(c):
    return reports.activity_summary(c.activity, c.club, c.venue, c.activity_registration,
                                    c.borrow_order, c.borrow_detail)


@query("activity_summary", SUMMARY_SQL)
def activity_summary(c, r):
    """REP-1."""
    return summary(c)


@query("hot_activity_top10", f"""
SELECT activity_id, activity_title, club_name, confirmed_count, checked_count,
       CASE WHEN confirmed_count = 0 THEN 0.0
            ELSE CAST(round(CAST(checked_count AS DECIMAL(20,0)) * 100 / confirmed_count, 2) AS DOUBLE) END AS checkin_rate_pct
FROM ({SUMMARY_SQL}) t
ORDER BY confirmed_count DESC, checkin_rate_pct DESC, activity_id ASC
LIMIT 10""")
def hot_activity_top10(c, r):
    """REP-2."""
    return reports.hot_activity_top(summary(c), 10)


@query("club_resource_utilization", """
WITH by_order AS (
  SELECT order_id, count(*) AS lines, sum(borrow_qty) AS lent, sum(damage_qty) AS broken FROM borrow_detail GROUP BY order_id),
by_act AS (
  SELECT activity_id, sum(lent) AS lent, sum(broken) AS broken, sum(COALESCE(lines, 1)) AS weight,
         sum(CASE WHEN order_status = 'overdue' THEN COALESCE(lines, 1) END) AS late
  FROM borrow_order LEFT JOIN by_order USING (order_id) GROUP BY activity_id),
by_club AS (
  SELECT club_id, sum(lent) AS lent, sum(broken) AS broken, sum(COALESCE(weight, 1)) AS weight, sum(late) AS late
  FROM activity LEFT JOIN by_act USING (activity_id) GROUP BY club_id)
SELECT club_id, club_name, CAST(COALESCE(lent, 0) AS BIGINT) AS total_borrow_qty, CAST(COALESCE(broken, 0) AS BIGINT) AS total_damage_qty,
       COALESCE(CAST(round(CAST(broken AS DECIMAL(20,0)) * 100 / nullif(lent, 0), 2) AS DOUBLE), 0.0) AS damage_rate_pct,
       CAST(round(CAST(COALESCE(late, 0) AS DECIMAL(20,0)) * 100 / COALESCE(weight, 1), 2) AS DOUBLE) AS overdue_rate_pct
FROM club LEFT JOIN by_club USING (club_id)""")
def club_resource_utilization(c, r):
    """REP-3 (a rate over order lines; an order without lines, an activity without orders and a club without activities weigh one)."""
    return reports.club_resource_utilization(c.club, c.activity, c.borrow_order, c.borrow_detail)


# -- sources --------------------------------------------------------------------------------

@query("src_activity", "SELECT * FROM activity WHERE status = 'published'")
def src_activity(c, r):
    """SRC-1: the activity table through its declared schema, a pushed filter."""
    return c.activity.filter(F.col("status") == "published").select(*TABLES["activity"].fieldNames())


@query("posts_no_likes", """
SELECT p.post_id, count(x.comment_id) AS comment_count, CAST(0 AS BIGINT) AS like_count
FROM post p SEMI JOIN user_account u ON u.user_id = p.author_user_id SEMI JOIN post_category k ON k.category_id = p.category_id
LEFT JOIN post_comment x ON x.post_id = p.post_id
WHERE p.status = 'visible' GROUP BY p.post_id""")
def posts_no_likes(c, r):
    """SRC-2: the post feed when the like table does not exist."""
    from quadflow.operators.listings import post_feed
    likes = tables.optional_table(c.spark, None, TABLES["post_like"])
    feed = post_feed(c.post, c.user_account, c.table("post_category"), c.post_comment, likes)
    return feed.select("post_id", "comment_count", "like_count")


@query("seed_categories", """
SELECT category_name, status FROM product_category
UNION ALL
SELECT s.category_name, 'active' AS status
FROM (VALUES ('books'), ('electronics'), ('daily_goods')) s(category_name)
WHERE NOT EXISTS (SELECT 1 FROM product_category)
UNION ALL
SELECT s.category_name, 'active' AS status
FROM (VALUES ('campus_life'), ('lost_found'), ('experience_share')) s(category_name)
WHERE NOT EXISTS (SELECT 1 FROM product_category WHERE category_id < 0)""")
def seed_categories(c, r):
    """SRC-3: seed rows are appended only to an empty category table; the
    product categories exist, an empty table (no row matches) gets seeded."""
    seed_p = c.spark.createDataFrame([("books",), ("electronics",), ("daily_goods",)], "category_name string") \
        .withColumn("status", F.lit("active"))
    seed_q = c.spark.createDataFrame([("campus_life",), ("lost_found",), ("experience_share",)], "category_name string") \
        .withColumn("status", F.lit("active"))
    existing = c.table("product_category").select("category_name", "status")
    empty = c.table("product_category").filter(F.col("category_id") < 0).select("category_name", "status")
    return tables.seed_if_empty(existing, seed_p).unionByName(tables.seed_if_empty(empty, seed_q))


@query("checkin_from_regs", "SELECT * FROM checkin")
def checkin_from_regs(c, r):
    """SRC-4: check-in rows derived from registrations (insert-select)."""
    return c.checkin


@query("order_uid_backfill", """
SELECT order_id, COALESCE(order_uid, 'BOR-' || strftime(apply_time, '%Y%m%d') || '-' ||
       lpad(CAST(order_id AS VARCHAR), CAST(greatest(6, length(CAST(order_id AS VARCHAR))) AS INTEGER), '0')) AS order_uid
FROM borrow_order""")
def order_uid_backfill(c, r):
    """SCH-1: add ``order_uid`` when absent and fill the NULLs from apply_time."""
    from quadflow.operators.lending import backfill_order_uid
    legacy = c.borrow_order.drop("order_uid")
    return backfill_order_uid(legacy).select("order_id", "order_uid")
