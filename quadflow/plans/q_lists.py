"""Registered listing, lookup and top-N queries (LST-1..26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadflow.operators import listings as L
from quadflow.plans.catalog import query

# Sign-ups per activity as a map from status to count.
_SEATS = "(SELECT activity_id, histogram(reg_status) AS seats FROM activity_registration GROUP BY activity_id)"


def _seats(status):
    return f"CAST(COALESCE(map_extract(seats, '{status}')[1], 0) AS BIGINT) AS {status}_count"


def _activities(columns, rows):
    """SQL of LST-1 and LST-2: columns of the activities in ``rows`` with names and seats."""
    own = ", ".join(f"a.{x}" for x in columns)
    return f"""
SELECT {own}, club_name, venue_name, {_seats('confirmed')}, {_seats('waiting')}
FROM ({rows}) a JOIN club USING (club_id) JOIN venue USING (venue_id) LEFT JOIN {_SEATS} USING (activity_id)"""


_LIST_COLUMNS = ["activity_id", "club_id", "title", "category", "start_time", "end_time", "signup_deadline", "max_capacity", "status"]

_USER_DIM = """
SELECT u.user_id, u.username, u.role, u.phone,
       CASE WHEN u.role = 'student' THEN s.student_id END AS student_id,
       CASE WHEN u.role = 'club' THEN cl.club_id END AS club_id
FROM user_account u
LEFT JOIN student s ON s.user_id = u.user_id
LEFT JOIN (SELECT president_user_id AS user_id, min(club_id) AS club_id FROM club
           WHERE president_user_id IS NOT NULL GROUP BY president_user_id) cl ON cl.user_id = u.user_id"""


def viewers(c):
    return L.user_dim(c.user_account, c.student, c.club)


@query("activity_list", _activities(_LIST_COLUMNS, "SELECT * FROM activity WHERE contains(lower(title), 'urgent')"))
def activity_list(c, r):
    """LST-1 with a title keyword, as an admin (no club scope)."""
    return L.activity_list(c.activity, c.club, c.venue, c.activity_registration, keyword="urgent")


@query("activity_list_club", f"""
WITH listed AS ({_activities(_LIST_COLUMNS, "SELECT * FROM activity WHERE status = 'published'")})
SELECT user_id AS viewer_user_id, listed.* FROM listed JOIN ({_USER_DIM}) d ON d.role = 'club' AND d.club_id = listed.club_id""")
def activity_list_club(c, r):
    """LST-1 with a status filter, for every club account that has a club (its scope)."""
    return L.activity_list_by_club(c.activity, c.club, c.venue, c.activity_registration, viewers(c), status="published")


@query("activity_detail", _activities(
    ["activity_id", "club_id", "venue_id", "title", "category", "description", *_LIST_COLUMNS[4:]],
    "SELECT * FROM activity SEMI JOIN reg_request USING (activity_id)"))
def activity_detail(c, r):
    """LST-2 for every activity a sign-up request points at."""
    return L.activity_detail(c.activity, c.club, c.venue, c.activity_registration, r.registration)


@query("activity_roster", """
SELECT ar.activity_id, ar.reg_id, ar.student_id, s.real_name, ar.reg_status, ar.checkin_status, ar.queue_no
FROM activity_registration ar JOIN student s ON s.student_id = ar.student_id""")
def activity_roster(c, r):
    """LST-3."""
    return L.activity_roster(c.activity_registration, c.student)


@query("activity_manage", """
WITH presided AS (SELECT president_user_id AS user_id, min(club_id) AS club_id FROM club GROUP BY ALL),
     viewer AS (SELECT user_id AS viewer_user_id, club_id FROM presided SEMI JOIN (FROM user_account WHERE role = 'club') USING (user_id))
SELECT viewer_user_id, activity_id, club_id, club_name, venue_name, act.title, act.status, act.start_time, act.end_time,
       act.signup_deadline, act.max_capacity
FROM activity act JOIN viewer USING (club_id) JOIN club USING (club_id) JOIN venue USING (venue_id)""")
def activity_manage(c, r):
    """LST-4 for every club account."""
    return L.activity_manage(c.activity, c.club, c.venue, viewers(c))


@query("lookup_active_categories", """
SELECT 'product' AS kind, category_id, category_name FROM product_category WHERE status = 'active'
UNION ALL
SELECT 'post' AS kind, category_id, category_name FROM post_category WHERE status = 'active'""")
def lookup_active_categories(c, r):
    """LST-5."""
    return L.active_categories(c.table("product_category"), c.table("post_category"))


@query("dashboard_latest", """
SELECT * FROM (SELECT 'activity' AS feed, activity_id AS item_id, title, status, start_time AS item_time
               FROM activity ORDER BY activity_id DESC LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'product' AS feed, product_id AS item_id, title, status, publish_time AS item_time
               FROM product ORDER BY product_id DESC LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'post' AS feed, post_id AS item_id, title, status, create_time AS item_time
               FROM post ORDER BY post_id DESC LIMIT 5)""")
def dashboard_latest(c, r):
    """LST-6."""
    return L.dashboard_latest(c.activity, c.product, c.post, 5)


_PERF_SQL = """
SELECT act.club_id, act.activity_id, act.title, act.status, act.start_time, act.signup_deadline, act.max_capacity,
       count(g.reg_id) AS reg_count, count(*) FILTER (g.reg_status = 'waiting') AS waiting_count,
       count(*) FILTER (g.checkin_status = 'checked') AS checked_count,
       count(*) FILTER (g.checkin_status = 'absent') AS absent_count
FROM (SELECT unnest(max(activity_id, 12)) AS activity_id FROM activity GROUP BY club_id) newest
JOIN activity act USING (activity_id) LEFT JOIN activity_registration g USING (activity_id)
GROUP BY ALL"""


@query("club_activity_perf", _PERF_SQL)
def club_activity_perf(c, r):
    """LST-7."""
    return L.club_activity_perf(c.activity, c.activity_registration, 12)


@query("club_recent_regs", """
WITH full_row AS (SELECT club_id, reg_id, activity_id, title, real_name, reg_status, checkin_status, register_time
                  FROM activity JOIN activity_registration USING (activity_id) JOIN student USING (student_id))
FROM full_row SEMI JOIN (SELECT unnest(max(reg_id, 12)) AS reg_id FROM full_row GROUP BY club_id) newest USING (reg_id)""")
def club_recent_regs(c, r):
    """LST-8."""
    return L.club_recent_regs(c.activity_registration, c.activity, c.student, 12)


_STUDENT_REGS_SQL = """
WITH full_row AS (SELECT student_id, reg_id, activity_id, title, club_name, reg_status, checkin_status, register_time
                  FROM club JOIN activity USING (club_id) JOIN activity_registration USING (activity_id))
SELECT * FROM full_row SEMI JOIN (SELECT unnest(max(reg_id, 12)) AS reg_id FROM full_row GROUP BY student_id) newest USING (reg_id)"""


@query("student_regs", _STUDENT_REGS_SQL)
def student_regs(c, r):
    """LST-9."""
    return L.student_regs(c.activity_registration, c.activity, c.club, 12)


# One row per order and party.
_PARTIES = "SELECT order_id, unnest([buyer_user_id, seller_user_id]) AS user_id FROM trade_order"

_RECENT_ORDERS_SQL = f"""
SELECT newest.user_id, order_id, t.order_status, t.create_time, goods.title, goods.price, seller.username AS seller_name
FROM (SELECT user_id, unnest(max(order_id, 10)) AS order_id FROM ({_PARTIES}) SEMI JOIN student USING (user_id)
      GROUP BY user_id) newest
JOIN trade_order t USING (order_id) JOIN product goods USING (product_id)
JOIN user_account seller ON t.seller_user_id = seller.user_id"""


@query("user_recent_orders", _RECENT_ORDERS_SQL)
def user_recent_orders(c, r):
    """LST-10."""
    return L.user_recent_orders(c.trade_order, c.product, c.user_account, c.student, 10)


_RECENT_POSTS_SQL = """
SELECT author_user_id AS user_id, post_id, title, status, create_time FROM (
  SELECT *, row_number() OVER (PARTITION BY author_user_id ORDER BY post_id DESC) AS rn FROM post
  WHERE author_user_id IN (SELECT user_id FROM student)) t
WHERE rn <= 8"""


@query("user_recent_posts", _RECENT_POSTS_SQL)
def user_recent_posts(c, r):
    """LST-11."""
    return L.user_recent_posts(c.post, c.student, 8)


@query("club_summary", f"""
SELECT c.club_id, CAST(COALESCE(p.activity_count, 0) AS BIGINT) AS activity_count,
       CAST(COALESCE(p.reg_count, 0) AS BIGINT) AS reg_count, CAST(COALESCE(p.checked_count, 0) AS BIGINT) AS checked_count
FROM club c LEFT JOIN (SELECT club_id, count(*) AS activity_count, sum(reg_count) AS reg_count,
                              sum(checked_count) AS checked_count FROM ({_PERF_SQL}) q GROUP BY club_id) p
  ON p.club_id = c.club_id""")
def club_summary(c, r):
    """LST-12 (club)."""
    return L.club_summary(c.club, L.club_activity_perf(c.activity, c.activity_registration, 12))


@query("user_summary", f"""
SELECT s.user_id, s.student_id, COALESCE(rg.reg_count, 0) AS reg_count, COALESCE(rg.checked_count, 0) AS checked_count,
       COALESCE(o.trade_count, 0) AS trade_count, COALESCE(p.post_count, 0) AS post_count
FROM student s
LEFT JOIN (SELECT student_id, count(*) AS reg_count, COUNT(CASE WHEN checkin_status = 'checked' THEN 1 END) AS checked_count
           FROM ({_STUDENT_REGS_SQL}) a GROUP BY student_id) rg ON rg.student_id = s.student_id
LEFT JOIN (SELECT user_id, count(*) AS trade_count FROM ({_RECENT_ORDERS_SQL}) b GROUP BY user_id) o ON o.user_id = s.user_id
LEFT JOIN (SELECT user_id, count(*) AS post_count FROM ({_RECENT_POSTS_SQL}) d GROUP BY user_id) p ON p.user_id = s.user_id""")
def user_summary(c, r):
    """LST-12 (student)."""
    return L.user_summary(
        c.student, L.student_regs(c.activity_registration, c.activity, c.club, 12),
        L.user_recent_orders(c.trade_order, c.product, c.user_account, c.student, 10),
        L.user_recent_posts(c.post, c.student, 8))


@query("borrow_orders", """
SELECT order_id, COALESCE(order_uid, 'BOR-' || strftime(apply_time, '%Y%m%d') || '-' ||
       lpad(CAST(order_id AS VARCHAR), CAST(greatest(6, length(CAST(order_id AS VARCHAR))) AS INTEGER), '0')) AS order_uid,
       activity_id, applicant_user_id, apply_time, expected_return_time, actual_return_time, order_status
FROM borrow_order""")
def borrow_orders(c, r):
    """LST-13 for an admin, after the uid backfill the page runs first."""
    from quadflow.operators.lending import backfill_order_uid
    return L.borrow_orders(backfill_order_uid(c.borrow_order), viewer_role="admin")


@query("borrow_orders_own", """
SELECT order_id, order_uid, activity_id, applicant_user_id, apply_time, expected_return_time, actual_return_time, order_status
FROM borrow_order SEMI JOIN (SELECT user_id AS applicant_user_id FROM user_account WHERE role IS DISTINCT FROM 'admin')
USING (applicant_user_id)""")
def borrow_orders_own(c, r):
    """LST-13 for every account that is no admin: the orders it applied for."""
    return L.own_borrow_orders(c.borrow_order, c.user_account)


@query("borrow_open_orders", """
SELECT order_id, order_status FROM borrow_order WHERE order_status IN ('pending', 'approved', 'borrowed', 'overdue')""")
def borrow_open_orders(c, r):
    """LST-14."""
    return L.borrow_open_orders(c.borrow_order).select("order_id", "order_status")


@query("inventory", "SELECT resource_id, item_name, category, total_qty, available_qty, unit, status FROM resource_item")
def inventory(c, r):
    """LST-15."""
    return L.inventory(c.resource_item)


@query("product_list", """
WITH sale AS (SELECT * FROM product WHERE status = 'on_sale' AND contains(lower(title), 'ring'))
SELECT product_id, sale.title, sale.price, sale.status, sale.publish_time, seller.username AS seller_name, kind.category_name
FROM sale JOIN user_account seller ON seller.user_id = sale.seller_user_id
JOIN product_category kind ON kind.category_id = sale.category_id""")
def product_list(c, r):
    """LST-16 with keyword and status filters."""
    return L.product_list(c.product, c.user_account, c.table("product_category"), keyword="ring", status="on_sale")


@query("product_detail", """
WITH maker AS (SELECT user_id AS seller_user_id, username AS seller_name FROM user_account),
label AS (SELECT category_id, category_name FROM product_category)
SELECT goods.*, seller_name, category_name
FROM product goods SEMI JOIN trade_buy_request wanted USING (product_id) JOIN maker USING (seller_user_id) JOIN label USING (category_id)""")
def product_detail(c, r):
    """LST-17 for every product a buy request points at."""
    return L.product_detail(c.product, c.user_account, c.table("product_category"), r.trade_buy)


@query("seller_products", """
WITH label AS (SELECT category_id, category_name FROM product_category)
SELECT * EXCLUDE (category_id, description) FROM label JOIN product USING (category_id)""")
def seller_products(c, r):
    """LST-18."""
    return L.seller_products(c.product, c.table("product_category"))


@query("order_history", f"""
SELECT party.user_id, order_id, t.order_status, t.create_time, t.finish_time, product_id, goods.title, goods.price,
       buyer.username AS buyer_name, seller.username AS seller_name
FROM ({_PARTIES}) party JOIN trade_order t USING (order_id) JOIN product goods USING (product_id)
JOIN user_account buyer ON t.buyer_user_id = buyer.user_id JOIN user_account seller ON t.seller_user_id = seller.user_id""")
def order_history(c, r):
    """LST-19."""
    return L.order_history(c.trade_order, c.product, c.user_account)


def _posts(columns, rows):
    """SQL of LST-20 and LST-21: columns of the posts in ``rows`` with names and counted answers."""
    return f"""
SELECT {columns}, author_name, category_name,
       (SELECT count(*) FROM post_comment x WHERE x.post_id = p.post_id) AS comment_count,
       (SELECT count(*) FROM post_like x WHERE x.post_id = p.post_id) AS like_count
FROM ({rows}) p JOIN (SELECT user_id AS author_user_id, username AS author_name FROM user_account) USING (author_user_id)
JOIN (SELECT category_id, category_name FROM post_category) USING (category_id)"""


@query("post_feed", _posts("p.post_id, p.title, p.status, p.create_time, left(p.content, 80) AS content_preview",
                           "SELECT * FROM post WHERE status = 'visible' AND contains(lower(title), 'src1')"))
def post_feed(c, r):
    """LST-20 with a title keyword."""
    return L.post_feed(c.post, c.user_account, c.table("post_category"), c.post_comment, c.post_like, keyword="src1")


@query("post_detail", _posts("p.post_id, author_user_id, p.title, p.content, p.create_time, p.status",
                             "SELECT * FROM post SEMI JOIN like_request USING (post_id)"))
def post_detail(c, r):
    """LST-21 for every post a like request points at (hidden ones too)."""
    return L.post_detail(c.post, c.user_account, c.table("post_category"), c.post_comment, c.post_like, r.like)


@query("post_comments", """
SELECT * EXCLUDE (user_id) FROM (SELECT user_id, username FROM user_account) writer JOIN post_comment USING (user_id)""")
def post_comments(c, r):
    """LST-22."""
    return L.post_comments(c.post_comment, c.user_account)


@query("post_liked_flag", """
SELECT q.post_id, q.user_id, EXISTS (SELECT 1 FROM post_like l WHERE l.post_id = q.post_id AND l.user_id = q.user_id) AS user_liked
FROM (SELECT DISTINCT post_id, actor_user_id AS user_id FROM like_request) q""")
def post_liked_flag(c, r):
    """LST-23 for every (post, user) pair in the like requests."""
    pairs = r.like.select("post_id", F.col("actor_user_id").alias("user_id"))
    return L.post_liked_flag(pairs, c.post_like)


@query("author_posts", """
WITH label AS (SELECT category_id, category_name FROM post_category)
SELECT * EXCLUDE (category_id, content) FROM label JOIN post USING (category_id)""")
def author_posts(c, r):
    """LST-24."""
    return L.author_posts(c.post, c.table("post_category"))


@query("user_dim", _USER_DIM)
def user_dim(c, r):
    """LST-25."""
    return viewers(c)


@query("manageable_activities", f"""
SELECT d.user_id, a.activity_id, a.club_id FROM ({_USER_DIM}) d JOIN activity a ON a.club_id = d.club_id
WHERE d.role = 'club' AND d.club_id IS NOT NULL""")
def manageable_activities(c, r):
    """LST-26 (club accounts; admins by predicate)."""
    return L.manageable_activities(viewers(c), c.activity)


@query("lookup_lists", f"""
SELECT 'venue' AS kind, CAST(NULL AS BIGINT) AS viewer_user_id, venue_id AS item_id, venue_name AS item_name FROM venue
UNION ALL SELECT 'club', CAST(NULL AS BIGINT), club_id, club_name FROM club
UNION ALL SELECT 'activity_admin', CAST(NULL AS BIGINT), activity_id, title FROM activity
UNION ALL SELECT 'activity_club', d.user_id, a.activity_id, a.title
FROM ({_USER_DIM}) d JOIN activity a ON a.club_id = d.club_id WHERE d.role = 'club'""")
def lookup_lists(c, r):
    """LST-5: venue, club and activity pick-lists."""
    return L.pick_lists(c.venue, c.club, c.activity, viewers(c))
