"""Listing, lookup and top-N queries (the pages of the application).

The reference answers each page for one user; here every "my ..." page is
computed for all users at once as a top-N per key. ``row_number() <= n``
plans with a partial WindowGroupLimit before the shuffle, so each map task
forwards at most n rows per key and a hot key cannot flood one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadflow.functions.scalar import contains_ci, field_position
from quadflow.operators.reports import registration_counts

# Display order of activity states in the activity list.
ACTIVITY_LIST_ORDER = ["published", "ongoing", "draft", "finished", "cancelled"]
OPEN_ORDER_STATUS = ["pending", "approved", "borrowed", "overdue"]


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


# -- activities -------------------------------------------------------------------

def _activity_with_counts(activity: DataFrame, club: DataFrame, venue: DataFrame,
                          registration: DataFrame) -> DataFrame:
    counts = registration_counts(registration, with_checked=False)
    return (activity.join(counts, "activity_id", "left")
            .join(club.select("club_id", "club_name"), "club_id")
            .join(venue.select("venue_id", "venue_name"), "venue_id")
            .withColumn("confirmed_count", F.coalesce("confirmed_count", F.lit(0)))
            .withColumn("waiting_count", F.coalesce("waiting_count", F.lit(0))))


def activity_list(activity: DataFrame, club: DataFrame, venue: DataFrame, registration: DataFrame,
                  keyword: str | None = None, status: str | None = None,
                  club_scope: int | None = None) -> DataFrame:
    """LST-1. Filters are applied to ``activity`` before the joins so they
    reach the scan; a club user without a club passes ``club_scope=None``
    and, as in the reference, sees every activity."""
    if club_scope is not None:
        activity = activity.filter(F.col("club_id") == F.lit(club_scope))
    if keyword:
        activity = activity.filter(contains_ci("title", keyword))
    if status:
        activity = activity.filter(F.col("status") == F.lit(status))
    rows = _activity_with_counts(activity, club, venue, registration)
    return (rows.select("activity_id", "club_id", "title", "category", "start_time", "end_time",
                        "signup_deadline", "max_capacity", "status", "club_name", "venue_name",
                        "confirmed_count", "waiting_count")
            .orderBy(field_position("status", ACTIVITY_LIST_ORDER), F.asc("start_time"),
                     F.desc("activity_id")))


def activity_list_by_club(activity: DataFrame, club: DataFrame, venue: DataFrame, registration: DataFrame,
                          viewers: DataFrame, keyword: str | None = None, status: str | None = None) -> DataFrame:
    """LST-1 under the club scope, for every club account at once: the list of
    its own club. Accounts without a club see the unscoped list, which is
    ``activity_list`` and isn't repeated for each of them."""
    scoped = viewers.filter((F.col("role") == "club") & F.col("club_id").isNotNull()).select(
        F.col("user_id").alias("viewer_user_id"), "club_id")
    rows = activity_list(activity, club, venue, registration, keyword, status).join(scoped, "club_id")
    return rows.orderBy("viewer_user_id", field_position("status", ACTIVITY_LIST_ORDER), F.asc("start_time"),
                        F.desc("activity_id"))


def activity_detail(activity: DataFrame, club: DataFrame, venue: DataFrame, registration: DataFrame,
                    ids: DataFrame) -> DataFrame:
    """LST-2 for a whole table of requested ids (a semi join, not a loop)."""
    wanted = activity.join(ids.select("activity_id").distinct(), "activity_id", "left_semi")
    rows = _activity_with_counts(wanted, club, venue, registration)
    return rows.select("activity_id", "club_id", "venue_id", "title", "category", "description",
                       "start_time", "end_time", "signup_deadline", "max_capacity", "status",
                       "club_name", "venue_name", "confirmed_count", "waiting_count")


def activity_roster(registration: DataFrame, student: DataFrame) -> DataFrame:
    """LST-3: the registration roster of every activity, newest first."""
    return (registration.join(student.select("student_id", "real_name"), "student_id")
            .select("activity_id", "reg_id", "student_id", "real_name", "reg_status", "checkin_status",
                    "queue_no")
            .orderBy("activity_id", F.desc("reg_id")))


def activity_manage(activity: DataFrame, club: DataFrame, venue: DataFrame,
                    viewers: DataFrame) -> DataFrame:
    """LST-4 for club viewers: plain ``=`` on club_id, so a club account
    without a club (NULL) sees nothing, unlike LST-1."""
    club_viewers = viewers.filter(F.col("role") == "club").select(
        F.col("user_id").alias("viewer_user_id"), F.col("club_id"))
    rows = (activity.join(club_viewers, "club_id")
            .join(club.select("club_id", "club_name"), "club_id")
            .join(venue.select("venue_id", "venue_name"), "venue_id"))
    return (rows.select("viewer_user_id", "activity_id", "club_id", "club_name", "venue_name", "title",
                        "status", "start_time", "end_time", "signup_deadline", "max_capacity")
            .orderBy("viewer_user_id", F.desc("activity_id")))


def active_categories(product_category: DataFrame, post_category: DataFrame) -> DataFrame:
    """LST-5: the category pick-lists (active only, by name)."""
    def pick(df: DataFrame, kind: str) -> DataFrame:
        return df.filter(F.col("status") == "active").select(
            F.lit(kind).alias("kind"), "category_id", "category_name")
    return pick(product_category, "product").unionByName(pick(post_category, "post")) \
        .orderBy("kind", "category_name")


def dashboard_latest(activity: DataFrame, product: DataFrame, post: DataFrame, n: int = 5) -> DataFrame:
    """LST-6: the newest n rows of each feed, as one tagged union."""
    def feed(df: DataFrame, kind: str, key: str, ts: str) -> DataFrame:
        return df.select(F.lit(kind).alias("feed"), F.col(key).alias("item_id"), "title", "status",
                         F.col(ts).alias("item_time")).orderBy(F.desc("item_id")).limit(n)
    return (feed(activity, "activity", "activity_id", "start_time")
            .unionByName(feed(product, "product", "product_id", "publish_time"))
            .unionByName(feed(post, "post", "post_id", "create_time")))


# -- "my" pages, for all users at once -----------------------------------------------

def club_activity_perf(activity: DataFrame, registration: DataFrame, n: int = 12) -> DataFrame:
    """LST-7: per club, its newest n activities with registration counts
    (``reg_count`` counts every status)."""
    counts = registration.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("reg_count"),
        F.count(F.when(F.col("reg_status") == "waiting", 1)).alias("waiting_count"),
        F.count(F.when(F.col("checkin_status") == "checked", 1)).alias("checked_count"),
        F.count(F.when(F.col("checkin_status") == "absent", 1)).alias("absent_count"))
    newest = top_n_per_key(activity, ["club_id"], [F.desc("activity_id")], n)
    rows = newest.join(counts, "activity_id", "left")
    return rows.select(
        "club_id", "activity_id", "title", "status", "start_time", "signup_deadline", "max_capacity",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reg_count", "waiting_count", "checked_count",
                                                      "absent_count")])


def club_recent_regs(registration: DataFrame, activity: DataFrame, student: DataFrame,
                     n: int = 12) -> DataFrame:
    """LST-8: per club, the newest n registrations of its activities."""
    rows = (registration.join(activity.select("activity_id", "club_id", "title"), "activity_id")
            .join(student.select("student_id", "real_name"), "student_id"))
    return top_n_per_key(rows, ["club_id"], [F.desc("reg_id")], n).select(
        "club_id", "reg_id", "activity_id", "title", "real_name", "reg_status", "checkin_status",
        "register_time")


def student_regs(registration: DataFrame, activity: DataFrame, club: DataFrame, n: int = 12) -> DataFrame:
    """LST-9: per student, the newest n registrations."""
    rows = (registration.join(activity.select("activity_id", "club_id", "title"), "activity_id")
            .join(club.select("club_id", "club_name"), "club_id"))
    return top_n_per_key(rows, ["student_id"], [F.desc("reg_id")], n).select(
        "student_id", "reg_id", "activity_id", "title", "club_name", "reg_status", "checkin_status",
        "register_time")


def _per_party(trade_order: DataFrame) -> DataFrame:
    """One row per (order, party): ``buyer = u OR seller = u`` as an equi-key.
    A CHECK keeps buyer and seller apart, so no order appears twice."""
    return trade_order.withColumn("user_id", F.explode(F.array("buyer_user_id", "seller_user_id")))


def user_recent_orders(trade_order: DataFrame, product: DataFrame, users: DataFrame,
                       students: DataFrame, n: int = 10) -> DataFrame:
    """LST-10: per student user, the newest n trade orders as buyer or seller."""
    parties = _per_party(trade_order).join(students.select("user_id"), "user_id", "left_semi")
    newest = top_n_per_key(parties, ["user_id"], [F.desc("order_id")], n)
    return (newest.join(product.select("product_id", "title", "price"), "product_id")
            .join(users.select(F.col("user_id").alias("seller_user_id"), F.col("username").alias("seller_name")),
                  "seller_user_id")
            .select("user_id", "order_id", "order_status", "create_time", "title", "price", "seller_name"))


def user_recent_posts(post: DataFrame, students: DataFrame, n: int = 8) -> DataFrame:
    """LST-11: per student user, the newest n posts."""
    mine = post.join(students.select(F.col("user_id").alias("author_user_id")), "author_user_id", "left_semi")
    return top_n_per_key(mine, ["author_user_id"], [F.desc("post_id")], n).select(
        F.col("author_user_id").alias("user_id"), "post_id", "title", "status", "create_time")


def club_summary(club: DataFrame, perf: DataFrame) -> DataFrame:
    """LST-12 (club): totals over the *truncated* activity list, zero-filled."""
    sums = perf.groupBy("club_id").agg(
        F.count(F.lit(1)).alias("activity_count"), F.sum("reg_count").alias("reg_count"),
        F.sum("checked_count").alias("checked_count"))
    return club.select("club_id").join(sums, "club_id", "left").select(
        "club_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                     for c in ("activity_count", "reg_count", "checked_count")])


def user_summary(students: DataFrame, regs: DataFrame, orders: DataFrame, posts: DataFrame) -> DataFrame:
    """LST-12 (student): counts over the truncated lists (12 / 10 / 8)."""
    r = regs.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("reg_count"),
        F.count(F.when(F.col("checkin_status") == "checked", 1)).alias("checked_count"))
    o = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("trade_count"))
    p = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("post_count"))
    base = students.select("user_id", "student_id")
    rows = base.join(r, "student_id", "left").join(o, "user_id", "left").join(p, "user_id", "left")
    return rows.select("user_id", "student_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                                  ("reg_count", "checked_count", "trade_count", "post_count")])


# -- lending -----------------------------------------------------------------------------

def borrow_orders(borrow_order: DataFrame, viewer_user_id: int | None = None,
                  viewer_role: str = "admin") -> DataFrame:
    """LST-13: ``(role = 'admin') OR (applicant = user)``, newest first."""
    rows = borrow_order
    if viewer_role != "admin":
        rows = rows.filter(F.col("applicant_user_id") == F.lit(viewer_user_id))
    return rows.select("order_id", "order_uid", "activity_id", "applicant_user_id", "apply_time",
                       "expected_return_time", "actual_return_time", "order_status").orderBy(F.desc("order_id"))


def own_borrow_orders(borrow_order: DataFrame, users: DataFrame) -> DataFrame:
    """LST-13 for all accounts that are no admins at once: each order is on
    its applicant's page, newest first there."""
    plain = users.filter(~F.col("role").eqNullSafe("admin")).select(F.col("user_id").alias("applicant_user_id"))
    return (borrow_order.join(plain, "applicant_user_id", "left_semi")
            .select("order_id", "order_uid", "activity_id", "applicant_user_id", "apply_time",
                    "expected_return_time", "actual_return_time", "order_status")
            .orderBy("applicant_user_id", F.desc("order_id")))


def borrow_open_orders(orders: DataFrame) -> DataFrame:
    """LST-14: orders a detail can still be added to."""
    return orders.filter(F.col("order_status").isin(*OPEN_ORDER_STATUS))


def inventory(resource_item: DataFrame) -> DataFrame:
    """LST-15."""
    return resource_item.select("resource_id", "item_name", "category", "total_qty", "available_qty",
                                "unit", "status").orderBy("resource_id")


# -- trade -----------------------------------------------------------------------------

def _product_rows(product: DataFrame, users: DataFrame, product_category: DataFrame) -> DataFrame:
    return (product.join(users.select(F.col("user_id").alias("seller_user_id"),
                                      F.col("username").alias("seller_name")), "seller_user_id")
            .join(product_category.select("category_id", "category_name"), "category_id"))


def product_list(product: DataFrame, users: DataFrame, product_category: DataFrame,
                 keyword: str | None = None, status: str | None = None) -> DataFrame:
    """LST-16."""
    if keyword:
        product = product.filter(contains_ci("title", keyword))
    if status:
        product = product.filter(F.col("status") == F.lit(status))
    return (_product_rows(product, users, product_category)
            .select("product_id", "title", "price", "status", "publish_time", "seller_name", "category_name")
            .orderBy(F.desc("publish_time"), F.desc("product_id")))


def product_detail(product: DataFrame, users: DataFrame, product_category: DataFrame,
                   ids: DataFrame) -> DataFrame:
    """LST-17 for a table of requested ids."""
    wanted = product.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    return _product_rows(wanted, users, product_category).select(
        "product_id", "seller_user_id", "category_id", "title", "description", "price", "status",
        "publish_time", "seller_name", "category_name")


def seller_products(product: DataFrame, product_category: DataFrame) -> DataFrame:
    """LST-18: every seller's products, newest publish first."""
    return (product.join(product_category.select("category_id", "category_name"), "category_id")
            .select("seller_user_id", "product_id", "title", "price", "status", "publish_time", "category_name")
            .orderBy("seller_user_id", F.desc("publish_time"), F.desc("product_id")))


def order_history(trade_order: DataFrame, product: DataFrame, users: DataFrame) -> DataFrame:
    """LST-19: each user's orders as buyer or seller, with both party names
    (the user dimension joined twice under two aliases)."""
    buyers = users.select(F.col("user_id").alias("buyer_user_id"), F.col("username").alias("buyer_name"))
    sellers = users.select(F.col("user_id").alias("seller_user_id"), F.col("username").alias("seller_name"))
    rows = (_per_party(trade_order).join(product.select("product_id", "title", "price"), "product_id")
            .join(buyers, "buyer_user_id").join(sellers, "seller_user_id"))
    return (rows.select("user_id", "order_id", "order_status", "create_time", "finish_time", "product_id",
                        "title", "price", "buyer_name", "seller_name")
            .orderBy("user_id", F.desc("create_time"), F.desc("order_id")))


# -- community ---------------------------------------------------------------------------

def _post_counts(post_comment: DataFrame, post_like: DataFrame | None):
    comments = post_comment.groupBy("post_id").agg(F.count(F.lit(1)).alias("comment_count"))
    likes = None
    if post_like is not None:
        likes = post_like.groupBy("post_id").agg(F.count(F.lit(1)).alias("like_count"))
    return comments, likes


def _post_rows(post: DataFrame, users: DataFrame, post_category: DataFrame, post_comment: DataFrame,
               post_like: DataFrame | None) -> DataFrame:
    comments, likes = _post_counts(post_comment, post_like)
    rows = (post.join(comments, "post_id", "left")
            .join(users.select(F.col("user_id").alias("author_user_id"), F.col("username").alias("author_name")),
                  "author_user_id")
            .join(post_category.select("category_id", "category_name"), "category_id"))
    rows = rows.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))
    if likes is None:
        return rows.withColumn("like_count", F.lit(0).cast("long"))
    return rows.join(likes, "post_id", "left").withColumn("like_count", F.coalesce("like_count", F.lit(0)))


def post_feed(post: DataFrame, users: DataFrame, post_category: DataFrame, post_comment: DataFrame,
              post_like: DataFrame | None, keyword: str | None = None) -> DataFrame:
    """LST-20: visible posts with an 80-character preview and counts. A
    missing like table (SRC-2) gives ``like_count = 0`` through the same plan."""
    post = post.filter(F.col("status") == "visible")
    if keyword:
        post = post.filter(contains_ci("title", keyword))
    rows = _post_rows(post, users, post_category, post_comment, post_like)
    return (rows.select("post_id", "title", "status", "create_time", "author_name", "category_name",
                        F.substring("content", 1, 80).alias("content_preview"), "comment_count", "like_count")
            .orderBy(F.desc("create_time"), F.desc("post_id")))


def post_detail(post: DataFrame, users: DataFrame, post_category: DataFrame, post_comment: DataFrame,
                post_like: DataFrame | None, ids: DataFrame) -> DataFrame:
    """LST-21: full content for requested ids; hidden posts are included."""
    wanted = post.join(ids.select("post_id").distinct(), "post_id", "left_semi")
    rows = _post_rows(wanted, users, post_category, post_comment, post_like)
    return rows.select("post_id", "author_user_id", "title", "content", "create_time", "status", "author_name",
                       "category_name", "comment_count", "like_count")


def post_comments(post_comment: DataFrame, users: DataFrame) -> DataFrame:
    """LST-22: every thread, oldest first (comment_id breaks time ties)."""
    return (post_comment.join(users.select("user_id", "username"), "user_id")
            .select("post_id", "comment_id", "content", "create_time", "username")
            .orderBy("post_id", "create_time", "comment_id"))


def post_liked_flag(pairs: DataFrame, post_like: DataFrame) -> DataFrame:
    """LST-23: for each (post, user) asked about, whether a like exists."""
    likes = post_like.select("post_id", "user_id").distinct().withColumn("_hit", F.lit(True))
    asked = pairs.select("post_id", "user_id").distinct()
    return asked.join(likes, ["post_id", "user_id"], "left").select(
        "post_id", "user_id", F.col("_hit").isNotNull().alias("user_liked"))


def author_posts(post: DataFrame, post_category: DataFrame) -> DataFrame:
    """LST-24: every author's posts, newest first."""
    return (post.join(post_category.select("category_id", "category_name"), "category_id")
            .select("author_user_id", "post_id", "title", "status", "create_time", "category_name")
            .orderBy("author_user_id", F.desc("create_time"), F.desc("post_id")))


# -- identity and visibility --------------------------------------------------------------

def user_dim(users: DataFrame, student: DataFrame, club: DataFrame) -> DataFrame:
    """LST-25: user + ``student_id`` for students, + ``club_id`` for club
    accounts. A president of several clubs gets the smallest club id."""
    st = student.select(F.col("user_id"), F.col("student_id"))
    cl = club.filter(F.col("president_user_id").isNotNull()).groupBy(
        F.col("president_user_id").alias("user_id")).agg(F.min("club_id").alias("club_id"))
    rows = users.select("user_id", "username", "role", "phone").join(st, "user_id", "left").join(cl, "user_id", "left")
    return rows.select("user_id", "username", "role", "phone",
                       F.when(F.col("role") == "student", F.col("student_id")).alias("student_id"),
                       F.when(F.col("role") == "club", F.col("club_id")).alias("club_id"))


def can_manage(role: Column, user_club: Column, activity_club: Column) -> Column:
    """LST-26 as a predicate: admin, or a club account whose club owns it."""
    return (role == "admin") | ((role == "club") & (user_club == activity_club))


def manageable_activities(viewers: DataFrame, activity: DataFrame) -> DataFrame:
    """LST-26 as pairs for club accounts (an equi-join on club_id). Admins
    may manage every activity; that rule stays the predicate ``can_manage``
    instead of an admin x activity product."""
    clubs = viewers.filter((F.col("role") == "club") & F.col("club_id").isNotNull()).select("user_id", "club_id")
    return clubs.join(activity.select("activity_id", "club_id"), "club_id").select(
        "user_id", "activity_id", "club_id")


def pick_lists(venue: DataFrame, club: DataFrame, activity: DataFrame, viewers: DataFrame) -> DataFrame:
    """LST-5 (rest): the venue and club pick-lists by name, and the activity
    options a borrow form offers: every activity for an admin view (one list,
    not one copy per admin), the club's own for each club account."""
    venues = venue.select(F.lit("venue").alias("kind"), F.lit(None).cast("long").alias("viewer_user_id"),
                          F.col("venue_id").alias("item_id"), F.col("venue_name").alias("item_name"))
    clubs = club.select(F.lit("club").alias("kind"), F.lit(None).cast("long").alias("viewer_user_id"),
                        F.col("club_id").alias("item_id"), F.col("club_name").alias("item_name"))
    admin = activity.select(F.lit("activity_admin").alias("kind"), F.lit(None).cast("long").alias("viewer_user_id"),
                            F.col("activity_id").alias("item_id"), F.col("title").alias("item_name"))
    own = (viewers.filter(F.col("role") == "club").select(F.col("user_id").alias("viewer_user_id"), "club_id")
           .join(activity.select("activity_id", "club_id", "title"), "club_id")
           .select(F.lit("activity_club").alias("kind"), "viewer_user_id", F.col("activity_id").alias("item_id"),
                   F.col("title").alias("item_name")))
    return venues.unionByName(clubs).unionByName(admin).unionByName(own) \
        .orderBy("kind", "viewer_user_id", "item_name", F.desc("item_id"))
