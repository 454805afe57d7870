"""Data-quality jobs: the database constraints as violation reports, and
validation of incoming forms (DQ-1..9). Rules are data; every table is
checked in one pass that emits one row per broken rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.functions.scalar import collated, strip, strip_or_null
from quadflow.session import cut_lineage
from quadflow.sources.schemas import TABLES
from quadflow.sources.tables import with_defaults

# The CHECK constraints of the schema, as SQL predicates.
CHECKS: dict[str, list[tuple[str, str]]] = {
    "user_account": [("role_in", "role IN ('admin', 'club', 'student')")],
    "student": [("credit_range", "credit_score BETWEEN 0 AND 120")],
    "venue": [("capacity_pos", "capacity > 0"), ("status_in", "status IN ('available', 'unavailable')")],
    "activity": [("end_after_start", "end_time > start_time"), ("deadline_before_start", "signup_deadline <= start_time"),
                 ("capacity_pos", "max_capacity > 0"),
                 ("status_in", "status IN ('draft', 'published', 'ongoing', 'finished', 'cancelled')")],
    "activity_registration": [("audit_in", "audit_status IN ('approved', 'rejected', 'pending')"),
                              ("checkin_in", "checkin_status IN ('not_checked', 'checked', 'absent')"),
                              ("reg_in", "reg_status IN ('confirmed', 'waiting', 'cancelled')"),
                              ("queue_pos", "queue_no IS NULL OR queue_no > 0")],
    "checkin": [("status_in", "status IN ('checked', 'absent')")],
    "resource_item": [("total_nonneg", "total_qty >= 0"), ("available_nonneg", "available_qty >= 0"),
                      ("available_le_total", "available_qty <= total_qty"),
                      ("status_in", "status IN ('available', 'unavailable')")],
    "borrow_order": [("status_in", "order_status IN ('pending', 'approved', 'borrowed', 'returned', 'overdue')")],
    "borrow_detail": [("borrow_pos", "borrow_qty > 0"), ("returned_nonneg", "returned_qty >= 0"),
                      ("damage_nonneg", "damage_qty >= 0"), ("returned_le_borrow", "returned_qty <= borrow_qty"),
                      ("damage_le_borrow", "damage_qty <= borrow_qty")],
    "penalty": [("type_in", "penalty_type IN ('no_show', 'overdue', 'damage')"),
                ("status_in", "status IN ('unpaid', 'paid', 'closed')")],
    "product_category": [("status_in", "status IN ('active', 'inactive')")],
    "product": [("price_nonneg", "price >= 0"), ("status_in", "status IN ('on_sale', 'locked', 'sold', 'removed')")],
    "trade_order": [("status_in", "order_status IN ('created', 'cancelled', 'completed')"),
                    ("buyer_ne_seller", "buyer_user_id <> seller_user_id")],
    "post_category": [("status_in", "status IN ('active', 'inactive')")],
    "post": [("status_in", "status IN ('visible', 'hidden')")],
}

# Foreign keys as (child table, column, parent table, parent key).
FOREIGN_KEYS = [
    ("club", "president_user_id", "user_account", "user_id"),
    ("student", "user_id", "user_account", "user_id"),
    ("activity", "club_id", "club", "club_id"),
    ("activity", "venue_id", "venue", "venue_id"),
    ("activity_registration", "activity_id", "activity", "activity_id"),
    ("activity_registration", "student_id", "student", "student_id"),
    ("checkin", "reg_id", "activity_registration", "reg_id"),
    ("checkin", "operator_id", "user_account", "user_id"),
    ("resource_item", "owner_club_id", "club", "club_id"),
    ("borrow_order", "activity_id", "activity", "activity_id"),
    ("borrow_order", "applicant_user_id", "user_account", "user_id"),
    ("borrow_detail", "order_id", "borrow_order", "order_id"),
    ("borrow_detail", "resource_id", "resource_item", "resource_id"),
    ("penalty", "student_id", "student", "student_id"),
    ("penalty", "activity_id", "activity", "activity_id"),
    ("penalty", "order_id", "borrow_order", "order_id"),
    ("product", "seller_user_id", "user_account", "user_id"),
    ("product", "category_id", "product_category", "category_id"),
    ("trade_order", "product_id", "product", "product_id"),
    ("trade_order", "buyer_user_id", "user_account", "user_id"),
    ("trade_order", "seller_user_id", "user_account", "user_id"),
    ("post", "author_user_id", "user_account", "user_id"),
    ("post", "category_id", "post_category", "category_id"),
    ("post_comment", "post_id", "post", "post_id"),
    ("post_comment", "user_id", "user_account", "user_id"),
    ("post_like", "post_id", "post", "post_id"),
    ("post_like", "user_id", "user_account", "user_id"),
]

# Unique keys as (table, name, columns, case-insensitive text).
UNIQUE_KEYS = [
    ("user_account", "username", ["username"], True),
    ("club", "club_name", ["club_name"], True),
    ("student", "user_id", ["user_id"], False),
    ("student", "student_no", ["student_no"], True),
    ("activity_registration", "activity_student", ["activity_id", "student_id"], False),
    ("borrow_order", "order_uid", ["order_uid"], True),
    ("product_category", "category_name", ["category_name"], True),
    ("post_category", "category_name", ["category_name"], True),
    ("post_like", "post_user", ["post_id", "user_id"], False),
]

# VARCHAR lengths of the schema.
LENGTHS: dict[str, dict[str, int]] = {
    "user_account": {"username": 50, "role": 20, "phone": 20},
    "club": {"club_name": 100, "contact_phone": 20, "office_location": 100},
    "student": {"student_no": 30, "real_name": 50, "grade": 20, "major": 50},
    "venue": {"venue_name": 100, "location": 100, "status": 20},
    "activity": {"title": 200, "category": 50, "status": 20},
    "activity_registration": {"audit_status": 20, "checkin_status": 20, "reg_status": 20},
    "checkin": {"status": 20},
    "resource_item": {"item_name": 100, "category": 50, "unit": 20, "status": 20},
    "borrow_order": {"order_uid": 32, "order_status": 20},
    "penalty": {"penalty_type": 30, "reason": 200, "status": 20},
    "product_category": {"category_name": 50, "status": 20},
    "product": {"title": 120, "status": 20},
    "trade_order": {"order_status": 20},
    "post_category": {"category_name": 50, "status": 20},
    "post": {"title": 150, "status": 20},
    "post_comment": {"content": 500},
}


def key_of(table: str) -> str:
    return TABLES[table].fieldNames()[0]


def _explode_rules(df: DataFrame, table: str, rules: list[tuple[str, object]]) -> DataFrame:
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return df.select(F.lit(table).alias("table_name"), F.col(key_of(table)).cast("long").alias("row_key"),
                     F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("rule"))


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-1: ``rule IS FALSE`` per row (a NULL result passes, as in SQL)."""
    out = None
    for table, rules in CHECKS.items():
        part = _explode_rules(tables[table], table, [(n, F.expr(f"({r}) IS FALSE")) for n, r in rules])
        out = part if out is None else out.unionByName(part)
    return out


def foreign_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-2: non-NULL child keys without a parent. All child keys that point
    at the same parent are stacked and checked with one anti join per parent
    table (12 joins for 27 keys)."""
    by_parent: dict[tuple[str, str], list[DataFrame]] = {}
    for child, col, parent, pkey in FOREIGN_KEYS:
        refs = tables[child].filter(F.col(col).isNotNull()).select(
            F.lit(child).alias("table_name"), F.lit(f"{col}->{parent}").alias("foreign_key"),
            F.col(key_of(child)).cast("long").alias("row_key"), F.col(col).cast("long").alias("value"))
        by_parent.setdefault((parent, pkey), []).append(refs)
    out = None
    for (parent, pkey), parts in by_parent.items():
        refs = parts[0]
        for extra in parts[1:]:
            refs = refs.unionByName(extra)
        keys = tables[parent].select(F.col(pkey).cast("long").alias("value")).distinct()
        bad = refs.join(keys, "value", "left_anti").select("table_name", "foreign_key", "row_key", "value")
        out = bad if out is None else out.unionByName(bad)
    return out


def audit_key_violations(audit: DataFrame, users: DataFrame) -> DataFrame:
    """DQ-2 (28th key): audit rows whose operator is not a user."""
    known = users.select(F.col("user_id").alias("operator_id"))
    bad = audit.select("biz_type", "biz_id", "operator_id").filter(F.col("operator_id").isNotNull()).join(known, "operator_id", "left_anti")
    return bad.select(F.lit("audit_log").alias("table_name"), F.lit("operator_id->user_account").alias("foreign_key"),
                      "biz_type", "biz_id", F.col("operator_id").alias("value"))


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-3: duplicate key groups; NULL keys are exempt; text keys compare
    case- and accent-insensitively (the database collation)."""
    out = None
    for table, name, cols, ci in UNIQUE_KEYS:
        df = tables[table].dropna(subset=cols)
        if ci:
            group = [collated(cols[0]).alias("_k")]
            value = F.min(F.col(cols[0]).cast("string"))
        else:
            group = [F.col(c) for c in cols]
            value = F.concat_ws(",", *[F.first(F.col(c).cast("string")) for c in cols])
        dup = df.groupBy(*group).agg(value.alias("key_value"), F.count(F.lit(1)).alias("dup_count")) \
            .filter(F.col("dup_count") > 1)
        part = dup.select(F.lit(table).alias("table_name"), F.lit(name).alias("key_name"), "key_value", "dup_count")
        out = part if out is None else out.unionByName(part)
    return out


def not_null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-4: required columns that are NULL and text longer than its length."""
    out = None
    for table, schema in TABLES.items():
        if table not in tables:
            continue
        rules = [(f"{f.name}_not_null", F.col(f.name).isNull()) for f in schema.fields if not f.nullable]
        rules += [(f"{c}_length", F.coalesce(F.char_length(c) > n, F.lit(False)))
                  for c, n in LENGTHS.get(table, {}).items()]
        part = _explode_rules(tables[table], table, rules)
        out = part if out is None else out.unionByName(part)
    return out


def _digits(c):
    return F.coalesce(strip(c).rlike(r"\A[0-9]+\z"), F.lit(False))


# Fixed value: text that reads as a float, infinities and NaN included.
NUMBER = (r"(?i)\A[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\z")


def _with_rejected(made: DataFrame, forms: DataFrame, *kept: str) -> DataFrame:
    """The inserted rows and, with nulls for their columns, the refused forms."""
    bad = forms.filter(F.col("outcome") != "created").select("request_id", "outcome", *kept)
    return made.unionByName(bad, allowMissingColumns=True)


def ingest_products(forms: DataFrame, product: DataFrame, product_category: DataFrame) -> DataFrame:
    """DQ-6: product forms. Title and digit category, then a price that
    parses as a number, then the database (category FK, price >= 0).
    Prices are stored as DECIMAL(10,2), rounded half-up; infinities, NaN and
    prices out of that range are the database's errors. The inserted rows are
    whole: an omitted status is on_sale, an omitted publish time the request's."""
    from quadflow.operators.settlement import _ids
    x = forms.withColumn("_cat", strip("category_id").try_cast("long")) \
        .withColumn("_number", F.coalesce(strip("price").rlike(NUMBER), F.lit(False))) \
        .withColumn("_price", F.regexp_replace(strip("price"), "_", "").try_cast("double").try_cast("decimal(10,2)")) \
        .join(product_category.select(F.col("category_id").alias("_cat"), F.lit(True).alias("_has_cat")), "_cat", "left")
    reason = (F.when(~(F.coalesce(strip("title") != "", F.lit(False)) & _digits(F.col("category_id"))), "invalid_form")
              .when(~F.col("_number"), "bad_price")
              .when(F.col("_has_cat").isNull() | F.coalesce(F.col("_price") < 0, F.lit(True))
                    | (F.char_length(strip("title")) > 120), "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    made = _ids(x.filter(F.col("outcome") == "created"), product.select(F.max("product_id")).scalar(), "product_id",
                ["ts", "request_id"])
    made = with_defaults(made, {"status": F.lit("on_sale"), "publish_time": F.col("ts"), "description": F.lit(None).cast("string")}).select(
        "request_id", "outcome", "product_id", F.col("actor_user_id").alias("seller_user_id"), F.col("_cat").alias("category_id"),
        strip("title").alias("title"), strip_or_null("description").alias("description"), F.col("_price").alias("price"), "status", "publish_time")
    return _with_rejected(made, x)


def ingest_comments(forms: DataFrame, post: DataFrame, post_comment: DataFrame) -> DataFrame:
    """DQ-7: comments need non-blank content and an existing post (any
    status); the database rejects content over 500 characters."""
    from quadflow.operators.settlement import _ids
    content = strip("content")
    x = forms.join(post.select("post_id", F.lit(True).alias("_has")), "post_id", "left")
    reason = (F.when(F.coalesce(content == "", F.lit(True)), "empty").when(F.col("_has").isNull(), "post_not_found")
              .when(F.char_length(content) > 500, "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    made = _ids(x.filter(F.col("outcome") == "created"), post_comment.select(F.max("comment_id")).scalar(),
                "comment_id", ["ts", "request_id"])
    made = with_defaults(made, {"create_time": F.col("ts")}).select(
        "request_id", "outcome", "comment_id", "post_id", F.col("actor_user_id").alias("user_id"), content.alias("content"), "create_time")
    return _with_rejected(made, x.withColumnRenamed("actor_user_id", "user_id"), "post_id", "user_id")


def _greedy_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows accepted by an ordered greedy pass over several unique keys: a
    row is kept exactly when no earlier *kept* row shares any of its keys.

    A conflict graph instead of a row-by-row pass. An undecided row that is the
    first of all its keys is kept. One that is the second of one key and the
    first of the others depends on that key's first row alone: it is kept if
    that one isn't. Such links form chains, which pointer doubling follows to
    their ends, so a chain of n rows takes log2(n) steps; the parity of its
    distance to a kept end decides a row. Rows that share a key with a kept row
    are dropped, and what is left, rows that wait for several others, goes into
    another round. The earliest undecided row is always decided, so it ends."""
    order = F.struct("ts", "request_id")
    undecided = cut_lineage(rows.select("request_id", "ts", *keys))
    kept = undecided.limit(0)
    while not undecided.isEmpty():
        links = undecided
        for i, k in enumerate(keys):
            first = undecided.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first{i}"))
            links = links.join(first, k, "left")
        for i, k in enumerate(keys):
            later = links.filter(F.col(k).isNotNull() & (order > F.col(f"_first{i}")))
            links = links.join(later.groupBy(k).agg(F.min(order).alias(f"_second{i}")), k, "left")
        n = len(keys)
        lead = [(F.col(k).isNull() | (order == F.col(f"_first{i}"))).cast("int") for i, k in enumerate(keys)]
        leads = sum(lead[1:], lead[0])
        before = F.coalesce(*[F.when(order == F.col(f"_second{i}"), F.col(f"_first{i}.request_id")) for i in range(n)])
        to = F.when((leads == n - 1) & before.isNotNull(), before).otherwise(F.col("request_id"))
        links = cut_lineage(links.select("request_id", "ts", *keys, to.alias("_to"), (leads == n).alias("_end")))
        hops = links.select("request_id", "_to", (F.col("_to") != F.col("request_id")).alias("_odd"))
        while True:
            onward = hops.select(F.col("request_id").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_more"))
            step = hops.join(onward, "_to").select(
                "request_id", F.col("_next").alias("_to"), (F.col("_odd") != F.col("_more")).alias("_odd"), (F.col("_next") != F.col("_to")).alias("_moved"))
            step = cut_lineage(step)
            hops = step.drop("_moved")
            if step.filter("_moved").isEmpty():
                break
        ends = links.select(F.col("request_id").alias("_to"), F.col("_end").alias("_decided"))
        decided = links.drop("_to", "_end").join(hops, "request_id").join(ends, "_to")
        decided = cut_lineage(decided.select("request_id", "ts", *keys, "_decided", "_odd"))
        won = decided.filter("_decided and not _odd").select("request_id", "ts", *keys)
        rest = decided.filter("not _decided").select("request_id", "ts", *keys)
        for k in keys:  # null keys never match, so their rows survive
            rest = rest.join(won.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        undecided = cut_lineage(rest)
        kept = kept.unionByName(won)
    return kept


def ingest_users(forms: DataFrame, users: DataFrame, student: DataFrame) -> DataFrame:
    """DQ-8: sign-ups. Username and password, role student or club, username
    unused (existing or taken by an earlier accepted sign-up) and within the
    column lengths, then students need a number and a name, within the column
    lengths, and the student number must be unused too (a clash rolls the whole
    sign-up back, so it takes no username). Two unique keys make acceptance an
    ordered greedy choice: ``_greedy_unique``. Names and numbers are compared
    under the database's collation. A club sign-up creates no club row. The
    inserted user and student rows are whole, defaults included."""
    from quadflow.operators.settlement import _ids
    is_student = F.coalesce(strip("role") == "student", F.lit(False))
    taken = users.select(collated("username").alias("_name")).distinct().withColumn("_exists", F.lit(True))
    numbers = student.select(collated("student_no").alias("_sno")).distinct().withColumn("_sno_exists", F.lit(True))
    optional = {c: strip_or_null(c) if c in forms.columns else F.lit(None).cast("string") for c in ("phone", "grade", "major")}
    x = (forms.withColumns(optional).withColumn("_name", collated(strip("username")))
         .withColumn("_sno", F.when(is_student, collated(strip("student_no"))))
         .join(taken, "_name", "left").join(numbers, "_sno", "left"))
    form_ok = F.coalesce((strip("username") != "") & (strip("password") != ""), F.lit(False))
    role_ok = F.coalesce(strip("role").isin("student", "club"), F.lit(False))
    student_ok = ~is_student | F.coalesce((strip("student_no") != "") & (strip("real_name") != ""), F.lit(False))
    lengths = LENGTHS | {"user_account": LENGTHS["user_account"] | {"password": 100}}
    fits = lambda table, *cols: ~F.greatest(*[F.coalesce(F.char_length(strip(c)) > lengths[table][c], F.lit(False)) for c in cols])
    user_fits = fits("user_account", "username", "password", "phone")
    student_fits = ~is_student | fits("student", "student_no", "real_name", "grade", "major")
    static = form_ok & role_ok & student_ok & user_fits & student_fits & F.col("_exists").isNull() & F.col("_sno_exists").isNull()
    kept = _greedy_unique(x.filter(static), ["_name", "_sno"])
    by_name = kept.groupBy("_name").agg(F.min(F.struct("ts", "request_id")).alias("_first_name"))
    by_sno = kept.filter(F.col("_sno").isNotNull()).groupBy("_sno").agg(
        F.min(F.struct("ts", "request_id")).alias("_first_sno"))
    x = x.join(by_name, "_name", "left").join(by_sno, "_sno", "left")
    key = F.struct("ts", "request_id")
    name_taken = F.col("_exists").isNotNull() | (F.col("_first_name").isNotNull() & (F.col("_first_name") < key))
    sno_taken = is_student & (F.col("_sno_exists").isNotNull()
                              | (F.col("_first_sno").isNotNull() & (F.col("_first_sno") < key)))
    reason = (F.when(~form_ok, "invalid_form").when(~role_ok, "bad_role").when(name_taken, "username_taken").when(~user_fits, "db_error")
              .when(~student_ok, "student_fields_missing").when(sno_taken | ~student_fits, "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    made = _ids(x.filter(F.col("outcome") == "created"), users.select(F.max("user_id")).scalar(), "user_id", ["ts", "request_id"])
    studs = _ids(made.filter(strip("role") == "student"), student.select(F.max("student_id")).scalar(), "student_id", ["ts", "request_id"])
    studs = with_defaults(studs, {"points": F.lit(0), "violation_count": F.lit(0), "credit_score": F.lit(100)}).select(
        "request_id", "student_id", strip("student_no").alias("student_no"), strip("real_name").alias("real_name"), "grade", "major",
        "points", "violation_count", "credit_score")
    own = with_defaults(made, {"create_time": F.col("ts")}).select(
        "request_id", "outcome", "user_id", strip("username").alias("username"), strip("role").alias("role"), "phone", "create_time")
    return _with_rejected(own.join(studs, "request_id", "left"), x)


def ingest_posts(forms: DataFrame, post: DataFrame, post_category: DataFrame) -> DataFrame:
    """DQ-7 (posts): non-blank title and content and a digit category, then
    the database (category FK, title within 150 characters). New posts are
    visible."""
    from quadflow.operators.settlement import _ids
    x = forms.withColumn("_cat", strip("category_id").try_cast("long")).join(
        post_category.select(F.col("category_id").alias("_cat"), F.lit(True).alias("_has_cat")), "_cat", "left")
    form_ok = (F.coalesce(strip("title") != "", F.lit(False)) & F.coalesce(strip("content") != "", F.lit(False))
               & _digits(F.col("category_id")))
    reason = (F.when(~form_ok, "invalid_form")
              .when(F.col("_has_cat").isNull() | (F.char_length(strip("title")) > 150), "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    made = _ids(x.filter(F.col("outcome") == "created"), post.select(F.max("post_id")).scalar(), "post_id",
                ["ts", "request_id"])
    made = with_defaults(made, {"status": F.lit("visible"), "create_time": F.col("ts")}).select(
        "request_id", "outcome", "post_id", F.col("actor_user_id").alias("author_user_id"), F.col("_cat").alias("category_id"),
        strip("title").alias("title"), strip("content").alias("content"), "status", "create_time")
    return _with_rejected(made, x)
