"""Registered data-quality jobs (DQ-1..4, DQ-6..8). DQ-5 and DQ-9 live with
the transitions they feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadflow.operators import quality as Q
from quadflow.plans.catalog import query
from quadflow.plans.domain_sql import strip_sql
from quadflow.sources.domain import EPOCH, plus, ts_lit
from quadflow.sources.schemas import TABLES

_E = f"TIMESTAMP '{EPOCH}'"
_ALL = list(TABLES)


def _tables(c):
    return {n: c.table(n) for n in _ALL if n != "audit_log"}


def _check_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, CAST({Q.key_of(t)} AS BIGINT) AS row_key, '{n}' AS rule FROM {t} "
             f"WHERE ({r}) IS FALSE" for t, rules in Q.CHECKS.items() for n, r in rules]
    return "\nUNION ALL\n".join(parts)


def _fk_sql() -> str:
    parts = [f"SELECT '{ch}' AS table_name, '{col}->{pa}' AS foreign_key, CAST({Q.key_of(ch)} AS BIGINT) AS row_key, "
             f"CAST({col} AS BIGINT) AS value FROM {ch} WHERE {col} IS NOT NULL "
             f"AND {col} NOT IN (SELECT {pk} FROM {pa} WHERE {pk} IS NOT NULL)"
             for ch, col, pa, pk in Q.FOREIGN_KEYS]
    return "\nUNION ALL\n".join(parts)


def _unique_sql() -> str:
    parts = []
    for t, name, cols, ci in Q.UNIQUE_KEYS:
        notnull = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        if ci:
            parts.append(f"SELECT '{t}' AS table_name, '{name}' AS key_name, min(CAST({cols[0]} AS VARCHAR)) AS key_value, "
                         f"count(*) AS dup_count FROM {t} WHERE {notnull} GROUP BY lower(strip_accents({cols[0]})) "
                         f"HAVING count(*) > 1")
        else:
            value = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
            parts.append(f"SELECT '{t}' AS table_name, '{name}' AS key_name, {value} AS key_value, count(*) AS dup_count "
                         f"FROM {t} WHERE {notnull} GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


def _not_null_sql() -> str:
    parts = []
    for t, schema in TABLES.items():
        if t == "audit_log":
            continue
        key = Q.key_of(t)
        for f in schema.fields:
            if not f.nullable:
                parts.append(f"SELECT '{t}' AS table_name, CAST({key} AS BIGINT) AS row_key, '{f.name}_not_null' AS rule "
                             f"FROM {t} WHERE {f.name} IS NULL")
        for c, n in Q.LENGTHS.get(t, {}).items():
            parts.append(f"SELECT '{t}' AS table_name, CAST({key} AS BIGINT) AS row_key, '{c}_length' AS rule "
                         f"FROM {t} WHERE length({c}) > {n}")
    return "\nUNION ALL\n".join(parts)


@query("dq_check", _check_sql())
def dq_check(c, r):
    """DQ-1: CHECK constraints over every table."""
    return Q.check_violations(_tables(c))


@query("dq_foreign_key", _fk_sql())
def dq_foreign_key(c, r):
    """DQ-2: foreign keys over every table."""
    return Q.foreign_key_violations(_tables(c))


@query("dq_unique", _unique_sql())
def dq_unique(c, r):
    """DQ-3: unique keys over every table."""
    return Q.unique_violations(_tables(c))


@query("dq_not_null", _not_null_sql())
def dq_not_null(c, r):
    """DQ-4: NOT NULL and VARCHAR lengths over every table."""
    return Q.not_null_violations(_tables(c))


# Tables as a careless import would leave them: every few rows break a rule.

def _broken(c):
    t = _tables(c)
    k = F.col
    rows = {
        "student": t["student"].withColumn("credit_score", k("credit_score") + F.when(k("student_id") % 11 == 0, 121).when(k("student_id") % 13 == 0, -121).otherwise(0)),
        "venue": t["venue"].withColumn("capacity", F.when(k("venue_id") % 5 == 0, 0).otherwise(k("capacity")))
                           .withColumn("status", F.when(k("venue_id") % 4 == 0, "closed").otherwise(k("status"))),
        "activity": t["activity"].withColumn("end_time", F.when(k("activity_id") % 17 == 0, k("start_time")).otherwise(k("end_time")))
                                 .withColumn("signup_deadline", plus(k("signup_deadline"), "DAY", F.when(k("activity_id") % 19 == 0, 2).otherwise(0)))
                                 .withColumn("status", F.when(k("activity_id") % 23 == 0, F.lit(None).cast("string")).otherwise(F.upper("status"))),
        "resource_item": t["resource_item"].withColumn("available_qty", k("available_qty") * F.when(k("resource_id") % 3 == 0, 100).when(k("resource_id") % 5 == 0, -1).otherwise(1)),
        "borrow_detail": t["borrow_detail"].withColumn("returned_qty", k("returned_qty") + F.when(k("detail_id") % 7 == 0, 1).otherwise(0))
                                           .withColumn("damage_qty", k("damage_qty") - F.when(k("detail_id") % 29 == 0, 1).otherwise(0)),
        "trade_order": t["trade_order"].withColumn("buyer_user_id", F.when(k("order_id") % 31 == 0, k("seller_user_id")).otherwise(k("buyer_user_id"))),
        "user_account": t["user_account"].withColumn("username", F.when(k("user_id") % 10 == 3, F.concat(F.lit("\u00c9va_"), F.floor(k("user_id") / 40)))
                                                     .when(k("user_id") % 10 == 7, F.concat(F.lit("eva_"), F.floor(k("user_id") / 40))).otherwise(k("username"))),
        "post_like": t["post_like"].unionByName(t["post_like"].filter(k("like_id") % 9 == 0).withColumn("like_id", -k("like_id"))),
    }
    return t | rows


_BROKEN_SQL = """
WITH b_student AS (SELECT student_id, credit_score + CASE WHEN student_id % 11 = 0 THEN 121 WHEN student_id % 13 = 0 THEN -121 ELSE 0 END AS score FROM student),
b_venue AS (SELECT venue_id, CASE WHEN venue_id % 5 = 0 THEN 0 ELSE capacity END AS seats, CASE WHEN venue_id % 4 = 0 THEN 'closed' ELSE status END AS state FROM venue),
b_activity AS (SELECT activity_id, start_time AS a, CASE WHEN activity_id % 17 = 0 THEN start_time ELSE end_time END AS z,
                      signup_deadline + to_days(CASE WHEN activity_id % 19 = 0 THEN 2 ELSE 0 END) AS last_call,
                      CASE WHEN activity_id % 23 <> 0 THEN upper(status) END AS state FROM activity),
b_item AS (SELECT resource_id, total_qty, available_qty * CASE WHEN resource_id % 3 = 0 THEN 100 WHEN resource_id % 5 = 0 THEN -1 ELSE 1 END AS here FROM resource_item),
b_detail AS (SELECT detail_id, borrow_qty, returned_qty + CASE WHEN detail_id % 7 = 0 THEN 1 ELSE 0 END AS back,
                    damage_qty - CASE WHEN detail_id % 29 = 0 THEN 1 ELSE 0 END AS broken FROM borrow_detail),
b_trade AS (SELECT order_id, seller_user_id, CASE WHEN order_id % 31 = 0 THEN seller_user_id ELSE buyer_user_id END AS buyer FROM trade_order)"""


@query("dq_check_import", _BROKEN_SQL + """
SELECT 'student' AS table_name, student_id AS row_key, 'credit_range' AS rule FROM b_student WHERE score < 0 OR score > 120
UNION ALL SELECT 'venue', venue_id, 'capacity_pos' FROM b_venue WHERE seats <= 0
UNION ALL SELECT 'venue', venue_id, 'status_in' FROM b_venue WHERE state = 'closed'
UNION ALL SELECT 'activity', activity_id, 'end_after_start' FROM b_activity WHERE z <= a
UNION ALL SELECT 'activity', activity_id, 'deadline_before_start' FROM b_activity WHERE last_call > a
UNION ALL SELECT 'activity', activity_id, 'status_in' FROM b_activity WHERE state IS NOT NULL
UNION ALL SELECT 'resource_item', resource_id, 'available_nonneg' FROM b_item WHERE here < 0
UNION ALL SELECT 'resource_item', resource_id, 'available_le_total' FROM b_item WHERE here > total_qty
UNION ALL SELECT 'borrow_detail', detail_id, 'returned_le_borrow' FROM b_detail WHERE back > borrow_qty
UNION ALL SELECT 'borrow_detail', detail_id, 'damage_nonneg' FROM b_detail WHERE broken < 0
UNION ALL SELECT 'trade_order', order_id, 'buyer_ne_seller' FROM b_trade WHERE buyer = seller_user_id""")
def dq_check_import(c, r):
    """DQ-1 over tables whose every few rows break a rule (a NULL result passes); the oracle states each broken rule by itself."""
    return Q.check_violations(_broken(c))


@query("dq_unique_import", """
WITH names AS (SELECT CASE user_id % 10 WHEN 3 THEN chr(201) || 'va_' || (user_id // 40) WHEN 7 THEN 'eva_' || (user_id // 40) ELSE username END AS name FROM user_account),
twice AS (SELECT post_id, user_id FROM post_like WHERE like_id % 9 = 0)
SELECT 'user_account' AS table_name, 'username' AS key_name, min(name) AS key_value, count(*) AS dup_count
FROM names GROUP BY lower(strip_accents(name)) HAVING count(*) > 1
UNION ALL
SELECT 'post_like', 'post_user', post_id || ',' || user_id, 2 FROM twice""")
def dq_unique_import(c, r):
    """DQ-3 over tables with repeated likes and names that differ in accents and case only."""
    return Q.unique_violations(_broken(c))


@query("dq_audit_import", """
SELECT 'audit_log' AS table_name, 'operator_id->user_account' AS foreign_key, 'borrow_order' AS biz_type, order_id AS biz_id, applicant_user_id AS value
FROM (SELECT order_id, CASE WHEN order_id % 37 = 0 THEN -order_id ELSE applicant_user_id END AS applicant_user_id, order_status, expected_return_time FROM borrow_order)
WHERE order_status = 'borrowed' AND expected_return_time < TIMESTAMP '2024-01-20 00:00:00' AND applicant_user_id < 0""")
def dq_audit_import(c, r):
    """DQ-2 (28th key) over the audit rows of a sweep whose orders partly name applicants that don't exist."""
    from quadflow.operators import settlement as S
    from quadflow.sources.domain import AS_OF
    odd = F.when(F.col("order_id") % 37 == 0, -F.col("order_id")).otherwise(F.col("applicant_user_id"))
    before = c.borrow_order.withColumn("applicant_user_id", odd)
    after, _ = S.overdue_sweep(before, c.penalty, c.student, ts_lit(AS_OF))
    return Q.audit_key_violations(S.audit_orders(before, after, ts_lit(AS_OF)), c.user_account)


# Forms with what users send: fields of blanks and tabs, nulls, too long texts,
# numbers that are none, names that differ in accents only.

def _product_forms(c):
    k = F.col("p_partkey")
    title = (F.when(k % 17 == 0, F.lit(" \t")).when(k % 17 == 1, F.concat(F.lit("\n"), F.col("p_name"), F.lit("\t")))
             .when(k % 29 == 0, F.repeat(F.lit("t"), F.lit(120) + (k % 2).cast("int"))).otherwise(F.col("p_name")))
    cat = F.when(k % 19 == 0, F.lit("x")).when(k % 19 == 1, F.lit("\t3\n")).otherwise((F.col("p_size") % 8).cast("string"))
    odd = {23: "abc", 31: "-5", 41: "1e12", 43: " 7.005\t", 47: "nan", 53: "1_0.5", 59: "-Infinity", 61: "5d"}
    price = F.when(k % 37 == 0, F.lit(None).cast("string"))
    for n, text in odd.items():
        price = price.when(k % n == 0, F.lit(text))
    return c.raw("part").select(k.alias("request_id"), plus(ts_lit(EPOCH), "HOUR", k % 500).alias("ts"),
                                (k % c.n_user).alias("actor_user_id"), title.alias("title"), cat.alias("category_id"),
                                price.otherwise(F.col("p_retailprice").cast("string")).alias("price"),
                                F.when(k % 3 == 1, F.lit(" \t")).when(k % 3 == 2, F.lit("\tlike new ")).alias("description"))


_NUMBER_SQL = (r"(?i)[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)")


@query("ingest_product", f"""
WITH q AS (SELECT p_partkey AS request_id, {_E} + to_hours(CAST(p_partkey % 500 AS BIGINT)) AS ts,
                  p_partkey % (SELECT count(*) FROM customer) AS actor_user_id,
                  CASE WHEN p_partkey % 17 = 0 THEN ' ' || chr(9) WHEN p_partkey % 17 = 1 THEN chr(10) || p_name || chr(9)
                       WHEN p_partkey % 29 = 0 THEN repeat('t', 120 + p_partkey % 2) ELSE p_name END AS title,
                  CASE WHEN p_partkey % 19 = 0 THEN 'x' WHEN p_partkey % 19 = 1 THEN chr(9) || '3' || chr(10)
                       ELSE CAST(p_size % 8 AS VARCHAR) END AS category_id,
                  CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'abc' WHEN p_partkey % 31 = 0 THEN '-5'
                       WHEN p_partkey % 41 = 0 THEN '1e12' WHEN p_partkey % 43 = 0 THEN ' 7.005' || chr(9) WHEN p_partkey % 47 = 0 THEN 'nan'
                       WHEN p_partkey % 53 = 0 THEN '1_0.5' WHEN p_partkey % 59 = 0 THEN '-Infinity' WHEN p_partkey % 61 = 0 THEN '5d'
                       ELSE CAST(p_retailprice AS VARCHAR) END AS price,
                  CASE p_partkey % 3 WHEN 1 THEN ' ' || chr(9) WHEN 2 THEN chr(9) || 'like new ' END AS description
           FROM part),
x AS (SELECT q.* REPLACE ({strip_sql("title")} AS title, {strip_sql("q.category_id")} AS category_id, {strip_sql("price")} AS price,
                          nullif({strip_sql("description")}, '') AS description) FROM q),
v AS (SELECT x.*, TRY_CAST(x.category_id AS BIGINT) AS cat, pc.category_id IS NOT NULL AS has_cat,
             COALESCE(regexp_full_match(x.price, '{_NUMBER_SQL}'), false) AS is_number,
             TRY_CAST(replace(x.price, '_', '') AS DECIMAL(10,2)) AS pr
      FROM x LEFT JOIN product_category pc ON pc.category_id = TRY_CAST(x.category_id AS BIGINT)),
y AS (SELECT *, CASE WHEN NOT (COALESCE(title <> '', false) AND COALESCE(regexp_full_match(category_id, '[0-9]+'), false)) THEN 'invalid_form'
                     WHEN NOT is_number THEN 'bad_price'
                     WHEN NOT has_cat OR pr IS NULL OR pr < 0 OR length(title) > 120 THEN 'db_error' ELSE 'created' END AS outcome FROM v),
z AS (SELECT *, (SELECT max(product_id) FROM product) + row_number() OVER (ORDER BY ts, request_id) AS product_id FROM y WHERE outcome = 'created')
SELECT request_id, outcome, product_id, actor_user_id AS seller_user_id, cat AS category_id, title, description, pr AS price,
       'on_sale' AS status, ts AS publish_time FROM z
UNION ALL
SELECT request_id, outcome, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM y WHERE outcome <> 'created'""")
def ingest_product(c, r):
    """DQ-6: product creation forms derived from every part; whole inserted rows."""
    return Q.ingest_products(_product_forms(c), c.product, c.table("product_category"))


@query("ingest_comment", f"""
WITH q AS (SELECT comment_id AS request_id, create_time AS ts, user_id, post_id * 11 AS post_id,
                  CASE WHEN comment_id % 13 = 0 THEN chr(9) || ' ' WHEN comment_id % 13 = 1 THEN NULL ELSE chr(10) || content || chr(9) END AS content
           FROM post_comment),
x AS (SELECT q.* REPLACE ({strip_sql("content")} AS content) FROM q),
y AS (SELECT *, CASE WHEN COALESCE(content = '', true) THEN 'empty' WHEN post_id NOT IN (SELECT post_id FROM post) THEN 'post_not_found'
                     WHEN length(content) > 500 THEN 'db_error' ELSE 'created' END AS outcome FROM x),
z AS (SELECT *, (SELECT max(comment_id) FROM post_comment) + row_number() OVER (ORDER BY ts, request_id) AS comment_id FROM y WHERE outcome = 'created')
SELECT request_id, outcome, comment_id, post_id, user_id, content, ts AS create_time FROM z
UNION ALL
SELECT request_id, outcome, NULL, post_id, user_id, NULL, NULL FROM y WHERE outcome <> 'created'""")
def ingest_comment(c, r):
    """DQ-7: every conversation turn posted as a comment on post conv*11; whole inserted rows."""
    k = F.col("comment_id")
    content = F.when(k % 13 == 0, "\t ").when(k % 13 != 1, F.concat(F.lit("\n"), F.col("content"), F.lit("\t")))
    forms = c.post_comment.select(k.alias("request_id"), F.col("create_time").alias("ts"),
                                  F.col("user_id").alias("actor_user_id"), (F.col("post_id") * 11).alias("post_id"),
                                  content.alias("content"))
    return Q.ingest_comments(forms, c.post, c.post_comment)


def _user_forms(c):
    k = F.col("c_custkey")
    pair = F.floor((k - F.when(k % 13 == 2, 1).otherwise(0)) / 26).cast("string")
    name = (F.when(k % 11 == 0, F.upper("c_name")).when(k % 13 == 1, F.concat(F.lit("Jos\u00e9_"), pair))
            .when(k % 13 == 2, F.concat(F.lit("\tJOSE_"), pair)).when(k % 37 == 0, F.repeat(F.lit("u"), 51))
            .otherwise(F.concat(F.lit("new_user_"), F.when(k % 7 == 0, k - 1).otherwise(k).cast("string"))))
    role = F.when(k % 4 == 0, "club").when(k % 4 == 3, "admin").otherwise("student")
    number = (F.when(k % 9 == 0, F.lit(" ")).when(k % 17 == 0, F.concat(F.lit("s"), F.lpad((k + 3).cast("string"), 8, "0")))
              .when(k % 47 == 0, F.repeat(F.lit("9"), 31)).when(k % 5 == 0, F.concat(F.lit("\u00d1"), (k - k % 3).cast("string")))
              .otherwise(F.concat(F.lit("n"), (k - k % 3).cast("string"))))
    return c.raw("customer").select(
        k.alias("request_id"), plus(ts_lit(EPOCH), "MINUTE", k).alias("ts"), name.alias("username"),
        F.when(k % 19 == 0, F.lit("")).when(k % 59 == 0, F.repeat(F.lit("p"), 101)).otherwise(F.lit("pw")).alias("password"),
        role.alias("role"), number.alias("student_no"),
        F.when(k % 53 == 0, F.repeat(F.lit("r"), 51)).otherwise(F.col("c_name")).alias("real_name"),
        F.when(k % 3 == 0, F.lit(" 138 ")).when(k % 61 == 0, F.repeat(F.lit("1"), 21)).alias("phone"),
        F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("2024\t")).alias("grade"), F.col("c_mktsegment").alias("major"))


@query("ingest_user", f"""
WITH RECURSIVE q AS (
  SELECT c_custkey AS request_id, {_E} + to_minutes(CAST(c_custkey AS BIGINT)) AS ts,
         CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) WHEN c_custkey % 13 = 1 THEN 'Jos' || chr(233) || '_' || (c_custkey // 26)
              WHEN c_custkey % 13 = 2 THEN chr(9) || 'JOSE_' || ((c_custkey - 1) // 26) WHEN c_custkey % 37 = 0 THEN repeat('u', 51)
              ELSE 'new_user_' || CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) END AS username,
         CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 59 = 0 THEN repeat('p', 101) ELSE 'pw' END AS password,
         CASE WHEN c_custkey % 4 = 0 THEN 'club' WHEN c_custkey % 4 = 3 THEN 'admin' ELSE 'student' END AS role,
         CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 17 = 0 THEN 's' || lpad(CAST(c_custkey + 3 AS VARCHAR), 8, '0')
              WHEN c_custkey % 47 = 0 THEN repeat('9', 31) WHEN c_custkey % 5 = 0 THEN chr(209) || (c_custkey - c_custkey % 3)
              ELSE 'n' || (c_custkey - c_custkey % 3) END AS student_no,
         CASE WHEN c_custkey % 53 = 0 THEN repeat('r', 51) ELSE c_name END AS real_name,
         CASE WHEN c_custkey % 3 = 0 THEN ' 138 ' WHEN c_custkey % 61 = 0 THEN repeat('1', 21) END AS phone,
         CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '2024' || chr(9) END AS grade, c_mktsegment AS major FROM customer),
f AS (SELECT q.* REPLACE ({strip_sql("username")} AS username, {strip_sql("student_no")} AS student_no,
                          nullif({strip_sql("phone")}, '') AS phone, nullif({strip_sql("grade")}, '') AS grade) FROM q),
x AS (SELECT f.*, lower(strip_accents(username)) AS nm, CASE WHEN role = 'student' THEN lower(strip_accents(student_no)) END AS sk,
             lower(strip_accents(username)) IN (SELECT lower(strip_accents(username)) FROM user_account) AS ex,
             role = 'student' AND lower(strip_accents(student_no)) IN (SELECT lower(strip_accents(student_no)) FROM student) AS ex_sno,
             username <> '' AND password <> '' AS form_ok, role IN ('student', 'club') AS role_ok,
             role <> 'student' OR (student_no <> '' AND real_name <> '') AS st_ok,
             length(username) <= 50 AND length(password) <= 100 AND COALESCE(length(phone) <= 20, true) AS user_fits,
             role <> 'student' OR (length(student_no) <= 30 AND length(real_name) <= 50) AS st_fits,
             row_number() OVER (ORDER BY ts, request_id) AS rn
      FROM f),
walk(rn, names, nos, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
  UNION ALL
  SELECT s.rn, CASE WHEN s.a THEN list_append(s.names, s.nm) ELSE s.names END,
         CASE WHEN s.a AND s.sk IS NOT NULL THEN list_append(s.nos, s.sk) ELSE s.nos END, s.a
  FROM (SELECT x.rn, x.nm, x.sk, w.names, w.nos,
               (x.form_ok AND x.role_ok AND x.user_fits AND x.st_ok AND x.st_fits AND NOT x.ex AND NOT x.ex_sno
                AND NOT list_contains(w.names, x.nm) AND (x.sk IS NULL OR NOT list_contains(w.nos, x.sk))) AS a
        FROM walk w JOIN x ON x.rn = w.rn + 1) s),
z AS (SELECT x.*, w.kept FROM x JOIN walk w ON w.rn = x.rn),
fz AS (SELECT z.*, min(CASE WHEN kept THEN rn END) OVER (PARTITION BY nm) AS first_name,
              CASE WHEN sk IS NOT NULL THEN min(CASE WHEN kept THEN rn END) OVER (PARTITION BY sk) END AS first_sno FROM z),
o AS (SELECT *, CASE WHEN NOT form_ok THEN 'invalid_form' WHEN NOT role_ok THEN 'bad_role'
                     WHEN ex OR first_name < rn THEN 'username_taken' WHEN NOT user_fits THEN 'db_error' WHEN NOT st_ok THEN 'student_fields_missing'
                     WHEN NOT st_fits OR (sk IS NOT NULL AND (ex_sno OR first_sno < rn)) THEN 'db_error' ELSE 'created' END AS outcome FROM fz),
u AS (SELECT *, (SELECT max(user_id) FROM user_account) + row_number() OVER (ORDER BY ts, request_id) AS user_id FROM o WHERE outcome = 'created'),
s AS (SELECT request_id, (SELECT max(student_id) FROM student) + row_number() OVER (ORDER BY ts, request_id) AS student_id FROM u WHERE role = 'student')
SELECT u.request_id, u.outcome, u.user_id, u.username, u.role, u.phone, u.ts AS create_time, s.student_id,
       CASE WHEN role = 'student' THEN student_no END AS student_no, CASE WHEN role = 'student' THEN real_name END AS real_name,
       CASE WHEN role = 'student' THEN grade END AS grade, CASE WHEN role = 'student' THEN major END AS major,
       CASE WHEN role = 'student' THEN 0 END AS points, CASE WHEN role = 'student' THEN 0 END AS violation_count,
       CASE WHEN role = 'student' THEN 100 END AS credit_score
FROM u LEFT JOIN s ON s.request_id = u.request_id
UNION ALL
SELECT request_id, outcome, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE outcome <> 'created'""")
def ingest_user(c, r):
    """DQ-8: sign-up forms derived from every customer; whole inserted user and student rows."""
    return Q.ingest_users(_user_forms(c), c.user_account, c.student)


def _post_forms(c):
    k = F.col("doc_id")
    title = (F.when(k % 11 == 0, F.lit(" \t")).when(k % 31 == 0, F.repeat(F.lit("t"), F.lit(150) + (k % 2).cast("int")))
             .otherwise(F.concat(F.lit("\tre: "), F.col("source"), F.lit(" "), F.col("lang"))))
    content = F.when(k % 13 == 0, F.lit("\n")).when(k % 17 != 0, F.col("text"))
    cat = F.when(k % 7 == 0, F.lit("c")).when(k % 23 == 0, F.lit("\t1 ")).otherwise((k % 6).cast("string"))
    return c.raw("documents").select(k.alias("request_id"), plus(ts_lit(EPOCH), "MINUTE", k).alias("ts"),
                                     (k % c.n_user).alias("actor_user_id"), title.alias("title"),
                                     content.alias("content"), cat.alias("category_id"))


@query("ingest_post", f"""
WITH q AS (SELECT doc_id AS request_id, {_E} + to_minutes(CAST(doc_id AS BIGINT)) AS ts,
                  doc_id % (SELECT count(*) FROM customer) AS actor_user_id,
                  CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(9) WHEN doc_id % 31 = 0 THEN repeat('t', 150 + doc_id % 2)
                       ELSE chr(9) || 're: ' || source || ' ' || lang END AS title,
                  CASE WHEN doc_id % 13 = 0 THEN chr(10) WHEN doc_id % 17 <> 0 THEN text END AS content,
                  CASE WHEN doc_id % 7 = 0 THEN 'c' WHEN doc_id % 23 = 0 THEN chr(9) || '1 ' ELSE CAST(doc_id % 6 AS VARCHAR) END AS category_id
           FROM documents),
x AS (SELECT q.* REPLACE ({strip_sql("title")} AS title, {strip_sql("content")} AS content, {strip_sql("category_id")} AS category_id) FROM q),
y AS (SELECT x.*, TRY_CAST(x.category_id AS BIGINT) AS cat,
             CASE WHEN NOT (COALESCE(title <> '', false) AND COALESCE(content <> '', false)
                            AND COALESCE(regexp_full_match(x.category_id, '[0-9]+'), false)) THEN 'invalid_form'
                  WHEN pc.category_id IS NULL OR length(title) > 150 THEN 'db_error' ELSE 'created' END AS outcome
      FROM x LEFT JOIN post_category pc ON pc.category_id = TRY_CAST(x.category_id AS BIGINT)),
z AS (SELECT *, (SELECT max(post_id) FROM post) + row_number() OVER (ORDER BY ts, request_id) AS post_id FROM y WHERE outcome = 'created')
SELECT request_id, outcome, post_id, actor_user_id AS author_user_id, cat AS category_id, title, content, 'visible' AS status, ts AS create_time FROM z
UNION ALL
SELECT request_id, outcome, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM y WHERE outcome <> 'created'""")
def ingest_post(c, r):
    """DQ-7 (posts): post forms derived from every document (whole texts); whole inserted rows."""
    return Q.ingest_posts(_post_forms(c), c.post, c.table("post_category"))
