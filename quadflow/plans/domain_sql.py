"""The campus-table mapping of ``quadflow.sources.domain`` in portable SQL.

Oracle queries are prefixed with these CTEs, so the DuckDB check runs the
same mapping as the Spark adapters, written independently.
"""

from __future__ import annotations

import re

_E = "TIMESTAMP '2024-01-01 00:00:00'"
_N = {
    "n_user": "(SELECT count(*) FROM customer)",
    "n_club": "(SELECT count(*) FROM supplier)",
    "n_venue": "(SELECT count(*) FROM nation)",
    "n_resource": "(SELECT count(*) FROM part)",
    "n_post": "(SELECT count(*) FROM documents)",
}
_START = f"({_E} + to_hours(CAST((o_orderkey * 7) % 1080 AS BIGINT)))"
_LINE_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
               "l_returnflag, l_linestatus, l_shipdate")

DOMAIN = {
    "user_account": f"""
SELECT c_custkey AS user_id, c_name AS username,
       CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 10 IN (1, 2) THEN 'club' ELSE 'student' END AS role,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
       {_E} AS create_time
FROM customer""",
    "student": """
SELECT c_custkey AS student_id, c_custkey AS user_id, 'S' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS student_no,
       c_name AS real_name, CAST(NULL AS VARCHAR) AS grade, c_mktsegment AS major, 0 AS points,
       0 AS violation_count, CAST(CAST(floor(abs(c_acctbal)) AS INTEGER) % 121 AS INTEGER) AS credit_score
FROM customer WHERE c_custkey % 10 >= 3""",
    "club": """
SELECT s_suppkey AS club_id, s_name AS club_name, s_suppkey * 10 + 1 AS president_user_id,
       CAST(NULL AS VARCHAR) AS contact_phone, 'Building ' || CAST(s_nationkey AS VARCHAR) AS office_location
FROM supplier""",
    "venue": """
SELECT CAST(n_nationkey AS BIGINT) AS venue_id, n_name AS venue_name, CAST(50 + n_nationkey * 10 AS INTEGER) AS capacity,
       CAST(NULL AS VARCHAR) AS location, CASE WHEN n_nationkey % 7 = 6 THEN 'unavailable' ELSE 'available' END AS status
FROM nation""",
    "activity": f"""
SELECT o_orderkey AS activity_id, o_orderkey % {_N['n_club']} AS club_id, o_orderkey % (SELECT count(*) FROM nation) AS venue_id,
       o_orderpriority || ' #' || CAST(o_orderkey AS VARCHAR) AS title,
       CASE WHEN o_orderkey % 5 = 0 THEN 'hot' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'general' END AS category,
       {_START} AS start_time, {_START} + to_hours(2) AS end_time, {_START} - to_days(1) AS signup_deadline,
       CAST(1 + o_orderkey % 5 AS INTEGER) AS max_capacity,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'published' WHEN o_orderstatus = 'O' THEN 'ongoing'
            WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'draft' END AS status,
       CAST(NULL AS VARCHAR) AS description
FROM orders""",
    "activity_registration": f"""
SELECT l_orderkey * {_N['n_user']} + student_id AS reg_id, l_orderkey AS activity_id, student_id,
       l_shipdate AS register_time, 'approved' AS audit_status,
       CASE WHEN l_linestatus = 'F' THEN 'checked' WHEN l_linenumber % 2 = 0 THEN 'absent' ELSE 'not_checked' END AS checkin_status,
       CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'waiting' ELSE 'cancelled' END AS reg_status,
       CAST(CASE WHEN l_returnflag = 'N' THEN l_linenumber END AS INTEGER) AS queue_no
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, student_id ORDER BY {_LINE_ORDER}) AS _rn
      FROM (SELECT *, l_partkey % {_N['n_user']} AS student_id FROM lineitem) x) y
WHERE _rn = 1""",
    "checkin": f"""
SELECT reg_id AS checkin_id, reg_id, register_time AS checkin_time,
       (activity_id % {_N['n_club']}) * 10 + 1 AS operator_id, checkin_status AS status
FROM activity_registration WHERE checkin_status IN ('checked', 'absent')""",
    "resource_item": f"""
SELECT p_partkey AS resource_id, p_partkey % {_N['n_club']} AS owner_club_id, p_name AS item_name, p_type AS category,
       CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size * 4 + 40 ELSE 5000 + p_size END AS INTEGER) AS total_qty, CAST(p_size * 4 AS INTEGER) AS available_qty, 'piece' AS unit,
       CAST(p_size AS DECIMAL(10,2)) AS deposit_amount, 'available' AS status
FROM part""",
    "borrow_order": f"""
SELECT o_orderkey AS order_id, CAST(NULL AS VARCHAR) AS order_uid, o_orderkey AS activity_id,
       o_custkey AS applicant_user_id, {_START} - to_days(3) AS apply_time,
       {_START} + to_hours(2) + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS expected_return_time,
       CASE WHEN o_orderstatus = 'F' THEN {_START} + to_hours(2) + to_days(CAST(o_orderkey % 9 AS INTEGER)) - to_days(1) END AS actual_return_time,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'overdue' WHEN o_orderstatus = 'O' THEN 'borrowed'
            WHEN o_orderstatus = 'F' THEN 'returned' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS order_status
FROM orders""",
    "borrow_detail": f"""
SELECT l_orderkey * {_N['n_resource']} + l_partkey AS detail_id, l_orderkey AS order_id, l_partkey AS resource_id,
       CAST(floor(l_quantity) AS INTEGER) AS borrow_qty,
       CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity) AS INTEGER) ELSE 0 END AS returned_qty,
       CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity / 10) AS INTEGER) ELSE 0 END AS damage_qty,
       CAST(0 AS DECIMAL(10,2)) AS compensation_amount
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_LINE_ORDER}) AS _rn FROM lineitem) y
WHERE _rn = 1""",
    "penalty": """
SELECT order_id AS penalty_id, CASE WHEN applicant_user_id % 10 >= 3 THEN applicant_user_id END AS student_id,
       activity_id, order_id, 'overdue' AS penalty_type, 'Resource overdue return (event)' AS reason,
       CAST(0 AS DECIMAL(10,2)) AS amount, 'unpaid' AS status, expected_return_time + to_days(1) AS create_time
FROM borrow_order WHERE order_status = 'overdue' AND order_id % 2 = 0""",
    "product_category": f"""
SELECT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT) AS category_id, lower(name) AS category_name,
       'active' AS status, {_E} AS create_time, name AS _source_name
FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type IS NOT NULL) d""",
    "product": f"""
SELECT p_partkey AS product_id, p_partkey % {_N['n_user']} AS seller_user_id, pc.category_id,
       p_name || ' (' || p_brand || ')' AS title, CAST(NULL AS VARCHAR) AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE WHEN p_partkey % 5 = 0 THEN 'locked' WHEN p_partkey % 5 = 1 THEN 'sold' ELSE 'on_sale' END AS status,
       {_E} + to_days(CAST(p_partkey % 97 AS INTEGER)) AS publish_time
FROM part JOIN product_category pc ON pc._source_name = part.p_type""",
    "trade_order": f"""
SELECT * FROM (
  SELECT o_orderkey AS order_id, o_orderkey % {_N['n_resource']} AS product_id, o_custkey AS buyer_user_id,
         (o_orderkey % {_N['n_resource']}) % {_N['n_user']} AS seller_user_id,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'created' ELSE 'cancelled' END AS order_status,
         {_E} + to_hours(CAST(o_orderkey % 720 AS BIGINT)) AS create_time,
         CASE WHEN o_orderstatus = 'F' THEN {_E} + to_hours(CAST(o_orderkey % 720 AS BIGINT)) + to_days(2) END AS finish_time
  FROM orders) t
WHERE buyer_user_id <> seller_user_id""",
    "post_category": f"""
SELECT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT) AS category_id, lower(name) AS category_name,
       'active' AS status, {_E} AS create_time, name AS _source_name
FROM (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL) d""",
    "post": f"""
SELECT doc_id AS post_id, doc_id % {_N['n_user']} AS author_user_id, pc.category_id,
       source || ' post #' || CAST(doc_id AS VARCHAR) AS title, text AS content,
       CASE WHEN doc_id % 10 = 9 THEN 'hidden' ELSE 'visible' END AS status,
       {_E} + to_days(CAST(doc_id % 50 AS INTEGER)) AS create_time
FROM documents JOIN post_category pc ON pc._source_name = documents.lang""",
    "post_comment": f"""
SELECT conv_id * 100000 + turn AS comment_id, conv_id AS post_id, (conv_id * 7 + turn) % {_N['n_user']} AS user_id,
       text AS content, {_E} + to_days(60) + to_hours(CAST(turn AS BIGINT)) AS create_time
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS _rn FROM conversations) c
WHERE _rn = 1""",
    "post_like": f"""
SELECT min(event_id) AS like_id, event_id % {_N['n_post']} AS post_id, user_id, min(ts) AS create_time
FROM events WHERE event_type = 'view' GROUP BY event_id % {_N['n_post']}, user_id""",
}

_ORDER = list(DOMAIN)


def with_domain(sql: str) -> str:
    """Prefix ``sql`` with the campus-table CTEs it references (and theirs)."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in _ORDER:
            if other != name and _mentions(DOMAIN[name], other):
                visit(other)
        needed.append(name)

    for name in _ORDER:
        if _mentions(sql, name):
            visit(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({DOMAIN[n]}\n)" for n in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if head:
        rec = "RECURSIVE " if head.group(1) else ""
        return f"WITH {rec}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE) is not None


# -- request logs (twins of quadflow.sources.requests) -------------------------------------
def _role(x: str) -> str:
    return f"CASE WHEN {x} % 10 = 0 THEN 'admin' WHEN {x} % 10 IN (1, 2) THEN 'club' ELSE 'student' END"


_EV = "event_id AS request_id, ts, user_id AS actor_user_id, " + _role("user_id") + " AS actor_role"
_DUE = f"({_START} + to_hours(2) + to_days(CAST(o_orderkey % 9 AS INTEGER)))"
_CREATED = f"({_E} + to_hours(CAST(o_orderkey % 720 AS BIGINT)))"



def target_sql(rows: str) -> str:
    """Twin of ``quadflow.sources.requests._target``."""
    spread = f"(event_id * 7919 % {rows})"
    return f"CASE WHEN event_id % 4 = 0 THEN {spread} - {spread} % 16 ELSE {spread} END"


def _uid_sql(order: str, days: int) -> str:
    """Uid of an order that was applied for ``days`` days before its activity."""
    text = f"CAST({order} AS VARCHAR)"
    return (f"('BOR-' || strftime({_E} + to_hours(CAST({order} * 7 % 1080 AS BIGINT)) - to_days({days}), '%Y%m%d') || '-' || "
            f"lpad({text}, CAST(greatest(6, length({text})) AS INTEGER), '0'))")


BLANKS = " || ".join(f"chr({k})" for k in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


def strip_sql(x: str) -> str:
    """A form field without the white space around it."""
    return f"trim({x}, {BLANKS})"


_ACTIVITIES = "(SELECT count(*) FROM orders)"

DOMAIN.update({
    "reg_request": f"""
SELECT {_EV},
       CASE WHEN user_id % 11 = 0 THEN {_ACTIVITIES} + event_id % 389 ELSE {target_sql(_ACTIVITIES)} END AS activity_id,
       user_id AS student_id
FROM events WHERE event_type = 'signup'""",
    "like_request": f"""
SELECT {_EV}, CASE WHEN user_id % 13 = 0 THEN {_N['n_post']} + event_id % 7 ELSE {target_sql(_N['n_post'])} END AS post_id
FROM events WHERE event_type = 'click'""",
    "trade_buy_request": f"""
SELECT {_EV}, CASE WHEN user_id % 17 = 0 THEN {_N['n_resource']} + event_id % 5 ELSE {target_sql(_N['n_resource'])} END AS product_id
FROM events WHERE event_type = 'purchase'""",
    "status_request": f"""
SELECT {_EV}, {target_sql(_ACTIVITIES)} AS activity_id,
       CASE event_id % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' WHEN 2 THEN 'ongoing' WHEN 3 THEN 'finished'
            WHEN 4 THEN 'cancelled' ELSE 'archived' END AS status
FROM events WHERE event_type = 'error'""",
    "line_first": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_LINE_ORDER}) AS _rn FROM lineitem) y
WHERE _rn = 1""",
    "checkin_request": f"""
SELECT l_orderkey * {_N['n_resource']} + l_partkey AS request_id, l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS ts,
       (l_orderkey % {_N['n_club']}) * 10 + 1 AS actor_user_id, 'club' AS actor_role,
       l_orderkey * {_N['n_user']} + l_partkey % {_N['n_user']} AS reg_id,
       CASE WHEN l_discount < 0.05 THEN 'checked' ELSE 'absent' END AS status
FROM line_first""",
    "borrow_request": f"""
SELECT l_orderkey * {_N['n_resource']} + l_partkey AS request_id, l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS ts,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(0 AS BIGINT) ELSE l_suppkey * 10 + 1 END AS actor_user_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'admin' ELSE 'club' END AS actor_role,
       CASE WHEN l_linenumber = 7 THEN 'X' || CAST(l_orderkey AS VARCHAR)
            WHEN l_linenumber = 5 THEN chr(32) || chr(9) || {_uid_sql("l_orderkey", 3)} || ' '
            WHEN l_linenumber = 6 THEN {_uid_sql("l_orderkey", 2)} ELSE CAST(l_orderkey AS VARCHAR) END AS order_ref,
       l_partkey AS resource_id, CAST(floor(l_quantity) AS INTEGER) AS borrow_qty
FROM line_first""",
    "return_request": f"""
SELECT o_orderkey AS request_id, {_DUE} - to_hours(1) AS ts,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS BIGINT) ELSE o_custkey END AS actor_user_id,
       {_role("CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS BIGINT) ELSE o_custkey END")} AS actor_role,
       o_orderkey AS order_id
FROM orders""",
    "trade_status_request": f"""
SELECT request_id, ts, actor_user_id, {_role("actor_user_id")} AS actor_role, order_id, order_status FROM (
  SELECT o_orderkey AS request_id, {_CREATED} + to_days(1) AS ts,
         CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN (o_orderkey % {_N['n_resource']}) % {_N['n_user']}
              ELSE (o_custkey + 1) % {_N['n_user']} END AS actor_user_id,
         o_orderkey AS order_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'cancelled' WHEN o_orderpriority = '3-MEDIUM' THEN 'created'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'refunded' ELSE 'completed' END AS order_status
  FROM orders
  UNION ALL
  SELECT o_orderkey + (SELECT count(*) FROM orders) AS request_id, {_CREATED} + to_days(3) AS ts, o_custkey AS actor_user_id,
         o_orderkey AS order_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' ELSE 'created' END AS order_status
  FROM orders) w""",
    "activity_form_request": f"""
SELECT request_id, ts, actor_user_id, {_role("actor_user_id")} AS actor_role, activity_id, title, category, venue_id,
       start_time, end_time, signup_deadline, max_capacity, description, club_id FROM (
  SELECT o_orderkey AS request_id, {_START} - to_days(2) AS ts,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) WHEN o_orderkey % 3 = 1 THEN (o_orderkey % {_N['n_club']}) * 10 + 1
              ELSE ((o_orderkey + 1) % {_N['n_club']}) * 10 + 1 END AS actor_user_id,
         o_orderkey AS activity_id,
         CASE WHEN o_orderkey % 13 = 0 THEN ' ' || chr(9) || ' ' WHEN o_orderkey % 37 = 0 THEN repeat('t', 200 + o_orderkey % 2) ELSE ' ' || o_orderpriority || ' (updated) #' || CAST(o_orderkey AS VARCHAR) || ' ' END AS title,
         CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 41 = 0 THEN repeat('c', 51) ELSE chr(9) || 'general' END AS category,
         CASE WHEN o_orderkey % 17 = 0 THEN 'v' || CAST(o_orderkey % 25 AS VARCHAR) ELSE CAST(o_orderkey % 30 AS VARCHAR) END AS venue_id,
         CASE WHEN o_orderkey % 43 <> 0 THEN {_START} + to_days(1) END AS start_time,
         CASE WHEN o_orderkey % 23 = 0 THEN {_START} + to_days(1) - to_hours(1) ELSE {_START} + to_days(1) + to_hours(3) END AS end_time,
         {_START} AS signup_deadline,
         CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN '99999999999' ELSE CAST(o_orderkey % 6 + 2 AS VARCHAR) END AS max_capacity,
         CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' notes ' END AS description,
         CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE CAST(o_orderkey % {_N['n_club']} AS VARCHAR) END AS club_id
  FROM orders) f""",
})
_ORDER = list(DOMAIN)
