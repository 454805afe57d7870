"""Declared schemas of the campus tables and of the request logs.

Types follow the relational DDL: BIGINT keys -> LongType, INT -> IntegerType,
VARCHAR/TEXT/JSON -> StringType, DECIMAL(10,2) -> DecimalType(10,2),
DATETIME -> TimestampNTZType.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()
D = T.DecimalType(10, 2)
TS = T.TimestampNTZType()


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


TABLES: dict[str, T.StructType] = {
    "user_account": _schema(("user_id", L, False), ("username", S, False), ("role", S, False),
                            ("phone", S, True), ("create_time", TS, False)),
    "club": _schema(("club_id", L, False), ("club_name", S, False), ("president_user_id", L, True),
                    ("contact_phone", S, True), ("office_location", S, True)),
    "student": _schema(("student_id", L, False), ("user_id", L, False), ("student_no", S, False),
                       ("real_name", S, False), ("grade", S, True), ("major", S, True),
                       ("points", I, False), ("violation_count", I, False), ("credit_score", I, False)),
    "venue": _schema(("venue_id", L, False), ("venue_name", S, False), ("capacity", I, False),
                     ("location", S, True), ("status", S, False)),
    "activity": _schema(("activity_id", L, False), ("club_id", L, False), ("venue_id", L, False),
                        ("title", S, False), ("category", S, True), ("start_time", TS, False),
                        ("end_time", TS, False), ("signup_deadline", TS, False),
                        ("max_capacity", I, False), ("status", S, False), ("description", S, True)),
    "activity_registration": _schema(("reg_id", L, False), ("activity_id", L, False),
                                     ("student_id", L, False), ("register_time", TS, False),
                                     ("audit_status", S, False), ("checkin_status", S, False),
                                     ("reg_status", S, False), ("queue_no", I, True)),
    "checkin": _schema(("checkin_id", L, False), ("reg_id", L, False), ("checkin_time", TS, False),
                       ("operator_id", L, False), ("status", S, False)),
    "resource_item": _schema(("resource_id", L, False), ("owner_club_id", L, False),
                             ("item_name", S, False), ("category", S, True), ("total_qty", I, False),
                             ("available_qty", I, False), ("unit", S, False),
                             ("deposit_amount", D, False), ("status", S, False)),
    "borrow_order": _schema(("order_id", L, False), ("order_uid", S, True), ("activity_id", L, False),
                            ("applicant_user_id", L, False), ("apply_time", TS, False),
                            ("expected_return_time", TS, False), ("actual_return_time", TS, True),
                            ("order_status", S, False)),
    "borrow_detail": _schema(("detail_id", L, False), ("order_id", L, False), ("resource_id", L, False),
                             ("borrow_qty", I, False), ("returned_qty", I, False),
                             ("damage_qty", I, False), ("compensation_amount", D, False)),
    "penalty": _schema(("penalty_id", L, False), ("student_id", L, True), ("activity_id", L, True),
                       ("order_id", L, True), ("penalty_type", S, False), ("reason", S, False),
                       ("amount", D, False), ("status", S, False), ("create_time", TS, False)),
    "audit_log": _schema(("log_id", L, False), ("biz_type", S, False), ("biz_id", L, False),
                         ("action", S, False), ("operator_id", L, True), ("old_data", S, True),
                         ("new_data", S, True), ("op_time", TS, False)),
    "product_category": _schema(("category_id", L, False), ("category_name", S, False),
                                ("status", S, False), ("create_time", TS, False)),
    "product": _schema(("product_id", L, False), ("seller_user_id", L, False), ("category_id", L, False),
                       ("title", S, False), ("description", S, True), ("price", D, False),
                       ("status", S, False), ("publish_time", TS, False)),
    "trade_order": _schema(("order_id", L, False), ("product_id", L, False), ("buyer_user_id", L, False),
                           ("seller_user_id", L, False), ("order_status", S, False),
                           ("create_time", TS, False), ("finish_time", TS, True)),
    "post_category": _schema(("category_id", L, False), ("category_name", S, False),
                             ("status", S, False), ("create_time", TS, False)),
    "post": _schema(("post_id", L, False), ("author_user_id", L, False), ("category_id", L, False),
                    ("title", S, False), ("content", S, False), ("status", S, False),
                    ("create_time", TS, False)),
    "post_comment": _schema(("comment_id", L, False), ("post_id", L, False), ("user_id", L, False),
                            ("content", S, False), ("create_time", TS, False)),
    "post_like": _schema(("like_id", L, False), ("post_id", L, False), ("user_id", L, False),
                         ("create_time", TS, False)),
}

# The source tables that the campus tables are derived from.
SOURCES: dict[str, str] = {  # DDL
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Request logs (one row per request; order is (ts, request_id)).
_REQ = (("request_id", L, False), ("ts", TS, False), ("actor_user_id", L, True), ("actor_role", S, True))
REQUESTS: dict[str, T.StructType] = {
    "registration": _schema(*_REQ, ("activity_id", L, True), ("student_id", L, True)),
    "checkin": _schema(*_REQ, ("reg_id", L, True), ("status", S, True)),
    "status_change": _schema(*_REQ, ("activity_id", L, True), ("status", S, True)),
    "borrow": _schema(*_REQ, ("order_ref", S, True), ("resource_id", L, True), ("borrow_qty", I, True)),
    "return": _schema(*_REQ, ("order_id", L, True)),
    "trade_buy": _schema(*_REQ, ("product_id", L, True)),
    "trade_status": _schema(*_REQ, ("order_id", L, True), ("order_status", S, True)),
    "like": _schema(*_REQ, ("post_id", L, True)),
}

# State vocabularies allowed by the table CHECK constraints.
ACTIVITY_STATUS = ["draft", "published", "ongoing", "finished", "cancelled"]
ORDER_STATUS = ["pending", "approved", "borrowed", "returned", "overdue"]
TRADE_STATUS = ["created", "cancelled", "completed"]
