"""Request logs derived from the test tables.

The reference changes one row per HTTP request. Here a batch (or stream) of
requests is a DataFrame with ``request_id`` and ``ts``; operators process it
in ``(ts, request_id)`` order. Each log is a projection of a whole test
table, so its size grows with the scale factor. SQL twins live in
``quadflow.plans.domain_sql``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.functions.scalar import order_uid, role_of
from quadflow.sources.domain import EPOCH, Campus, plus, ts_lit


def _target(event_id: Column, rows: Column | int) -> Column:
    """A target row for an event: spread over the whole table by a large odd
    stride; every fourth event goes to a busy sixteenth of the table, so some
    targets see more requests than others at every size."""
    spread = event_id * F.lit(7919) % rows
    return F.when(event_id % 4 == 0, spread - spread % 16).otherwise(spread)


def _pick(index: Column, values: list[str | None]) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


class Requests:
    def __init__(self, campus: Campus, events: DataFrame | None = None):
        self.c = campus
        # A micro-batch of events may replace the table (streaming forms).
        self.events = events

    def _events(self, kind: str) -> DataFrame:
        events = self.events if self.events is not None else self.c.raw("events")
        return events.filter(F.col("event_type") == kind)

    def _base(self, df: DataFrame, actor: Column) -> list[Column]:
        return [F.col("event_id").alias("request_id"), F.col("ts"), actor.alias("actor_user_id"),
                role_of(actor).alias("actor_role")]

    @cached_property
    def registration(self) -> DataFrame:
        """signup events -> registration requests (student = the user)."""
        e = self._events("signup")
        target = F.when(F.col("user_id") % 11 == 0, self.c.n_activity + F.col("event_id") % 389) \
            .otherwise(_target(F.col("event_id"), self.c.n_activity))
        return e.select(*self._base(e, F.col("user_id")), target.alias("activity_id"),
                        F.col("user_id").alias("student_id"))

    @cached_property
    def like(self) -> DataFrame:
        """click events -> like toggles; some target posts that do not exist."""
        e = self._events("click")
        target = F.when(F.col("user_id") % 13 == 0, self.c.n_post + F.col("event_id") % 7) \
            .otherwise(_target(F.col("event_id"), self.c.n_post))
        return e.select(*self._base(e, F.col("user_id")), target.alias("post_id"))

    @cached_property
    def trade_buy(self) -> DataFrame:
        """purchase events -> buy attempts on products."""
        e = self._events("purchase")
        target = F.when(F.col("user_id") % 17 == 0, self.c.n_resource + F.col("event_id") % 5) \
            .otherwise(_target(F.col("event_id"), self.c.n_resource))
        return e.select(*self._base(e, F.col("user_id")), target.alias("product_id"))

    @cached_property
    def status_change(self) -> DataFrame:
        """error events -> activity status changes (one value is not a state)."""
        e = self._events("error")
        status = _pick(F.col("event_id") % 6, ["draft", "published", "ongoing", "finished", "cancelled",
                                               "archived"])
        return e.select(*self._base(e, F.col("user_id")), _target(F.col("event_id"), self.c.n_activity).alias("activity_id"),
                        status.alias("status"))

    @cached_property
    def checkin(self) -> DataFrame:
        """lineitem -> check-in / absence marks by the activity's club."""
        x = self.c.line_first
        actor = (F.col("l_orderkey") % self.c.n_club) * 10 + 1
        return x.select(
            (F.col("l_orderkey") * self.c.n_resource + F.col("l_partkey")).alias("request_id"),
            plus(F.col("l_shipdate"), "HOUR", F.col("l_linenumber")).alias("ts"),
            actor.alias("actor_user_id"), F.lit("club").alias("actor_role"),
            (F.col("l_orderkey") * self.c.n_user + F.col("l_partkey") % self.c.n_user).alias("reg_id"),
            F.when(F.col("l_discount") < 0.05, "checked").otherwise("absent").alias("status"))

    @cached_property
    def borrow(self) -> DataFrame:
        """lineitem -> stock reservations (add a detail line to an order), by
        order id or, for some lines, by a right or a wrong order uid."""
        x = self.c.line_first
        admin = F.col("l_linenumber") % 3 == 0
        actor = F.when(admin, F.lit(0).cast("long")).otherwise(F.col("l_suppkey") * 10 + 1)
        k = F.col("l_orderkey")
        applied = plus(plus(ts_lit(EPOCH), "HOUR", (k * 7) % 1080), "DAY", -3)  # of the order, as its uid says
        ref = (F.when(F.col("l_linenumber") == 7, F.concat(F.lit("X"), k.cast("string")))
               .when(F.col("l_linenumber") == 5, F.concat(F.lit(" \t"), order_uid(k, applied), F.lit(" ")))
               .when(F.col("l_linenumber") == 6, order_uid(k, plus(applied, "DAY", 1)))
               .otherwise(k.cast("string")))
        return x.select(
            (F.col("l_orderkey") * self.c.n_resource + F.col("l_partkey")).alias("request_id"),
            plus(F.col("l_shipdate"), "HOUR", F.col("l_linenumber")).alias("ts"),
            actor.alias("actor_user_id"), F.when(admin, "admin").otherwise("club").alias("actor_role"),
            ref.alias("order_ref"), F.col("l_partkey").alias("resource_id"),
            F.floor(F.col("l_quantity")).cast("int").alias("borrow_qty"))

    def _start(self) -> Column:
        return plus(ts_lit(EPOCH), "HOUR", (F.col("o_orderkey") * 7) % 1080)

    @cached_property
    def return_(self) -> DataFrame:
        """orders -> one return request per order, an hour before it is due."""
        k = F.col("o_orderkey")
        due = plus(plus(self._start(), "HOUR", 2), "DAY", k % 9)
        actor = F.when(k % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("o_custkey"))
        return self.c.raw("orders").select(
            k.alias("request_id"), plus(due, "HOUR", -1).alias("ts"), actor.alias("actor_user_id"),
            role_of(actor).alias("actor_role"), k.alias("order_id"))

    @cached_property
    def trade_status(self) -> DataFrame:
        """orders -> two waves of trade-order status changes by buyer, seller
        or a stranger; one value is not a valid state."""
        o = self.c.raw("orders")
        k = F.col("o_orderkey")
        created = plus(ts_lit(EPOCH), "HOUR", k % 720)
        seller = (k % self.c.n_resource) % self.c.n_user
        actor1 = F.when(k % 3 == 0, F.col("o_custkey")).when(k % 3 == 1, seller) \
            .otherwise((F.col("o_custkey") + 1) % self.c.n_user)
        status1 = (F.when(F.col("o_orderpriority") == "1-URGENT", "cancelled")
                   .when(F.col("o_orderpriority") == "3-MEDIUM", "created")
                   .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "refunded").otherwise("completed"))
        wave1 = o.select(k.alias("request_id"), plus(created, "DAY", 1).alias("ts"), actor1.alias("actor_user_id"),
                         role_of(actor1).alias("actor_role"), k.alias("order_id"), status1.alias("order_status"))
        status2 = _pick(k % 3, ["cancelled", "completed", "created"])
        wave2 = o.select((k + self.c.n_activity).alias("request_id"), plus(created, "DAY", 3).alias("ts"),
                         F.col("o_custkey").alias("actor_user_id"), role_of(F.col("o_custkey")).alias("actor_role"),
                         k.alias("order_id"), status2.alias("order_status"))
        return wave1.unionByName(wave2)

    @cached_property
    def activity_form(self) -> DataFrame:
        """orders -> activity create/update forms as raw text fields."""
        k = F.col("o_orderkey")
        start = plus(self._start(), "DAY", 1)
        end = F.when(k % 23 == 0, plus(start, "HOUR", -1)).otherwise(plus(start, "HOUR", 3))
        actor = F.when(k % 3 == 0, F.lit(0).cast("long")).when(k % 3 == 1, (k % self.c.n_club) * 10 + 1) \
            .otherwise(((k + 1) % self.c.n_club) * 10 + 1)
        return self.c.raw("orders").select(
            k.alias("request_id"), plus(self._start(), "DAY", -2).alias("ts"), actor.alias("actor_user_id"),
            role_of(actor).alias("actor_role"), k.alias("activity_id"),
            F.when(k % 13 == 0, F.lit(" \t ")).when(k % 37 == 0, F.repeat(F.lit("t"), F.lit(200) + (k % 2).cast("int"))).otherwise(
                F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" (updated) #"), k.cast("string"), F.lit(" ")))
            .alias("title"),
            F.when(k % 4 == 0, F.lit(" ")).when(k % 41 == 0, F.repeat(F.lit("c"), 51)).otherwise(F.lit("\tgeneral")).alias("category"),
            F.when(k % 17 == 0, F.concat(F.lit("v"), (k % 25).cast("string"))).otherwise((k % 30).cast("string"))
            .alias("venue_id"),
            F.when(k % 43 != 0, start).alias("start_time"), end.alias("end_time"), plus(start, "DAY", -1).alias("signup_deadline"),
            F.when(k % 19 == 0, F.lit("")).when(k % 29 == 0, F.lit("99999999999")).otherwise((k % 6 + 2).cast("string")).alias("max_capacity"),
            F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(" notes ")).alias("description"),
            F.when(k % 7 == 0, F.lit("abc")).otherwise((k % self.c.n_club).cast("string")).alias("club_id"))
