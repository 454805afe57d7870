"""Campus tables derived from the driver's test tables.

The test data is a TPC-H-like star schema. Each campus table is a pure
projection (plus one de-duplicating aggregate where the source key is not
unique) of one test table, so every operator's work grows with the inputs.
Moduli come from table counts via scalar subqueries (evaluated once per
query), never from literals, so the mapping holds at every scale factor.

The same mapping is written in SQL in ``quadflow.plans.oracle.DOMAIN_SQL``;
both must change together.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.session import fit_partitions
from quadflow.sources.materialize import TableCache, source_files
from quadflow.sources.tables import read_table

# The epoch every derived timestamp is placed after, and the
# default settlement / sweep time used by the registered queries.
EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-01-20 00:00:00"


def ts_lit(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def plus(ts: Column, unit: str, amount: Column | int) -> Column:
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return F.timestamp_add(unit, amount, ts)


def _first_row(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (a total order over the
    row). An aggregate of ``min(struct)`` with map-side partial aggregation, so
    a hot key never gathers in one task. Keys decide nothing inside a group and
    are not shuffled a second time."""
    packed = F.min(F.struct(*[F.col(c) for c in dict.fromkeys(order + keep) if c not in keys]))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in keep if c not in keys])


_RAW: dict[tuple[int, str, str], DataFrame] = {}


def _stored(name: str):
    """Accessor for a campus table: derived once, then read as a base table."""
    def get(self) -> DataFrame:
        if name not in self._tables:
            build = getattr(self, f"_build_{name}")
            self._tables[name] = self.cache.get(name, build) if self.cache else build()
        return self._tables[name]
    get.__name__ = name
    return property(get)


class Campus:
    """Campus tables for one test-data directory (see ``materialize``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._raw: dict[str, DataFrame] = {}
        self._counts: dict[str, Column] = {}
        self._tables: dict[str, DataFrame] = {}
        self.cache = None
        fit_partitions(spark, source_files(spark, root.rstrip("/"))[1])
        if TableCache.enabled(spark):
            self.cache = TableCache(spark, root)

    def raw(self, name: str) -> DataFrame:
        # One DataFrame per source table and session: listed and its footer
        # read once (inputs are read-only), and identical scans in one plan
        # are recognised as the same relation.
        if name not in self._raw:
            key = (id(self.spark), self.root, name)
            if key not in _RAW:
                _RAW[key] = read_table(self.spark, self.root, name, schema=None)
            self._raw[name] = _RAW[key]
        return self._raw[name]

    # -- cardinalities (scalar subqueries) ---------------------------------
    def count_of(self, name: str) -> Column:
        if name not in self._counts:
            self._counts[name] = self.raw(name).select(F.count(F.lit(1))).scalar()
        return self._counts[name]

    @property
    def n_user(self) -> Column:
        return self.count_of("customer")

    @property
    def n_club(self) -> Column:
        return self.count_of("supplier")

    @property
    def n_venue(self) -> Column:
        return self.count_of("nation")

    @property
    def n_resource(self) -> Column:
        return self.count_of("part")

    @property
    def n_activity(self) -> Column:
        return self.count_of("orders")

    @property
    def n_post(self) -> Column:
        return self.count_of("documents")

    # -- people and organisations -------------------------------------------
    def _build_user_account(self) -> DataFrame:
        k = F.col("c_custkey")
        role = (F.when(k % 10 == 0, "admin").when((k % 10).isin(1, 2), "club").otherwise("student"))
        phone = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("138"), F.lpad(k.cast("string"), 8, "0")))
        return self.raw("customer").select(
            k.alias("user_id"), F.col("c_name").alias("username"), role.alias("role"),
            phone.alias("phone"), ts_lit(EPOCH).alias("create_time"))

    def _build_student(self) -> DataFrame:
        k = F.col("c_custkey")
        credit = (F.floor(F.abs(F.col("c_acctbal"))).cast("int") % 121).cast("int")
        return (self.raw("customer").filter(k % 10 >= 3).select(
            k.alias("student_id"), k.alias("user_id"),
            F.concat(F.lit("S"), F.lpad(k.cast("string"), 8, "0")).alias("student_no"),
            F.col("c_name").alias("real_name"), F.lit(None).cast("string").alias("grade"),
            F.col("c_mktsegment").alias("major"), F.lit(0).alias("points"),
            F.lit(0).alias("violation_count"), credit.alias("credit_score")))

    def _build_club(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("club_id"), F.col("s_name").alias("club_name"),
            (k * 10 + 1).alias("president_user_id"), F.lit(None).cast("string").alias("contact_phone"),
            F.concat(F.lit("Building "), F.col("s_nationkey").cast("string")).alias("office_location"))

    def _build_venue(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.cast("long").alias("venue_id"), F.col("n_name").alias("venue_name"),
            (F.lit(50) + k * 10).cast("int").alias("capacity"),
            F.lit(None).cast("string").alias("location"),
            F.when(k % 7 == 6, "unavailable").otherwise("available").alias("status"))

    # -- activities and sign-ups --------------------------------------------
    def _build_activity(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = plus(ts_lit(EPOCH), "HOUR", (k * 7) % 1080)
        status = (F.when((F.col("o_orderstatus") == "O") & (k % 2 == 0), "published")
                  .when(F.col("o_orderstatus") == "O", "ongoing")
                  .when(F.col("o_orderstatus") == "F", "finished")
                  .when(k % 2 == 0, "cancelled").otherwise("draft"))
        category = (F.when(k % 5 == 0, "hot").when(k % 5 == 1, F.lit(None).cast("string"))
                    .otherwise("general"))
        return self.raw("orders").select(
            k.alias("activity_id"), (k % self.n_club).alias("club_id"), (k % self.n_venue).alias("venue_id"),
            F.concat(F.col("o_orderpriority"), F.lit(" #"), k.cast("string")).alias("title"),
            category.alias("category"), start.alias("start_time"), plus(start, "HOUR", 2).alias("end_time"),
            plus(start, "DAY", -1).alias("signup_deadline"), (F.lit(1) + k % 5).cast("int").alias("max_capacity"),
            status.alias("status"), F.lit(None).cast("string").alias("description"))

    _LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                   "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

    def _build_line_first(self) -> DataFrame:
        """The first line of each (order, part): borrow details, check-ins and
        reservations are all projections of these rows."""
        return _first_row(self.raw("lineitem"), ["l_orderkey", "l_partkey"], self._LINE_ORDER, ["l_orderkey"] + self._LINE_ORDER)

    def _build_activity_registration(self) -> DataFrame:
        lines = self.raw("lineitem").withColumn("student_id", F.col("l_partkey") % self.n_user)
        first = _first_row(lines, ["l_orderkey", "student_id"], self._LINE_ORDER,
                           ["l_orderkey", "student_id"] + self._LINE_ORDER)
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        return first.select(
            (F.col("l_orderkey") * self.n_user + F.col("student_id")).alias("reg_id"),
            F.col("l_orderkey").alias("activity_id"), F.col("student_id"),
            F.col("l_shipdate").alias("register_time"), F.lit("approved").alias("audit_status"),
            F.when(status == "F", "checked").when(F.col("l_linenumber") % 2 == 0, "absent")
             .otherwise("not_checked").alias("checkin_status"),
            F.when(flag == "A", "confirmed").when(flag == "N", "waiting").otherwise("cancelled").alias("reg_status"),
            F.when(flag == "N", F.col("l_linenumber")).cast("int").alias("queue_no"))

    def _build_checkin(self) -> DataFrame:
        """SRC-4: one check-in row per registration already marked checked or
        absent, operated by the president of the activity's club."""
        regs = self.activity_registration.filter(F.col("checkin_status").isin("checked", "absent"))
        return regs.select(
            F.col("reg_id").alias("checkin_id"), "reg_id", F.col("register_time").alias("checkin_time"),
            ((F.col("activity_id") % self.n_club) * 10 + 1).alias("operator_id"),
            F.col("checkin_status").alias("status"))

    # -- equipment lending ---------------------------------------------------
    def _build_resource_item(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("resource_id"), (k % self.n_club).alias("owner_club_id"), F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category"),
            F.when(k % 7 == 0, F.col("p_size") * 4 + 40).otherwise(F.lit(5000) + F.col("p_size")).cast("int").alias("total_qty"),
            (F.col("p_size") * 4).cast("int").alias("available_qty"), F.lit("piece").alias("unit"),
            F.col("p_size").cast("decimal(10,2)").alias("deposit_amount"), F.lit("available").alias("status"))

    def _build_borrow_order(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = plus(ts_lit(EPOCH), "HOUR", (k * 7) % 1080)
        expected = plus(plus(start, "HOUR", 2), "DAY", k % 9)
        status = (F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "overdue")
                  .when(F.col("o_orderstatus") == "O", "borrowed")
                  .when(F.col("o_orderstatus") == "F", "returned")
                  .when(k % 2 == 0, "pending").otherwise("approved"))
        return self.raw("orders").select(
            k.alias("order_id"), F.lit(None).cast("string").alias("order_uid"), k.alias("activity_id"),
            F.col("o_custkey").alias("applicant_user_id"), plus(start, "DAY", -3).alias("apply_time"),
            expected.alias("expected_return_time"),
            F.when(F.col("o_orderstatus") == "F", plus(expected, "DAY", -1)).alias("actual_return_time"),
            status.alias("order_status"))

    @property
    def borrow_detail(self) -> DataFrame:
        # read off the stored lines: storing it too would cut out and write every line a second time
        if "borrow_detail" not in self._tables:
            qty = F.floor(F.col("l_quantity")).cast("int")
            self._tables["borrow_detail"] = self.line_first.select(
                (F.col("l_orderkey") * self.n_resource + F.col("l_partkey")).alias("detail_id"),
                F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("resource_id"),
                qty.alias("borrow_qty"), F.when(F.col("l_linestatus") == "F", qty).otherwise(0).alias("returned_qty"),
                F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 10).cast("int"))
                 .otherwise(0).alias("damage_qty"),
                F.lit(0).cast("decimal(10,2)").alias("compensation_amount"))
        return self._tables["borrow_detail"]

    def _build_penalty(self) -> DataFrame:
        """Existing overdue penalties: every second overdue order already has one."""
        bo = self.borrow_order.filter((F.col("order_status") == "overdue") & (F.col("order_id") % 2 == 0))
        return bo.select(
            F.col("order_id").alias("penalty_id"),
            F.when(F.col("applicant_user_id") % 10 >= 3, F.col("applicant_user_id")).alias("student_id"),
            "activity_id", "order_id", F.lit("overdue").alias("penalty_type"),
            F.lit("Resource overdue return (event)").alias("reason"), F.lit(0).cast("decimal(10,2)").alias("amount"),
            F.lit("unpaid").alias("status"), plus(F.col("expected_return_time"), "DAY", 1).alias("create_time"))

    # -- second-hand trade -----------------------------------------------------
    def _build_product_category(self) -> DataFrame:
        return self._categories(self.raw("part").select(F.col("p_type").alias("name")))

    def _categories(self, names: DataFrame) -> DataFrame:
        # Ids are ranks over the *distinct* names: the window runs over the
        # small category set, never over the fact table.
        from pyspark.sql import Window
        distinct = names.filter(F.col("name").isNotNull()).distinct()
        return distinct.select(
            F.dense_rank().over(Window.orderBy("name")).cast("long").alias("category_id"),
            F.lower(F.col("name")).alias("category_name"), F.lit("active").alias("status"),
            ts_lit(EPOCH).alias("create_time"), F.col("name").alias("_source_name"))

    def _build_product(self) -> DataFrame:
        k = F.col("p_partkey")
        cats = self.product_category.select(F.col("category_id"), F.col("_source_name").alias("p_type"))
        return self.raw("part").join(cats, "p_type").select(
            k.alias("product_id"), (k % self.n_user).alias("seller_user_id"), "category_id",
            F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("title"),
            F.lit(None).cast("string").alias("description"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.when(k % 5 == 0, "locked").when(k % 5 == 1, "sold").otherwise("on_sale").alias("status"),
            plus(ts_lit(EPOCH), "DAY", k % 97).alias("publish_time"))

    def _build_trade_order(self) -> DataFrame:
        k = F.col("o_orderkey")
        product = k % self.n_resource
        created = plus(ts_lit(EPOCH), "HOUR", k % 720)
        status = (F.when(F.col("o_orderstatus") == "F", "completed")
                  .when(F.col("o_orderstatus") == "O", "created").otherwise("cancelled"))
        return (self.raw("orders").select(
            k.alias("order_id"), product.alias("product_id"), F.col("o_custkey").alias("buyer_user_id"),
            (product % self.n_user).alias("seller_user_id"), status.alias("order_status"),
            created.alias("create_time"),
            F.when(F.col("o_orderstatus") == "F", plus(created, "DAY", 2)).alias("finish_time"))
            .filter(F.col("buyer_user_id") != F.col("seller_user_id")))

    # -- community board -------------------------------------------------------
    def _build_post_category(self) -> DataFrame:
        return self._categories(self.raw("documents").select(F.col("lang").alias("name")))

    def _build_post(self) -> DataFrame:
        k = F.col("doc_id")
        cats = self.post_category.select("category_id", F.col("_source_name").alias("lang"))
        return self.raw("documents").join(cats, "lang").select(
            k.alias("post_id"), (k % self.n_user).alias("author_user_id"), "category_id",
            F.concat(F.col("source"), F.lit(" post #"), k.cast("string")).alias("title"),
            F.col("text").alias("content"), F.when(k % 10 == 9, "hidden").otherwise("visible").alias("status"),
            plus(ts_lit(EPOCH), "DAY", k % 50).alias("create_time"))

    def _build_post_comment(self) -> DataFrame:
        first = _first_row(self.raw("conversations"), ["conv_id", "turn"], ["role", "text"],
                           ["conv_id", "turn", "role", "text"])
        return first.select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("post_id"),
            ((F.col("conv_id") * 7 + F.col("turn")) % self.n_user).alias("user_id"),
            F.col("text").alias("content"),
            plus(plus(ts_lit(EPOCH), "DAY", 60), "HOUR", F.col("turn")).alias("create_time"))

    def _build_post_like(self) -> DataFrame:
        views = self.raw("events").filter(F.col("event_type") == "view")
        return (views.groupBy((F.col("event_id") % self.n_post).alias("post_id"), "user_id")
                .agg(F.min("event_id").alias("like_id"), F.min("ts").alias("create_time"))
                .select("like_id", "post_id", "user_id", "create_time"))

    def table(self, name: str) -> DataFrame:
        df = getattr(self, name)
        return df.drop("_source_name") if "_source_name" in df.columns else df


for _name in ['user_account', 'student', 'club', 'venue', 'activity', 'activity_registration', 'line_first', 'checkin', 'resource_item', 'borrow_order', 'penalty', 'product_category', 'product', 'trade_order', 'post_category', 'post', 'post_comment', 'post_like']:
    setattr(Campus, _name, _stored(_name))
