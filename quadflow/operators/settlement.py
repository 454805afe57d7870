"""Settlement, overdue sweep, cascade delete, status changes and audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.functions.ordering import numbered, running_count
from quadflow.functions.scalar import json_of, strip, ts_text
from quadflow.operators.folds import clamped_fold
from quadflow.operators.listings import can_manage
from quadflow.sources.schemas import ACTIVITY_STATUS

# Penalty reasons written by the procedure and the event.
NO_SHOW_REASON = "Absent after successful registration"
OVERDUE_REASON = "Resource overdue return"
SWEEP_REASON = "Resource overdue return (event)"


def _ids(df: DataFrame, current_max: Column, name: str, order: list[Column | str]) -> DataFrame:
    """Auto-increment ids for inserted rows: ``max(id)`` plus the row's position."""
    out = numbered(df, order, "_o")
    return out.withColumn(name, (F.coalesce(current_max, F.lit(0)) + F.col("_o")).cast("long")).drop("_o")


# -- FIN ----------------------------------------------------------------------------------

def finish_guard(targets: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    """FIN-1: missing -> not ongoing -> end time not reached -> ok."""
    act = activity.select("activity_id", "status", "end_time", F.lit(True).alias("_has"))
    x = targets.select("activity_id").distinct().join(act, "activity_id", "left")
    outcome = (F.when(F.col("_has").isNull(), "missing").when(F.col("status") != "ongoing", "not_ongoing")
               .when(as_of < F.col("end_time"), "not_ended").otherwise("ok"))
    return x.select("activity_id", outcome.alias("outcome"), "end_time")


class Settlement:
    """FIN-2..6 for every activity that passes the guard, applied as if the
    procedure ran once per activity in (end_time, activity_id) order.
    ``registration`` may be a function that opens the table: it is called only
    for what depends on sign-ups, which marking orders does not."""

    def __init__(self, guard: DataFrame, registration: DataFrame | Callable[[], DataFrame], student: DataFrame,
                 borrow_order: DataFrame, as_of: Column):
        self.settled = guard.filter(F.col("outcome") == "ok").select("activity_id", "end_time")
        self._registration = registration
        self.student = student
        self.borrow_order = borrow_order
        self.as_of = as_of

    @property
    def registration(self) -> DataFrame:
        return self._registration() if callable(self._registration) else self._registration

    @property
    def confirmed(self) -> DataFrame:
        return (self.registration.filter(F.col("reg_status") == "confirmed")
                .join(self.settled, "activity_id")
                .withColumn("_checked", F.col("checkin_status") == "checked"))

    @property
    def orders_after(self) -> DataFrame:
        """FIN-4 applied: borrowed orders of settled activities past due."""
        bo = self.borrow_order.join(self.settled.select("activity_id", F.lit(True).alias("_s")), "activity_id", "left")
        due = (F.col("_s").isNotNull() & (F.col("order_status") == "borrowed")
               & (F.col("expected_return_time") < self.as_of))
        return bo.withColumn("_marked", due) \
            .withColumn("order_status", F.when(F.col("_marked"), "overdue").otherwise(F.col("order_status"))).drop("_s")

    @property
    def overdue_pairs(self) -> DataFrame:
        """FIN-5 rows: distinct (student, activity, order) over every overdue
        order of a settled activity whose applicant is a student."""
        bo = (self.orders_after.filter(F.col("order_status") == "overdue")
              .join(self.settled, "activity_id"))
        st = self.student.select("student_id", F.col("user_id").alias("applicant_user_id"))
        return bo.join(st, "applicant_user_id").select("student_id", "activity_id", "order_id", "end_time").distinct()

    def noshow_rows(self) -> DataFrame:
        return self.confirmed.filter(~F.col("_checked")).select("student_id", "activity_id", "end_time")

    def penalties(self, current_max: Column) -> DataFrame:
        """FIN-3 and FIN-5 rows with ids in settlement order."""
        noshow = self.noshow_rows().select(
            "student_id", "activity_id", F.lit(None).cast("long").alias("order_id"), "end_time",
            F.lit(0).alias("_kind"), F.lit("no_show").alias("penalty_type"), F.lit(NO_SHOW_REASON).alias("reason"),
            F.lit("closed").alias("status"))
        overdue = self.overdue_pairs.select(
            "student_id", "activity_id", "order_id", "end_time", F.lit(1).alias("_kind"),
            F.lit("overdue").alias("penalty_type"), F.lit(OVERDUE_REASON).alias("reason"), F.lit("unpaid").alias("status"))
        rows = noshow.unionByName(overdue)
        rows = _ids(rows, current_max, "penalty_id", ["end_time", "activity_id", "_kind", "student_id", "order_id"])
        return rows.select("penalty_id", "student_id", "activity_id", "order_id", "penalty_type", "reason",
                           F.lit(0).cast("decimal(10,2)").alias("amount"), "status",
                           self.as_of.alias("create_time"))

    def credit_hits(self) -> DataFrame:
        """FIN-6: one -8 per (student, activity), however many overdue orders."""
        return self.overdue_pairs.select("student_id", "activity_id", "end_time").distinct() \
            .withColumn("credit_delta", F.lit(-8))

    def credit_ops(self) -> DataFrame:
        reg = self.confirmed.select("student_id", "activity_id", "end_time", F.lit(0).alias("step"),
                                    F.when(F.col("_checked"), 1).otherwise(-5).alias("delta"))
        od = self.credit_hits().select("student_id", "activity_id", "end_time", F.lit(1).alias("step"),
                                       F.col("credit_delta").alias("delta"))
        return reg.unionByName(od)

    def credit(self) -> DataFrame:
        """FOLD-1: final credit of every student the settlement touches."""
        return clamped_fold(self.credit_ops(), self.student.select("student_id", F.col("credit_score").alias("score")),
                            "student_id", 0, 120, ts="end_time", order=("activity_id", "step")) \
            .withColumnRenamed("score", "credit_score")

    def students(self) -> DataFrame:
        """FIN-2 + FIN-6: new points, violations and credit per touched student."""
        counts = self.confirmed.groupBy("student_id").agg(
            F.sum(F.when(F.col("_checked"), 5).otherwise(0)).alias("_pts"),
            F.sum(F.when(F.col("_checked"), 0).otherwise(1)).alias("_vio"))
        touched = self.credit()
        return (touched.join(counts, "student_id", "left")
                .join(self.student.select("student_id", "points", "violation_count"), "student_id")
                .select("student_id", (F.col("points") + F.coalesce("_pts", F.lit(0))).cast("int").alias("points"),
                        (F.col("violation_count") + F.coalesce("_vio", F.lit(0))).cast("int").alias("violation_count"),
                        "credit_score"))


# -- SWP ----------------------------------------------------------------------------------

def overdue_sweep(borrow_order: DataFrame, penalty: DataFrame, student: DataFrame,
                  as_of: Column) -> tuple[DataFrame, DataFrame]:
    """SWP-1: mark past-due borrowed orders overdue, then one penalty for
    every overdue order that has no overdue penalty yet. Idempotent. Returns
    the orders after it and the new penalties alone."""
    due = (F.col("order_status") == "borrowed") & (F.col("expected_return_time") < as_of)
    orders = borrow_order.withColumn("order_status", F.when(due, "overdue").otherwise(F.col("order_status")))
    return orders, _sweep_penalties(orders.withColumn("_at", as_of), penalty, student)


def _sweep_penalties(orders: DataFrame, penalty: DataFrame, student: DataFrame) -> DataFrame:
    """New penalties of overdue orders, written at ``_at``."""
    has = penalty.filter(F.col("penalty_type") == "overdue").select("order_id").distinct()
    st = student.select("student_id", F.col("user_id").alias("applicant_user_id"))
    todo = (orders.filter(F.col("order_status") == "overdue").join(has, "order_id", "left_anti")
            .join(st, "applicant_user_id"))
    rows = _ids(todo, penalty.select(F.max("penalty_id")).scalar(), "penalty_id", ["_at", "order_id", "student_id"])
    return rows.select("penalty_id", "student_id", "activity_id", "order_id", F.lit("overdue").alias("penalty_type"),
                       F.lit(SWEEP_REASON).alias("reason"), F.lit(0).cast("decimal(10,2)").alias("amount"),
                       F.lit("unpaid").alias("status"), F.col("_at").alias("create_time"))


def sweep_ticks(borrow_order: DataFrame, penalty: DataFrame, student: DataFrame, ticks: list) -> tuple[DataFrame, DataFrame]:
    """SWP-1 at every one of ``ticks`` (sorted times), as if swept one after
    the other: an order is marked at the first tick after it was due, one that
    was overdue before gets its penalty at the first tick. Returns the ids
    marked and the new penalties."""
    times = F.array(*[F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in ticks])
    first = F.get(F.filter(times, lambda t: t > F.col("expected_return_time")), F.lit(0))  # null if there is none
    at = F.when(F.col("order_status") == "borrowed", first).when(F.col("order_status") == "overdue", times[0])
    swept = borrow_order.withColumn("_at", at).filter("_at is not null")
    marked = swept.filter(F.col("order_status") == "borrowed").select("order_id")
    return marked, _sweep_penalties(swept.withColumn("order_status", F.lit("overdue")), penalty, student)


# -- DEL ----------------------------------------------------------------------------------

def cascade_delete(targets: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """DEL-1: delete cancelled activities with every dependent row.

    Returns the guard outcome per target and, per table, the deleted rows.
    The penalty predicate ``activity_id IN D OR order_id IN orders(D)`` is
    split into two anti-join-able key sets so both stay equi-joins.
    """
    act = tables["activity"].select("activity_id", "status", F.lit(True).alias("_has"))
    guard = targets.select("activity_id").distinct().join(act, "activity_id", "left").select(
        "activity_id", F.when(F.col("_has").isNull(), "missing").when(F.col("status") != "cancelled", "not_cancelled")
        .otherwise("ok").alias("outcome"))
    doomed = guard.filter(F.col("outcome") == "ok").select("activity_id")
    regs = tables["activity_registration"].join(doomed, "activity_id", "left_semi")
    orders = tables["borrow_order"].join(doomed, "activity_id", "left_semi")
    pen = tables["penalty"]
    by_act = pen.join(doomed, "activity_id", "left_semi")
    by_order = pen.join(orders.select("order_id"), "order_id", "left_semi")
    deleted = {
        "checkin": tables["checkin"].join(regs.select("reg_id"), "reg_id", "left_semi"),
        "penalty": by_act.unionByName(by_order).dropDuplicates(["penalty_id"]),
        "borrow_detail": tables["borrow_detail"].join(orders.select("order_id"), "order_id", "left_semi"),
        "borrow_order": orders,
        "activity_registration": regs,
        "activity": tables["activity"].join(doomed, "activity_id", "left_semi"),
    }
    return guard, deleted


# -- AUD / STA ------------------------------------------------------------------------------

def audit_orders(old: DataFrame, new: DataFrame, op_time: Column) -> DataFrame:
    """AUD-1 for borrow orders: a row per order whose status changed, with
    status and return time before and after; operator = applicant."""
    o = old.select("order_id", F.col("order_status").alias("_os"), F.col("actual_return_time").alias("_ot"))
    x = new.join(o, "order_id").filter(F.col("order_status") != F.col("_os"))
    return x.select(
        F.lit("borrow_order").alias("biz_type"), F.col("order_id").alias("biz_id"), F.lit("status_change").alias("action"),
        F.col("applicant_user_id").alias("operator_id"),
        json_of(order_status=F.col("_os"), actual_return_time=ts_text(F.col("_ot"))).alias("old_data"),
        json_of(order_status=F.col("order_status"), actual_return_time=ts_text(F.col("actual_return_time")))
        .alias("new_data"), op_time.alias("op_time"))


def audit_activity(old: DataFrame, new: DataFrame, op_time: Column) -> DataFrame:
    """AUD-1 for activities (operator NULL)."""
    o = old.select("activity_id", F.col("status").alias("_os"))
    x = new.join(o, "activity_id").filter(F.col("status") != F.col("_os"))
    return x.select(
        F.lit("activity").alias("biz_type"), F.col("activity_id").alias("biz_id"), F.lit("status_change").alias("action"),
        F.lit(None).cast("long").alias("operator_id"), json_of(status=F.col("_os")).alias("old_data"),
        json_of(status=F.col("status")).alias("new_data"), op_time.alias("op_time"))


def _permitted(requests: DataFrame, activity: DataFrame, viewers: DataFrame) -> DataFrame:
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"),
                            F.col("club_id").alias("_club"))
    return (requests.join(activity.select("activity_id", F.col("club_id").alias("_act_club"),
                                          F.col("status").alias("_current")), "activity_id")
            .join(actors, "actor_user_id")
            .filter(can_manage(F.col("_role"), F.col("_club"), F.col("_act_club"))))


def permitted_changes(requests: DataFrame, activity: DataFrame, viewers: DataFrame) -> DataFrame:
    """Changes to a listed status by someone who may manage the activity, with
    its status before all of them (``_current``)."""
    return _permitted(requests.filter(F.col("status").isin(*ACTIVITY_STATUS)), activity, viewers)


def activities_after(activity: DataFrame, steps: DataFrame) -> DataFrame:
    """STA-1 state: the activity table after the changes."""
    final = steps.groupBy("activity_id").agg(F.max(F.struct("ts", "request_id", "new_status")).alias("_l"))
    return (activity.join(final, "activity_id", "left").withColumn("status", F.coalesce(F.col("_l.new_status"), F.col("status")))
            .drop("_l"))


def status_changes(requests: DataFrame, activity: DataFrame, viewers: DataFrame) -> DataFrame:
    """STA-1: every accepted status change as (old, new) in request order;
    rows with old <> new are the audit trail. The last row per activity is
    its final status.

    The previous step is found without a per-activity window: accepted steps
    are counted per activity over sorted pieces, and step n is equi-joined to step
    n - 1 on (activity, n), a key that is unique, so a hot activity spreads
    over many tasks."""
    ok = permitted_changes(requests, activity, viewers)
    steps = running_count(ok, "activity_id", ["ts", "request_id"], F.lit(True), "_n")
    prev = steps.select("activity_id", (F.col("_n") + 1).alias("_n"), F.col("status").alias("_prev"))
    joined = steps.join(prev, ["activity_id", "_n"], "left")
    return joined.select("request_id", "ts", "activity_id",
                         F.coalesce(F.col("_prev"), F.col("_current")).alias("old_status"),
                         F.col("status").alias("new_status"))


def status_audit(steps: DataFrame) -> DataFrame:
    changed = steps.filter(F.col("old_status") != F.col("new_status"))
    return changed.select(
        F.lit("activity").alias("biz_type"), F.col("activity_id").alias("biz_id"), F.lit("status_change").alias("action"),
        F.lit(None).cast("long").alias("operator_id"), json_of(status=F.col("old_status")).alias("old_data"),
        json_of(status=F.col("new_status")).alias("new_data"), F.col("ts").alias("op_time"), "request_id")


def _nullif_blank(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", F.lit(None)).otherwise(t)


def _digits(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"\A[0-9]+\z"), F.lit(False))


def validate_activity_form(forms: DataFrame) -> Column:
    """DQ-5 form rule: trimmed title present, venue id and capacity digits."""
    return (F.coalesce(strip("title") != "", F.lit(False)) & _digits(F.col("venue_id"))
            & _digits(F.col("max_capacity")))


def _form_values(forms: DataFrame) -> DataFrame:
    return forms.select(
        "*", strip("title").alias("_title"), _nullif_blank(F.col("category")).alias("_category"),
        strip("venue_id").try_cast("long").alias("_venue"), strip("max_capacity").try_cast("int").alias("_cap"),
        _nullif_blank(F.col("description")).alias("_desc"))


def _db_checks(x: DataFrame, venue: DataFrame) -> Column:
    """What the database enforces on write: venue FK and the CHECKs."""
    rules = (F.col("_venue_ok").isNotNull() & (F.col("end_time") > F.col("start_time"))
             & (F.col("signup_deadline") <= F.col("start_time")) & (F.col("_cap") > 0)
             & (F.char_length("_title") <= 200) & (F.coalesce(F.char_length("_category"), F.lit(0)) <= 50))
    return F.coalesce(rules, F.lit(False))  # these columns are NOT NULL, so an unknown rule is a broken one


def activity_update(forms: DataFrame, activity: DataFrame, venue: DataFrame, viewers: DataFrame) -> DataFrame:
    """STA-2: validated updates, last accepted per activity wins. Status is
    not touched, so no audit row follows."""
    valid = _form_values(forms.filter(validate_activity_form(forms)))
    ok = _permitted(valid, activity, viewers)
    ok = ok.join(venue.select(F.col("venue_id").alias("_venue"), F.lit(True).alias("_venue_ok")), "_venue", "left")
    ok = ok.filter(_db_checks(ok, venue))
    last = ok.groupBy("activity_id").agg(F.max(F.struct(
        "ts", "request_id", "_title", "_category", "_venue", "start_time", "end_time", "signup_deadline", "_cap",
        "_desc")).alias("u"))
    return last.select(
        "activity_id", F.col("u.request_id").alias("request_id"), F.col("u._title").alias("title"),
        F.col("u._category").alias("category"), F.col("u._venue").alias("venue_id"),
        F.col("u.start_time").alias("start_time"), F.col("u.end_time").alias("end_time"),
        F.col("u.signup_deadline").alias("signup_deadline"), F.col("u._cap").alias("max_capacity"),
        F.col("u._desc").alias("description"))


def ingest_activity(forms: DataFrame, activity: DataFrame, venue: DataFrame, club: DataFrame,
                    viewers: DataFrame) -> DataFrame:
    """DQ-5: activity creation. Form rule, then (admin) a digit club id or
    (club account) its own club, then the database rules (NOT NULL club, FK
    club and venue, CHECKs). Created rows are drafts with new ids."""
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"),
                            F.col("club_id").alias("_own_club"))
    x = _form_values(forms.drop("activity_id")).join(actors, "actor_user_id", "left")
    admin = F.col("_role") == "admin"
    club_id = F.when(admin, strip("club_id").try_cast("long")).otherwise(F.col("_own_club"))
    x = x.withColumn("_club", club_id)
    x = x.join(venue.select(F.col("venue_id").alias("_venue"), F.lit(True).alias("_venue_ok")), "_venue", "left")
    x = x.join(club.select(F.col("club_id").alias("_club"), F.lit(True).alias("_club_ok")), "_club", "left")
    reason = (F.when(~F.coalesce(F.col("_role").isin("admin", "club"), F.lit(False)), "forbidden")
              .when(~validate_activity_form(x), "invalid_form")
              .when(admin & ~_digits(F.col("club_id")), "club_required")
              .when(F.col("_club").isNull() | F.col("_club_ok").isNull() | ~_db_checks(x, venue), "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    created = _ids(x.filter(F.col("outcome") == "created"), activity.select(F.max("activity_id")).scalar(),
                   "activity_id", ["ts", "request_id"])
    cols = [F.col("_club").alias("club_id"), F.col("_venue").alias("venue_id"), F.col("_title").alias("title"),
            F.col("_category").alias("category"), "start_time", "end_time", "signup_deadline",
            F.col("_cap").alias("max_capacity"), F.col("_desc").alias("description")]
    ok = created.select("request_id", "outcome", "activity_id", *cols)
    bad = x.filter(F.col("outcome") != "created").select(
        "request_id", "outcome", F.lit(None).cast("long").alias("activity_id"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("club_id", "long"), ("venue_id", "long"), ("title", "string"),
                                                   ("category", "string"), ("start_time", "timestamp_ntz"),
                                                   ("end_time", "timestamp_ntz"), ("signup_deadline", "timestamp_ntz"),
                                                   ("max_capacity", "int"), ("description", "string"))])
    return ok.unionByName(bad)
