"""Ordered batch transitions on sign-ups, check-ins and likes.

Each operator takes the current state and a request batch, and returns the
per-request outcome (and new state rows) that serial one-by-one processing in
``(ts, request_id)`` order would give. Ordering is expressed with aggregates
and skew-safe ordinals, never by collecting a key's rows into one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.functions.ordering import numbered, ordinal, running_count, time_bucket
from quadflow.sources.tables import with_defaults

# Registration rejection reasons, the trigger's messages and
# the friendly page messages they map to.
REG_MESSAGES = {
    "missing": ("Activity does not exist", "活动不存在或已被删除。"),
    "not_published": ("Activity is not published", "活动尚未发布，暂不能报名。"),
    "deadline_passed": ("Signup deadline has passed", "报名截止时间已过。"),
    "duplicate": ("Duplicate registration is not allowed", "你已经报过这个活动，不能重复报名。"),
    "low_credit": ("Credit score too low for hot activity", "当前信用分不足，无法报名热门活动。"),
}
GENERIC_MESSAGE = "系统拒绝此次报名，请检查活动状态或稍后再试。详情："
FOREIGN_KEY_MESSAGE = "Cannot add or update a child row: a foreign key constraint fails"


def _order_key() -> Column:
    return F.struct(F.col("ts"), F.col("request_id"))


def new_ids(df: DataFrame, current_max: Column, name: str) -> DataFrame:
    """Auto-increment ids for inserted rows: ``max(id)`` plus the position in
    request order."""
    out = numbered(df, ["ts", "request_id"], "_new_ord")
    return out.withColumn(name, (F.coalesce(current_max, F.lit(0)) + F.col("_new_ord")).cast("long")).drop("_new_ord")


def admit_registrations(requests: DataFrame, activity: DataFrame, student: DataFrame,
                        registration: DataFrame) -> DataFrame:
    """REG-1. Outcome per request: ``confirmed`` / ``waiting`` with queue and
    new reg id, or the first failing rule.

    * rules before the duplicate check: missing, not published, past deadline;
    * duplicate: the pair is registered already (any status) or an earlier
      request of the pair was *admitted* -- a request is admitted exactly when
      it passes every other rule, so "earlier eligible request exists";
    * then low credit for hot activities, then the student foreign key;
    * seats: admitted requests are ranked per activity; ranks within the free
      seats confirm, the rest queue after the current longest queue number.
    """
    req = requests.select("request_id", "ts", "activity_id", "student_id")
    act = activity.select("activity_id", "status", "signup_deadline", "max_capacity", "category",
                          F.lit(True).alias("_has_act"))
    st = student.select("student_id", "credit_score", F.lit(True).alias("_has_st"))
    # Only registrations of requested activities matter for pairs, seats and
    # queues: reduce the state with a semi join on the batch's activity ids
    # (broadcast by AQE when small) before anything is shuffled.
    relevant = registration.join(req.select("activity_id").distinct(), "activity_id", "left_semi")
    pairs = relevant.select("activity_id", "student_id").distinct().withColumn("_existing", F.lit(True))
    x = (req.join(act, "activity_id", "left").join(st, "student_id", "left")
         .join(pairs, ["activity_id", "student_id"], "left"))
    missing = F.col("_has_act").isNull()
    not_pub = F.col("status") != "published"
    late = F.col("ts") > F.col("signup_deadline")
    low = F.coalesce((F.col("category") == "hot") & (F.col("credit_score") < 60), F.lit(False))
    unknown = F.col("_has_st").isNull()
    x = x.withColumn("_eligible", ~missing & ~not_pub & ~late & ~low & ~unknown)
    first = (x.filter("_eligible").groupBy("activity_id", "student_id")
             .agg(F.min(_order_key()).alias("_first")))
    x = x.join(first, ["activity_id", "student_id"], "left")
    dup = F.col("_existing").isNotNull() | (F.col("_first").isNotNull() & (_order_key() > F.col("_first")))
    reason = (F.when(missing, "missing").when(not_pub, "not_published").when(late, "deadline_passed")
              .when(dup, "duplicate").when(low, "low_credit").when(unknown, "unknown_student"))
    x = x.withColumn("reason", reason)

    admitted = x.filter(F.col("reason").isNull())
    ranked = running_count(admitted, "activity_id", ["ts", "request_id"], F.lit(True), "_rank").withColumn("_rank", F.col("_rank") + 1)
    counts = relevant.groupBy("activity_id").agg(
        F.count(F.when(F.col("reg_status") == "confirmed", 1)).alias("_confirmed"),
        F.max(F.when(F.col("reg_status") == "waiting", F.col("queue_no"))).alias("_max_q"))
    ranked = ranked.join(counts, "activity_id", "left")
    free = F.greatest(F.col("max_capacity") - F.coalesce("_confirmed", F.lit(0)), F.lit(0))
    seated = F.col("_rank") <= free
    ranked = ranked.withColumn("outcome", F.when(seated, "confirmed").otherwise("waiting")) \
        .withColumn("queue_no", F.when(seated, F.lit(None)).otherwise(
            F.coalesce("_max_q", F.lit(0)) + F.col("_rank") - free).cast("int"))
    ranked = new_ids(ranked, registration.select(F.max("reg_id")).scalar(), "reg_id")
    accepted = ranked.select("request_id", "activity_id", "student_id", "ts", "outcome", "queue_no", "reg_id")
    rejected = x.filter(F.col("reason").isNotNull()).select(
        "request_id", "activity_id", "student_id", "ts", F.col("reason").alias("outcome"),
        F.lit(None).cast("int").alias("queue_no"), F.lit(None).cast("long").alias("reg_id"))
    return accepted.unionByName(rejected)


def registrations_after(registration: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New registration snapshot: existing rows plus the admitted requests."""
    added = outcomes.filter(F.col("reg_id").isNotNull()).select(
        "reg_id", "activity_id", "student_id", F.col("ts").alias("register_time"),
        F.col("outcome").alias("reg_status"), "queue_no")
    # SCH-2: the insert names only these columns; the rest take their defaults.
    added = with_defaults(added, {"audit_status": F.lit("approved"), "checkin_status": F.lit("not_checked")})
    return registration.unionByName(added)


def rejection_messages(outcomes: DataFrame) -> DataFrame:
    """REG-2: reason code -> trigger message and page message (a literal
    map lookup, JVM-side); unknown reasons get the generic text."""
    raw = F.create_map(*[v for k, (m, _) in REG_MESSAGES.items() for v in (F.lit(k), F.lit(m))])
    friendly = F.create_map(*[v for k, (_, f) in REG_MESSAGES.items() for v in (F.lit(k), F.lit(f))])
    rejected = outcomes.filter(~F.col("outcome").isin("confirmed", "waiting"))
    error = F.coalesce(raw[F.col("outcome")], F.lit(FOREIGN_KEY_MESSAGE))
    return rejected.select("request_id", F.col("outcome").alias("reason"), error.alias("error"),
                           F.coalesce(friendly[F.col("outcome")], F.concat(F.lit(GENERIC_MESSAGE), error))
                           .alias("message"))


def promote_waitlist(registration: DataFrame, promotions: DataFrame | None = None, k: int = 1) -> DataFrame:
    """REG-3: per activity, the k lowest queue numbers (NULL first, reg_id
    breaks ties) become confirmed; the rest are renumbered 1..n. No capacity
    check, as in the reference. ``promotions`` (activity_id, count) gives a
    number per activity; activities it leaves out are left alone. Positions are
    counted over sorted pieces, so one long waitlist lies in many tasks."""
    waiting = registration.filter(F.col("reg_status") == "waiting")
    if promotions is not None:
        waiting = waiting.join(promotions.select("activity_id", F.col("count").alias("_k")), "activity_id")
    else:
        waiting = waiting.withColumn("_k", F.lit(k))
    ranked = running_count(waiting, "activity_id", ["queue_no", "reg_id"], F.lit(True), "_rn").withColumn("_rn", F.col("_rn") + 1)
    promoted = F.col("_rn") <= F.col("_k")
    return ranked.select(
        "reg_id", "activity_id", "student_id",
        F.when(promoted, "confirmed").otherwise("waiting").alias("reg_status"),
        F.when(promoted, F.lit(None)).otherwise(F.col("_rn") - F.col("_k")).cast("int").alias("queue_no"))


def _counted_checkins(requests: DataFrame, registration: DataFrame, activity: DataFrame,
                      viewers: DataFrame) -> DataFrame:
    """CHK-1 requests that count, reduced to the last (and first) per registration."""
    from quadflow.operators.listings import can_manage
    regs = registration.select("reg_id", "activity_id", "reg_status").join(
        activity.select("activity_id", F.col("club_id").alias("_act_club")), "activity_id")
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"),
                            F.col("club_id").alias("_club"))
    ok = (requests.join(regs, "reg_id").join(actors, "actor_user_id")
          .filter(can_manage(F.col("_role"), F.col("_club"), F.col("_act_club")))
          .filter(F.col("reg_status") == "confirmed"))
    return ok.groupBy("reg_id").agg(
        F.max(F.struct("ts", "request_id", "actor_user_id", "status")).alias("_last"),
        F.min(_order_key()).alias("_first"))


def checkin_upsert(requests: DataFrame, registration: DataFrame, activity: DataFrame, viewers: DataFrame,
                   checkin: DataFrame) -> DataFrame:
    """CHK-1: returns the new check-in table.

    A request counts when its registration exists, the actor may manage the
    activity and the registration is confirmed. The last counted request per
    registration sets status, time and operator of *every* existing check-in
    row of it; a registration without one gets a new row whose id follows
    the order of its first counted request.
    """
    last = _counted_checkins(requests, registration, activity, viewers)
    updated = (checkin.join(last, "reg_id", "left").select(
        "checkin_id", "reg_id",
        F.coalesce(F.col("_last.ts"), F.col("checkin_time")).alias("checkin_time"),
        F.coalesce(F.col("_last.actor_user_id"), F.col("operator_id")).alias("operator_id"),
        F.coalesce(F.col("_last.status"), F.col("status")).alias("status")))
    fresh = last.join(checkin.select("reg_id"), "reg_id", "left_anti").select(
        "reg_id", F.col("_first.ts").alias("ts"), F.col("_first.request_id").alias("request_id"), "_last")
    fresh = new_ids(fresh, checkin.select(F.max("checkin_id")).scalar(), "checkin_id")
    inserted = fresh.select("checkin_id", "reg_id", F.col("_last.ts").alias("checkin_time"),
                            F.col("_last.actor_user_id").alias("operator_id"), F.col("_last.status").alias("status"))
    return updated.unionByName(inserted)


def checkin_registration_updates(requests: DataFrame, registration: DataFrame, activity: DataFrame,
                                 viewers: DataFrame) -> DataFrame:
    """CHK-1 (registration side): the check-in status each registration ends with."""
    last = _counted_checkins(requests, registration, activity, viewers)
    return last.select("reg_id", F.col("_last.status").alias("checkin_status"))


def toggle_likes(requests: DataFrame, post: DataFrame, post_like: DataFrame) -> DataFrame:
    """LIK-1: returns the new like table.

    Toggle i of a (post, user) pair inserts when the pair is unliked before
    it, i.e. when ``existing + i - 1`` is even. The final row of a liked pair
    is its last insert; its id is ``max(like_id)`` plus the insert's position
    among all inserts of the batch (the auto-increment order).
    """
    req = requests.join(post.select("post_id"), "post_id", "left_semi").select(
        "request_id", "ts", "post_id", F.col("actor_user_id").alias("user_id"))
    have = post_like.select("post_id", "user_id", F.lit(1).alias("_e"))
    req = req.join(have, ["post_id", "user_id"], "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    req = ordinal(req, ["post_id", "user_id"], [F.col("ts"), F.col("request_id")], time_bucket("ts"), "_i")
    inserts = req.filter((F.col("_e") + F.col("_i") - 1) % 2 == 0)
    inserts = new_ids(inserts, post_like.select(F.max("like_id")).scalar(), "like_id")
    per_pair = req.groupBy("post_id", "user_id").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    final_new = (inserts.join(per_pair, ["post_id", "user_id"])
                 .filter((F.col("_i") == F.col("_n")))
                 .select("like_id", "post_id", "user_id", F.col("ts").alias("create_time")))
    # A touched pair's old row is gone: its first toggle deleted it, and a later one inserts a new row.
    kept = post_like.join(per_pair.select("post_id", "user_id"), ["post_id", "user_id"], "left_anti")
    return kept.unionByName(final_new)


def like_changes(requests: DataFrame, post: DataFrame, post_like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LIK-1 as a delta: (rows inserted or replaced, pairs deleted), touching
    only the pairs the batch toggles. Same rules as ``toggle_likes``."""
    req = requests.join(post.select("post_id"), "post_id", "left_semi").select(
        "request_id", "ts", "post_id", F.col("actor_user_id").alias("user_id"))
    touched = req.select("post_id", "user_id").distinct()
    have = post_like.join(touched, ["post_id", "user_id"], "left_semi").select("post_id", "user_id",
                                                                               F.lit(1).alias("_e"))
    req = req.join(have, ["post_id", "user_id"], "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    req = ordinal(req, ["post_id", "user_id"], [F.col("ts"), F.col("request_id")], time_bucket("ts"), "_i")
    inserts = new_ids(req.filter((F.col("_e") + F.col("_i") - 1) % 2 == 0),
                      post_like.select(F.max("like_id")).scalar(), "like_id")
    per_pair = req.groupBy("post_id", "user_id").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    added = (inserts.join(per_pair, ["post_id", "user_id"]).filter(F.col("_i") == F.col("_n"))
             .select("like_id", "post_id", "user_id", F.col("ts").alias("create_time")))
    deleted = per_pair.filter((F.col("_e") == 1) & (F.col("_n") % 2 == 1)).select("post_id", "user_id")
    return added, deleted
