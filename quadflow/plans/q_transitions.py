"""Registered batch transitions (REG, CHK, LIK, FIN, SWP, DEL, AUD, STA, BOR, TRD, FOLD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadflow.operators import admission as A
from quadflow.plans.catalog import REGISTRY, query
from quadflow.plans.domain_sql import strip_sql, target_sql
from quadflow.plans.q_lists import _USER_DIM, viewers
from quadflow.sources.requests import _target

# -- REG ----------------------------------------------------------------------------------

_REG_SQL = """
WITH x AS (
  SELECT q.request_id, q.ts, q.activity_id, q.student_id, a.activity_id IS NOT NULL AS has_act, a.status,
         a.signup_deadline, a.max_capacity, a.category, s.student_id IS NOT NULL AS has_st, s.credit_score,
         EXISTS (SELECT 1 FROM activity_registration ar
                 WHERE ar.activity_id = q.activity_id AND ar.student_id = q.student_id) AS existing
  FROM reg_request q LEFT JOIN activity a ON a.activity_id = q.activity_id
  LEFT JOIN student s ON s.student_id = q.student_id),
y AS (SELECT *, COALESCE(has_act AND status = 'published' AND NOT (ts > signup_deadline)
                         AND NOT COALESCE(category = 'hot' AND credit_score < 60, false) AND has_st, false) AS eligible
      FROM x),
z AS (SELECT *, count(CASE WHEN eligible THEN 1 END) OVER (PARTITION BY activity_id, student_id ORDER BY ts, request_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_eligible FROM y),
r AS (SELECT *, CASE WHEN NOT has_act THEN 'missing' WHEN status <> 'published' THEN 'not_published'
                     WHEN ts > signup_deadline THEN 'deadline_passed' WHEN existing OR prior_eligible > 0 THEN 'duplicate'
                     WHEN COALESCE(category = 'hot' AND credit_score < 60, false) THEN 'low_credit'
                     WHEN NOT has_st THEN 'unknown_student' END AS reason FROM z),
acc AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts, request_id) AS rk,
               row_number() OVER (ORDER BY ts, request_id) AS gk FROM r WHERE reason IS NULL),
cnt AS (SELECT activity_id, count(CASE WHEN reg_status = 'confirmed' THEN 1 END) AS confirmed,
               max(CASE WHEN reg_status = 'waiting' THEN queue_no END) AS max_q
        FROM activity_registration GROUP BY activity_id),
out AS (
  SELECT acc.request_id, acc.activity_id, acc.student_id, acc.ts,
         CASE WHEN rk <= greatest(max_capacity - COALESCE(confirmed, 0), 0) THEN 'confirmed' ELSE 'waiting' END AS outcome,
         CAST(CASE WHEN rk <= greatest(max_capacity - COALESCE(confirmed, 0), 0) THEN NULL
                   ELSE COALESCE(max_q, 0) + rk - greatest(max_capacity - COALESCE(confirmed, 0), 0) END AS INTEGER) AS queue_no,
         (SELECT max(reg_id) FROM activity_registration) + gk AS reg_id
  FROM acc LEFT JOIN cnt ON cnt.activity_id = acc.activity_id
  UNION ALL
  SELECT request_id, activity_id, student_id, ts, reason AS outcome, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT)
  FROM r WHERE reason IS NOT NULL)"""


def _reg(c, r):
    return A.admit_registrations(r.registration, c.activity, c.student, c.activity_registration)


@query("reg_admission", _REG_SQL + "\nSELECT * FROM out")
def reg_admission(c, r):
    """REG-1 over every sign-up event."""
    return _reg(c, r)


_MSG_CASE = "\n".join(f"WHEN '{k}' THEN '{m}'" for k, (m, _) in A.REG_MESSAGES.items())
_FRIENDLY_CASE = "\n".join(f"WHEN '{k}' THEN '{f}'" for k, (_, f) in A.REG_MESSAGES.items())


@query("reg_rejections", _REG_SQL + f"""
SELECT request_id, outcome AS reason,
       CASE outcome {_MSG_CASE} ELSE '{A.FOREIGN_KEY_MESSAGE}' END AS error,
       CASE outcome {_FRIENDLY_CASE} ELSE '{A.GENERIC_MESSAGE}' || '{A.FOREIGN_KEY_MESSAGE}' END AS message
FROM out WHERE outcome NOT IN ('confirmed', 'waiting')""")
def reg_rejections(c, r):
    """REG-2."""
    return A.rejection_messages(_reg(c, r))


@query("waitlist_promote", """
SELECT reg_id, activity_id, student_id, CASE WHEN rn <= 1 THEN 'confirmed' ELSE 'waiting' END AS reg_status,
       CAST(CASE WHEN rn <= 1 THEN NULL ELSE rn - 1 END AS INTEGER) AS queue_no
FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY queue_no ASC NULLS FIRST, reg_id) AS rn
      FROM activity_registration WHERE reg_status = 'waiting') w""")
def waitlist_promote(c, r):
    """REG-3 with one promotion per activity that has waiters."""
    return A.promote_waitlist(c.activity_registration, k=1)


_FREE = """
SELECT a.activity_id, greatest(a.max_capacity - count(CASE WHEN ar.reg_status = 'confirmed' THEN 1 END), 0) AS k
FROM activity a LEFT JOIN activity_registration ar ON ar.activity_id = a.activity_id
WHERE a.status = 'published' GROUP BY a.activity_id, a.max_capacity"""


@query("waitlist_promote_free", f"""
SELECT reg_id, activity_id, student_id, CASE WHEN rn <= k THEN 'confirmed' ELSE 'waiting' END AS reg_status,
       CAST(CASE WHEN rn <= k THEN NULL ELSE rn - k END AS INTEGER) AS queue_no
FROM (SELECT ar.*, f.k, row_number() OVER (PARTITION BY ar.activity_id ORDER BY ar.queue_no ASC NULLS FIRST, ar.reg_id) AS rn
      FROM activity_registration ar JOIN ({_FREE}) f ON f.activity_id = ar.activity_id WHERE ar.reg_status = 'waiting') w""")
def waitlist_promote_free(c, r):
    """REG-3 as often per published activity as it has free seats."""
    taken = c.activity_registration.groupBy("activity_id").agg(F.count(F.when(F.col("reg_status") == "confirmed", 1)).alias("_n"))
    free = (c.activity.filter(F.col("status") == "published").join(taken, "activity_id", "left")
            .select("activity_id", F.greatest(F.col("max_capacity") - F.coalesce("_n", F.lit(0)), F.lit(0)).alias("count")))
    return A.promote_waitlist(c.activity_registration, free)


@query("checkin_upsert", f"""
WITH ok AS (
  SELECT q.* FROM checkin_request q
  JOIN activity_registration ar ON ar.reg_id = q.reg_id
  JOIN activity a ON a.activity_id = ar.activity_id
  JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id
  WHERE (d.role = 'admin' OR (d.role = 'club' AND d.club_id = a.club_id)) AND ar.reg_status = 'confirmed'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reg_id ORDER BY ts DESC, request_id DESC) AS rn FROM ok) t
         WHERE rn = 1),
first AS (SELECT reg_id, min(ts) AS fts FROM ok GROUP BY reg_id),
first_req AS (SELECT f.reg_id, f.fts, min(o.request_id) AS frid FROM first f JOIN ok o ON o.reg_id = f.reg_id AND o.ts = f.fts
              GROUP BY f.reg_id, f.fts),
fresh AS (SELECT l.*, fr.fts, fr.frid FROM last l JOIN first_req fr ON fr.reg_id = l.reg_id
          WHERE l.reg_id NOT IN (SELECT reg_id FROM checkin))
SELECT c.checkin_id, c.reg_id, COALESCE(l.ts, c.checkin_time) AS checkin_time,
       COALESCE(l.actor_user_id, c.operator_id) AS operator_id, COALESCE(l.status, c.status) AS status
FROM checkin c LEFT JOIN last l ON l.reg_id = c.reg_id
UNION ALL
SELECT (SELECT max(checkin_id) FROM checkin) + row_number() OVER (ORDER BY fts, frid) AS checkin_id, reg_id,
       ts AS checkin_time, actor_user_id AS operator_id, status
FROM fresh""")
def checkin_upsert(c, r):
    """CHK-1: the check-in table after every check-in / absence request."""
    return A.checkin_upsert(r.checkin, c.activity_registration, c.activity, viewers(c), c.checkin)


_LIKE_SQL = """
WITH q AS (
  SELECT l.request_id, l.ts, l.post_id, l.actor_user_id AS user_id,
         CASE WHEN EXISTS (SELECT 1 FROM post_like p WHERE p.post_id = l.post_id AND p.user_id = l.actor_user_id) THEN 1 ELSE 0 END AS e
  FROM like_request l WHERE l.post_id IN (SELECT post_id FROM post)),
n AS (SELECT *, row_number() OVER (PARTITION BY post_id, user_id ORDER BY ts, request_id) AS i,
             count(*) OVER (PARTITION BY post_id, user_id) AS cnt FROM q),
ins AS (SELECT *, (SELECT max(like_id) FROM post_like) + row_number() OVER (ORDER BY ts, request_id) AS like_id
        FROM n WHERE (e + i - 1) % 2 = 0),
touched AS (SELECT DISTINCT post_id, user_id FROM n)
SELECT p.like_id, p.post_id, p.user_id, p.create_time FROM post_like p
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.post_id = p.post_id AND t.user_id = p.user_id)
UNION ALL
SELECT like_id, post_id, user_id, ts AS create_time FROM ins WHERE i = cnt"""


@query("like_toggle", _LIKE_SQL)
def like_toggle(c, r):
    """LIK-1: the like table after every like toggle."""
    return A.toggle_likes(r.like, c.post, c.post_like)


# -- FIN / FOLD-1 ------------------------------------------------------------------------------

from quadflow.operators import settlement as S  # noqa: E402
from quadflow.sources.domain import AS_OF, ts_lit  # noqa: E402

_ASOF = f"TIMESTAMP '{AS_OF}'"
_FIN_SQL = f"""
WITH g AS (
  SELECT t.activity_id,
         CASE WHEN a.activity_id IS NULL THEN 'missing' WHEN a.status <> 'ongoing' THEN 'not_ongoing'
              WHEN {_ASOF} < a.end_time THEN 'not_ended' ELSE 'ok' END AS outcome, a.end_time
  FROM (SELECT activity_id FROM activity UNION SELECT activity_id FROM reg_request) t
  LEFT JOIN activity a ON a.activity_id = t.activity_id),
s AS (SELECT activity_id, end_time FROM g WHERE outcome = 'ok'),
conf AS (SELECT ar.student_id, ar.activity_id, s.end_time, ar.checkin_status = 'checked' AS checked
         FROM activity_registration ar JOIN s ON s.activity_id = ar.activity_id WHERE ar.reg_status = 'confirmed'),
bo2 AS (SELECT bo.order_id, bo.activity_id, bo.applicant_user_id, bo.order_status AS old_status,
               bo.actual_return_time,
               CASE WHEN s.activity_id IS NOT NULL AND bo.order_status = 'borrowed' AND bo.expected_return_time < {_ASOF}
                    THEN 'overdue' ELSE bo.order_status END AS order_status
        FROM borrow_order bo LEFT JOIN s ON s.activity_id = bo.activity_id),
odp AS (SELECT DISTINCT st.student_id, bo2.activity_id, bo2.order_id, s.end_time
        FROM bo2 JOIN s ON s.activity_id = bo2.activity_id JOIN user_account ua ON ua.user_id = bo2.applicant_user_id
        JOIN student st ON st.user_id = ua.user_id WHERE bo2.order_status = 'overdue'),
ops AS (SELECT student_id, end_time, activity_id, 0 AS step, CASE WHEN checked THEN 1 ELSE -5 END AS delta FROM conf
        UNION ALL SELECT DISTINCT student_id, end_time, activity_id, 1 AS step, -8 AS delta FROM odp),
fold AS (SELECT o.student_id,
                CAST(list_reduce(list_prepend(s.credit_score, list(o.delta ORDER BY o.end_time, o.activity_id, o.step)),
                                 lambda acc, d: least(120, greatest(0, acc + d))) AS INTEGER) AS credit_score
         FROM ops o JOIN student s ON s.student_id = o.student_id GROUP BY o.student_id, s.credit_score),
pen AS (SELECT student_id, activity_id, CAST(NULL AS BIGINT) AS order_id, end_time, 0 AS kind, 'no_show' AS penalty_type,
               '{S.NO_SHOW_REASON}' AS reason, 'closed' AS status FROM conf WHERE NOT checked
        UNION ALL
        SELECT student_id, activity_id, order_id, end_time, 1, 'overdue', '{S.OVERDUE_REASON}', 'unpaid' FROM odp),
pen_ids AS (SELECT (SELECT max(penalty_id) FROM penalty)
                   + row_number() OVER (ORDER BY end_time, activity_id, kind, student_id, order_id NULLS FIRST) AS penalty_id,
                   student_id, activity_id, order_id, penalty_type, reason, CAST(0 AS DECIMAL(10,2)) AS amount, status,
                   {_ASOF} AS create_time, kind FROM pen)"""


def _settlement(c, r):
    as_of = ts_lit(AS_OF)
    targets = c.activity.select("activity_id").unionByName(r.registration.select("activity_id"))
    guard = S.finish_guard(targets, c.activity, as_of)
    return S.Settlement(guard, lambda: c.activity_registration, c.student, c.borrow_order, as_of)


@query("finish_guard", _FIN_SQL + "\nSELECT activity_id, outcome, end_time FROM g")
def finish_guard(c, r):
    """FIN-1 for every activity (and every sign-up target)."""
    as_of = ts_lit(AS_OF)
    targets = c.activity.select("activity_id").unionByName(r.registration.select("activity_id"))
    return S.finish_guard(targets, c.activity, as_of)


@query("finish_students", _FIN_SQL + """
SELECT f.student_id, CAST(s.points + COALESCE(p.pts, 0) AS INTEGER) AS points,
       CAST(s.violation_count + COALESCE(p.vio, 0) AS INTEGER) AS violation_count, f.credit_score
FROM fold f JOIN student s ON s.student_id = f.student_id
LEFT JOIN (SELECT student_id, sum(CASE WHEN checked THEN 5 ELSE 0 END) AS pts, sum(CASE WHEN checked THEN 0 ELSE 1 END) AS vio
           FROM conf GROUP BY student_id) p ON p.student_id = f.student_id""")
def finish_students(c, r):
    """FIN-2 (+FIN-6 credit): students after settling every due activity."""
    return _settlement(c, r).students()


@query("credit_fold", _FIN_SQL + "\nSELECT student_id, credit_score FROM fold")
def credit_fold(c, r):
    """FOLD-1: clamped credit over many activities in end-time order."""
    return _settlement(c, r).credit()


def _penalties(c, r):
    return _settlement(c, r).penalties(c.penalty.select(F.max("penalty_id")).scalar())


@query("finish_noshow", _FIN_SQL + """
SELECT penalty_id, student_id, activity_id, order_id, penalty_type, reason, amount, status, create_time
FROM pen_ids WHERE kind = 0""")
def finish_noshow(c, r):
    """FIN-3."""
    return _penalties(c, r).filter(F.col("penalty_type") == "no_show")


@query("finish_overdue_penalty", _FIN_SQL + """
SELECT penalty_id, student_id, activity_id, order_id, penalty_type, reason, amount, status, create_time
FROM pen_ids WHERE kind = 1""")
def finish_overdue_penalty(c, r):
    """FIN-5 (no anti-join: may repeat a sweep penalty, as the procedure does)."""
    return _penalties(c, r).filter(F.col("penalty_type") == "overdue")


@query("finish_overdue", _FIN_SQL + """
SELECT order_id, activity_id, order_status FROM bo2 WHERE order_status <> old_status""")
def finish_overdue(c, r):
    """FIN-4."""
    return _settlement(c, r).orders_after.filter("_marked").select("order_id", "activity_id", "order_status")


@query("finish_overdue_credit", _FIN_SQL + """
SELECT DISTINCT student_id, activity_id, -8 AS credit_delta FROM odp""")
def finish_overdue_credit(c, r):
    """FIN-6: the -8 applications, one per (student, activity)."""
    return _settlement(c, r).credit_hits().select("student_id", "activity_id", "credit_delta")


@query("audit_activity", _FIN_SQL + f"""
SELECT 'activity' AS biz_type, activity_id AS biz_id, 'status_change' AS action, CAST(NULL AS BIGINT) AS operator_id,
       CAST(json_object('status', 'ongoing') AS VARCHAR) AS old_data,
       CAST(json_object('status', 'finished') AS VARCHAR) AS new_data, {_ASOF} AS op_time
FROM s""")
def audit_activity(c, r):
    """AUD-1 for the activities settlement moves from ongoing to finished."""
    st = _settlement(c, r)
    done = st.settled.select("activity_id", F.lit("finished").alias("_new"))
    new = c.activity.join(done, "activity_id", "left").withColumn(
        "status", F.coalesce(F.col("_new"), F.col("status"))).drop("_new")
    return S.audit_activity(c.activity, new, ts_lit(AS_OF))


@query("audit_orders", _FIN_SQL + f"""
SELECT 'borrow_order' AS biz_type, order_id AS biz_id, 'status_change' AS action, applicant_user_id AS operator_id,
       CAST(json_object('order_status', old_status, 'actual_return_time', strftime(actual_return_time, '%Y-%m-%d %H:%M:%S')) AS VARCHAR) AS old_data,
       CAST(json_object('order_status', order_status, 'actual_return_time', strftime(actual_return_time, '%Y-%m-%d %H:%M:%S')) AS VARCHAR) AS new_data,
       {_ASOF} AS op_time
FROM bo2 WHERE order_status <> old_status""")
def audit_orders(c, r):
    """AUD-1 for the orders settlement marks overdue."""
    return S.audit_orders(c.borrow_order, _settlement(c, r).orders_after, ts_lit(AS_OF))


# -- SWP / DEL / STA -------------------------------------------------------------------------

@query("overdue_sweep", f"""
WITH bo2 AS (SELECT order_id, activity_id, applicant_user_id,
                    CASE WHEN order_status = 'borrowed' AND expected_return_time < {_ASOF} THEN 'overdue'
                         ELSE order_status END AS order_status FROM borrow_order),
todo AS (SELECT st.student_id, bo2.activity_id, bo2.order_id FROM bo2
         JOIN user_account ua ON ua.user_id = bo2.applicant_user_id JOIN student st ON st.user_id = ua.user_id
         WHERE bo2.order_status = 'overdue'
           AND NOT EXISTS (SELECT 1 FROM penalty p WHERE p.order_id = bo2.order_id AND p.penalty_type = 'overdue'))
SELECT (SELECT max(penalty_id) FROM penalty) + row_number() OVER (ORDER BY order_id, student_id) AS penalty_id,
       student_id, activity_id, order_id, 'overdue' AS penalty_type, '{S.SWEEP_REASON}' AS reason,
       CAST(0 AS DECIMAL(10,2)) AS amount, 'unpaid' AS status, {_ASOF} AS create_time
FROM todo""")
def overdue_sweep(c, r):
    """SWP-1: the penalties one sweep at as_of inserts."""
    _, penalties = S.overdue_sweep(c.borrow_order, c.penalty, c.student, ts_lit(AS_OF))
    return penalties


@query("cascade_delete", """
WITH d AS (SELECT activity_id FROM activity WHERE status = 'cancelled'
           AND activity_id IN (SELECT activity_id FROM status_request)),
regs AS (SELECT reg_id FROM activity_registration WHERE activity_id IN (SELECT activity_id FROM d)),
ords AS (SELECT order_id FROM borrow_order WHERE activity_id IN (SELECT activity_id FROM d))
SELECT 'checkin' AS table_name, checkin_id AS row_id FROM checkin WHERE reg_id IN (SELECT reg_id FROM regs)
UNION ALL SELECT 'penalty', penalty_id FROM penalty
  WHERE activity_id IN (SELECT activity_id FROM d) OR order_id IN (SELECT order_id FROM ords)
UNION ALL SELECT 'borrow_detail', detail_id FROM borrow_detail WHERE order_id IN (SELECT order_id FROM ords)
UNION ALL SELECT 'borrow_order', order_id FROM ords
UNION ALL SELECT 'activity_registration', reg_id FROM regs
UNION ALL SELECT 'activity', activity_id FROM d""")
def cascade_delete(c, r):
    """DEL-1: rows deleted when every activity named in the status log is
    deleted (only cancelled ones pass the guard)."""
    tables = {n: c.table(n) for n in ("activity", "activity_registration", "borrow_order", "borrow_detail",
                                      "penalty", "checkin")}
    _, deleted = S.cascade_delete(r.status_change, tables)
    keys = {"checkin": "checkin_id", "penalty": "penalty_id", "borrow_detail": "detail_id",
            "borrow_order": "order_id", "activity_registration": "reg_id", "activity": "activity_id"}
    out = None
    for name, df in deleted.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(keys[name]).alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


_STATUS_SQL = f"""
WITH ok AS (SELECT q.*, a.status AS cur FROM status_request q JOIN activity a ON a.activity_id = q.activity_id
            JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id
            WHERE q.status IN ('draft', 'published', 'ongoing', 'finished', 'cancelled')
              AND (d.role = 'admin' OR (d.role = 'club' AND d.club_id = a.club_id))),
st AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY activity_id ORDER BY ts, request_id), cur) AS old_status FROM ok)
SELECT 'activity' AS biz_type, activity_id AS biz_id, 'status_change' AS action, CAST(NULL AS BIGINT) AS operator_id,
       CAST(json_object('status', old_status) AS VARCHAR) AS old_data, CAST(json_object('status', status) AS VARCHAR) AS new_data,
       ts AS op_time, request_id
FROM st WHERE old_status <> status"""


@query("status_changes", _STATUS_SQL)
def status_changes(c, r):
    """STA-1: audit rows of every effective status change in the log."""
    return S.status_audit(S.status_changes(r.status_change, c.activity, viewers(c)))


_FORM_OK = f"""(COALESCE({strip_sql("title")} <> '', false) AND COALESCE(regexp_full_match({strip_sql("venue_id")}, '[0-9]+'), false)
               AND COALESCE(regexp_full_match({strip_sql("max_capacity")}, '[0-9]+'), false))"""
_FORM_VALUES = f"""{strip_sql("title")} AS _title, nullif({strip_sql("category")}, '') AS _category,
       TRY_CAST({strip_sql("venue_id")} AS BIGINT) AS _venue, TRY_CAST({strip_sql("max_capacity")} AS INTEGER) AS _cap,
       nullif({strip_sql("description")}, '') AS _desc"""
_DB_OK = """(v.venue_id IS NOT NULL AND COALESCE(f.end_time > f.start_time AND f.signup_deadline <= f.start_time AND f._cap > 0, false)
           AND length(f._title) <= 200 AND COALESCE(length(f._category) <= 50, true))"""


@query("activity_update", f"""
WITH f AS (SELECT *, {_FORM_VALUES} FROM activity_form_request WHERE {_FORM_OK}),
ok AS (SELECT f.* FROM f JOIN activity a ON a.activity_id = f.activity_id JOIN ({_USER_DIM}) d ON d.user_id = f.actor_user_id
       LEFT JOIN venue v ON v.venue_id = f._venue
       WHERE (d.role = 'admin' OR (d.role = 'club' AND d.club_id = a.club_id)) AND {_DB_OK}),
last AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts DESC, request_id DESC) AS rn FROM ok)
SELECT activity_id, request_id, _title AS title, _category AS category, _venue AS venue_id, start_time, end_time,
       signup_deadline, _cap AS max_capacity, _desc AS description
FROM last WHERE rn = 1""")
def activity_update(c, r):
    """STA-2: the last valid update of each activity."""
    return S.activity_update(r.activity_form, c.activity, c.venue, viewers(c))


@query("ingest_activity", f"""
WITH f AS (SELECT q.*, {_FORM_VALUES}, d.role AS _role,
                  CASE WHEN d.role = 'admin' THEN TRY_CAST({strip_sql("q.club_id")} AS BIGINT) ELSE d.club_id END AS _club
           FROM activity_form_request q LEFT JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id),
x AS (SELECT f.*, CASE
        WHEN NOT COALESCE(f._role IN ('admin', 'club'), false) THEN 'forbidden'
        WHEN NOT {_FORM_OK.replace("trim(", "trim(f.")} THEN 'invalid_form'
        WHEN f._role = 'admin' AND NOT COALESCE(regexp_full_match({strip_sql("f.club_id")}, '[0-9]+'), false) THEN 'club_required'
        WHEN f._club IS NULL OR c.club_id IS NULL OR NOT {_DB_OK} THEN 'db_error'
        ELSE 'created' END AS outcome
      FROM f LEFT JOIN venue v ON v.venue_id = f._venue LEFT JOIN club c ON c.club_id = f._club)
SELECT request_id, outcome,
       CASE WHEN outcome = 'created' THEN (SELECT max(activity_id) FROM activity)
            + row_number() OVER (PARTITION BY outcome = 'created' ORDER BY ts, request_id) END AS activity_id,
       CASE WHEN outcome = 'created' THEN _club END AS club_id, CASE WHEN outcome = 'created' THEN _venue END AS venue_id,
       CASE WHEN outcome = 'created' THEN _title END AS title, CASE WHEN outcome = 'created' THEN _category END AS category,
       CASE WHEN outcome = 'created' THEN start_time END AS start_time, CASE WHEN outcome = 'created' THEN end_time END AS end_time,
       CASE WHEN outcome = 'created' THEN signup_deadline END AS signup_deadline,
       CASE WHEN outcome = 'created' THEN _cap END AS max_capacity, CASE WHEN outcome = 'created' THEN _desc END AS description
FROM x""")
def ingest_activity(c, r):
    """DQ-5: activity creation forms validated and inserted as drafts."""
    return S.ingest_activity(r.activity_form, c.activity, c.venue, c.club, viewers(c))


# -- BOR / TRD -------------------------------------------------------------------------------

from quadflow.operators import lending as B  # noqa: E402
from quadflow.operators import trade as T  # noqa: E402
from quadflow.sources.domain import EPOCH, plus  # noqa: E402

_UID = ("COALESCE(order_uid, 'BOR-' || strftime(apply_time, '%Y%m%d') || '-' || "
        "lpad(CAST(order_id AS VARCHAR), CAST(greatest(6, length(CAST(order_id AS VARCHAR))) AS INTEGER), '0'))")


@query("stock_reserve", f"""
WITH RECURSIVE o AS (SELECT order_id, {_UID} AS order_uid, applicant_user_id FROM borrow_order),
d AS ({_USER_DIM}),
x AS (
  SELECT q.*, CASE WHEN COALESCE(regexp_full_match({strip_sql("q.order_ref")}, '[0-9]+'), false) THEN o1.order_id ELSE o2.order_id END AS oid,
         CASE WHEN COALESCE(regexp_full_match({strip_sql("q.order_ref")}, '[0-9]+'), false) THEN o1.applicant_user_id ELSE o2.applicant_user_id END AS applicant,
         d.role, r.available_qty, r.resource_id IS NOT NULL AS has_res
  FROM borrow_request q
  LEFT JOIN o o1 ON o1.order_id = TRY_CAST({strip_sql("q.order_ref")} AS BIGINT)
  LEFT JOIN o o2 ON lower(strip_accents(o2.order_uid)) = lower(strip_accents({strip_sql("q.order_ref")}))
  LEFT JOIN d ON d.user_id = q.actor_user_id
  LEFT JOIN resource_item r ON r.resource_id = q.resource_id),
y AS (SELECT *, CASE
        WHEN NOT COALESCE(role IN ('admin', 'club'), false) THEN 'forbidden'
        WHEN NOT (COALESCE({strip_sql("order_ref")} <> '', false) AND resource_id IS NOT NULL AND resource_id >= 0
                  AND borrow_qty IS NOT NULL AND borrow_qty >= 0) THEN 'invalid_form'
        WHEN oid IS NULL THEN 'order_not_found'
        WHEN role <> 'admin' AND applicant <> actor_user_id THEN 'forbidden'
        WHEN NOT has_res THEN 'resource_not_found'
        WHEN borrow_qty = 0 THEN 'db_error' END AS reason FROM x),
c AS (SELECT request_id, resource_id, borrow_qty, available_qty,
             row_number() OVER (PARTITION BY resource_id ORDER BY ts, request_id) AS rn FROM y WHERE reason IS NULL),
f AS (
  SELECT resource_id, rn, request_id, borrow_qty <= available_qty AS accepted,
         CASE WHEN borrow_qty <= available_qty THEN available_qty - borrow_qty ELSE available_qty END AS left_after
  FROM c WHERE rn = 1
  UNION ALL
  SELECT c.resource_id, c.rn, c.request_id, c.borrow_qty <= f.left_after,
         CASE WHEN c.borrow_qty <= f.left_after THEN f.left_after - c.borrow_qty ELSE f.left_after END
  FROM f JOIN c ON c.resource_id = f.resource_id AND c.rn = f.rn + 1)
SELECT y.request_id, y.ts, y.oid AS order_id, y.resource_id, y.borrow_qty,
       COALESCE(y.reason, CASE WHEN f.accepted THEN 'accepted' ELSE 'insufficient_stock' END) AS outcome,
       CAST(f.left_after AS INTEGER) AS left_after
FROM y LEFT JOIN f ON f.request_id = y.request_id""")
def stock_reserve(c, r):
    """BOR-2 / FOLD-2: every line-item reservation, greedy per resource."""
    return B.reserve_stock(r.borrow, c.borrow_order, c.resource_item, viewers(c))


_RETURN_SQL = f"""
WITH RECURSIVE x AS (
  SELECT q.*, bo.applicant_user_id, bo.order_status, bo.order_id IS NOT NULL AS has_order, d.role,
         EXISTS (SELECT 1 FROM borrow_detail bd WHERE bd.order_id = q.order_id) AS has_det
  FROM return_request q LEFT JOIN borrow_order bo ON bo.order_id = q.order_id
  LEFT JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id),
y AS (SELECT *, CASE WHEN NOT COALESCE(role IN ('admin', 'club'), false) THEN 'forbidden'
                     WHEN NOT has_order THEN 'order_not_found'
                     WHEN role <> 'admin' AND applicant_user_id <> actor_user_id THEN 'forbidden'
                     WHEN order_status NOT IN ('borrowed', 'overdue') THEN 'not_returnable'
                     WHEN NOT has_det THEN 'no_detail' END AS reason FROM x),
fst AS (SELECT order_id, min((ts, request_id)) AS k FROM y WHERE reason IS NULL GROUP BY order_id),
need AS (SELECT fst.order_id, bd.resource_id, sum(bd.borrow_qty - bd.returned_qty) AS qty FROM fst JOIN borrow_detail bd ON bd.order_id = fst.order_id
         WHERE bd.borrow_qty > bd.returned_qty GROUP BY fst.order_id, bd.resource_id),
tight AS (SELECT n.resource_id, any_value(r.total_qty - r.available_qty) AS room FROM need n JOIN resource_item r ON r.resource_id = n.resource_id
          GROUP BY n.resource_id HAVING sum(n.qty) > any_value(r.total_qty - r.available_qty)),
turn AS (SELECT fst.order_id, row_number() OVER (ORDER BY k) AS rn FROM fst
         WHERE order_id IN (SELECT n.order_id FROM need n JOIN tight t ON t.resource_id = n.resource_id)),
asked AS (SELECT turn.rn, any_value(turn.order_id) AS order_id, list(CAST(COALESCE(n.qty, 0) AS BIGINT) ORDER BY t.resource_id) AS qty
          FROM turn JOIN tight t ON true LEFT JOIN need n ON n.order_id = turn.order_id AND n.resource_id = t.resource_id GROUP BY turn.rn),
serial(rn, room, ok) AS (
  SELECT 0::BIGINT, (SELECT list(CAST(room AS BIGINT) ORDER BY resource_id) FROM tight), false
  UNION ALL
  SELECT s.rn, CASE WHEN s.ok THEN s.after ELSE s.room END, s.ok
  FROM (SELECT a.rn, w.room, list_transform(list_zip(w.room, a.qty), lambda p: p[1] - p[2]) AS after,
               len(list_filter(list_zip(w.room, a.qty), lambda p: p[2] > 0 AND p[1] < p[2])) = 0 AS ok
        FROM serial w JOIN asked a ON a.rn = w.rn + 1) s),
over AS (SELECT a.order_id FROM serial w JOIN asked a ON a.rn = w.rn WHERE NOT w.ok),
z AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason
                     WHEN order_id IN (SELECT order_id FROM over) THEN 'db_error'
                     WHEN row_number() OVER (PARTITION BY order_id, reason IS NULL ORDER BY ts, request_id) > 1 THEN 'not_returnable'
                     ELSE 'returned' END AS outcome FROM y),
back AS (SELECT bd.resource_id, sum(bd.borrow_qty - bd.returned_qty) AS qty FROM borrow_detail bd
         JOIN z ON z.order_id = bd.order_id AND z.outcome = 'returned'
         WHERE bd.borrow_qty - bd.returned_qty > 0 GROUP BY bd.resource_id)"""


def _returns(c, r):
    return B.return_orders(r.return_, c.borrow_order, c.borrow_detail, c.resource_item, viewers(c))


@query("borrow_return", _RETURN_SQL + """
SELECT r.resource_id, CAST(r.available_qty + b.qty AS INTEGER) AS available_qty
FROM resource_item r JOIN back b ON b.resource_id = r.resource_id""")
def borrow_return(c, r):
    """BOR-3: stock of every resource the returns give back to."""
    _, _, _, stock = _returns(c, r)
    return stock.filter("_changed").select("resource_id", "available_qty")


@query("return_outcomes", _RETURN_SQL + "\nSELECT request_id, order_id, outcome, ts FROM z")
def return_outcomes(c, r):
    """BOR-3 per request."""
    outcomes, _, _, _ = _returns(c, r)
    return outcomes


def _borrow_create_requests(c):
    k = F.col("o_orderkey")
    ts = plus(ts_lit(EPOCH), "HOUR", k % 720)
    actor = F.when(k % 5 == 0, F.lit(0).cast("long")).otherwise((k % c.n_club) * 10 + 1)
    ref = F.when(k % 29 == 0, F.concat(F.lit("A"), k.cast("string"))).otherwise(((k * 3) % (c.n_activity + 7)).cast("string"))
    status = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, "lost").when(k % 7 == 2, "pending")
              .when(k % 7 == 3, " borrowed\t").otherwise("approved"))
    due = F.when(k % 31 != 0, plus(ts, "DAY", 7))
    return c.raw("orders").select(k.alias("request_id"), ts.alias("ts"), actor.alias("actor_user_id"),
                                  F.when(k % 37 == 0, F.concat(F.lit("\t"), ref, F.lit("\n"))).otherwise(ref).alias("activity_ref"),
                                  due.alias("expected_return_time"),
                                  status.alias("order_status"))


_E2 = f"TIMESTAMP '{EPOCH}'"
_CREATE_SQL = f"""
WITH q AS (
  SELECT o_orderkey AS request_id, {_E2} + to_hours(CAST(o_orderkey % 720 AS BIGINT)) AS ts,
         CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE (o_orderkey % (SELECT count(*) FROM supplier)) * 10 + 1 END AS actor_user_id,
         CASE WHEN o_orderkey % 37 = 0 THEN chr(9) ELSE '' END || CASE WHEN o_orderkey % 29 = 0 THEN 'A' || CAST(o_orderkey AS VARCHAR)
              ELSE CAST((o_orderkey * 3) % ((SELECT count(*) FROM orders) + 7) AS VARCHAR) END
           || CASE WHEN o_orderkey % 37 = 0 THEN chr(10) ELSE '' END AS activity_ref,
         CASE WHEN o_orderkey % 31 <> 0 THEN {_E2} + to_hours(CAST(o_orderkey % 720 AS BIGINT)) + to_days(7) END AS expected_return_time,
         CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'lost' WHEN 2 THEN 'pending' WHEN 3 THEN ' borrowed' || chr(9) ELSE 'approved' END AS order_status
  FROM orders),
x AS (SELECT q.*, COALESCE({strip_sql("q.order_status")}, 'approved') AS st, TRY_CAST({strip_sql("q.activity_ref")} AS BIGINT) AS act, d.role,
             a.activity_id IS NOT NULL AS has_act
      FROM q LEFT JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id
      LEFT JOIN activity a ON a.activity_id = TRY_CAST({strip_sql("q.activity_ref")} AS BIGINT)),
y AS (SELECT *, CASE WHEN NOT COALESCE(role IN ('admin', 'club'), false) THEN 'forbidden'
                     WHEN NOT COALESCE(regexp_full_match({strip_sql("activity_ref")}, '[0-9]+'), false)
                          OR st NOT IN ('pending', 'approved', 'borrowed', 'returned', 'overdue') THEN 'invalid_form'
                     WHEN NOT has_act OR expected_return_time IS NULL THEN 'db_error' ELSE 'created' END AS outcome FROM x),
z AS (SELECT *, CASE WHEN outcome = 'created' THEN (SELECT max(order_id) FROM borrow_order)
                     + row_number() OVER (PARTITION BY outcome = 'created' ORDER BY ts, request_id) END AS oid FROM y)
SELECT request_id, outcome, oid AS order_id,
       CASE WHEN outcome = 'created' THEN 'BOR-' || strftime(ts, '%Y%m%d') || '-' ||
            lpad(CAST(oid AS VARCHAR), CAST(greatest(6, length(CAST(oid AS VARCHAR))) AS INTEGER), '0') END AS order_uid,
       CASE WHEN outcome = 'created' THEN act END AS activity_id,
       CASE WHEN outcome = 'created' THEN actor_user_id END AS applicant_user_id,
       CASE WHEN outcome = 'created' THEN ts END AS apply_time,
       CASE WHEN outcome = 'created' THEN expected_return_time END AS expected_return_time,
       CASE WHEN outcome = 'created' THEN st END AS order_status
FROM z"""


def _created_orders(c, r):
    return B.ingest_borrow_orders(_borrow_create_requests(c), c.borrow_order, c.activity, viewers(c))


@query("ingest_borrow_order", _CREATE_SQL)
def ingest_borrow_order(c, r):
    """DQ-9: borrow-order creation forms."""
    return _created_orders(c, r)


@query("order_uid", f"SELECT order_id, order_uid FROM ({_CREATE_SQL}) t WHERE outcome = 'created'")
def order_uid(c, r):
    """BOR-1: uids of the orders the creation forms insert."""
    return _created_orders(c, r).filter(F.col("outcome") == "created").select("order_id", "order_uid")


@query("trade_admission", """
WITH x AS (SELECT q.request_id, q.ts, q.product_id, q.actor_user_id, p.seller_user_id, p.status, p.product_id IS NOT NULL AS has_p
           FROM trade_buy_request q LEFT JOIN product p ON p.product_id = q.product_id),
w AS (SELECT product_id, min(ts) AS wts FROM x WHERE has_p AND status = 'on_sale' AND actor_user_id <> seller_user_id GROUP BY product_id),
win AS (SELECT w.product_id, w.wts, min(x.request_id) AS wid FROM w JOIN x ON x.product_id = w.product_id AND x.ts = w.wts
        AND x.actor_user_id <> x.seller_user_id GROUP BY w.product_id, w.wts),
y AS (SELECT x.*, CASE WHEN NOT has_p THEN 'missing'
                       WHEN status <> 'on_sale' OR (win.wts IS NOT NULL AND (x.ts > win.wts OR (x.ts = win.wts AND x.request_id > win.wid)))
                            THEN 'not_on_sale'
                       WHEN actor_user_id = seller_user_id THEN 'own_product' ELSE 'accepted' END AS outcome
      FROM x LEFT JOIN win ON win.product_id = x.product_id)
SELECT request_id, product_id, outcome,
       CASE WHEN outcome = 'accepted' THEN (SELECT max(order_id) FROM trade_order)
            + row_number() OVER (PARTITION BY outcome = 'accepted' ORDER BY ts, request_id) END AS order_id,
       actor_user_id AS buyer_user_id, seller_user_id
FROM y""")
def trade_admission(c, r):
    """TRD-1: every buy attempt in the purchase log."""
    return T.admit_trades(r.trade_buy, c.product, c.trade_order)


_REOPENED_SQL = """
WITH RECURSIVE lg AS (
  SELECT q.request_id, q.ts, q.product_id, q.actor_user_id, 0 AS change, CAST(NULL AS VARCHAR) AS new_status FROM trade_buy_request q
  UNION ALL
  SELECT q.request_id, q.ts, o.product_id, q.actor_user_id, 1, q.order_status
  FROM trade_status_request q JOIN trade_order o ON o.order_id = q.order_id
  WHERE q.order_status IN ('cancelled', 'completed') AND q.actor_user_id IN (o.buyer_user_id, o.seller_user_id)),
x AS (SELECT lg.*, p.status AS init_status, p.seller_user_id,
             row_number() OVER (PARTITION BY lg.product_id ORDER BY lg.ts, lg.request_id, lg.change) AS rn
      FROM lg LEFT JOIN product p ON p.product_id = lg.product_id),
walk AS (
  SELECT product_id, CAST(0 AS BIGINT) AS rn, any_value(init_status) AS status, CAST(NULL AS VARCHAR) AS outcome FROM x GROUP BY product_id
  UNION ALL
  SELECT t.product_id, t.rn, CASE WHEN t.oc = 'accepted' THEN 'locked' WHEN t.oc = 'cancelled' THEN 'on_sale'
                                  WHEN t.oc = 'completed' THEN 'sold' ELSE t.cur END, t.oc
  FROM (SELECT x.product_id, x.rn, w.status AS cur,
               CASE WHEN x.change = 1 THEN x.new_status WHEN w.status IS NULL THEN 'missing' WHEN w.status <> 'on_sale' THEN 'not_on_sale'
                    WHEN x.actor_user_id = x.seller_user_id THEN 'own_product' ELSE 'accepted' END AS oc
        FROM walk w JOIN x ON x.product_id = w.product_id AND x.rn = w.rn + 1) t)
SELECT x.request_id, x.product_id, w.outcome,
       CASE WHEN w.outcome = 'accepted' THEN (SELECT max(order_id) FROM trade_order)
            + row_number() OVER (PARTITION BY w.outcome = 'accepted' ORDER BY x.ts, x.request_id) END AS order_id,
       x.actor_user_id AS buyer_user_id, x.seller_user_id
FROM walk w JOIN x ON x.product_id = w.product_id AND x.rn = w.rn WHERE x.change = 0"""


@query("trade_admission_reopened", _REOPENED_SQL)
def trade_admission_reopened(c, r):
    """TRD-1 with the status log of the same time: a product that a cancel puts
    on sale again is sold again (the oracle replays every product serially)."""
    return T.admit_trades(r.trade_buy, c.product, c.trade_order, r.trade_status)


@query("trade_status", """
WITH ok AS (SELECT q.*, o.finish_time AS fin FROM trade_status_request q JOIN trade_order o ON o.order_id = q.order_id
            WHERE q.order_status IN ('created', 'cancelled', 'completed')
              AND (q.actor_user_id = o.buyer_user_id OR q.actor_user_id = o.seller_user_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, request_id DESC) AS rn FROM ok)
SELECT l.order_id, l.order_status,
       COALESCE((SELECT max(ts) FROM ok WHERE ok.order_id = l.order_id AND ok.order_status = 'completed'), l.fin) AS finish_time
FROM last l WHERE rn = 1""")
def trade_status(c, r):
    """TRD-2: orders after every accepted status change."""
    orders, _ = T.apply_trade_status(r.trade_status, c.trade_order, c.product)
    return orders


@query("trade_status_products", """
WITH ok AS (SELECT q.*, o.product_id FROM trade_status_request q JOIN trade_order o ON o.order_id = q.order_id
            WHERE q.order_status IN ('cancelled', 'completed')
              AND (q.actor_user_id = o.buyer_user_id OR q.actor_user_id = o.seller_user_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, request_id DESC) AS rn FROM ok)
SELECT product_id, CASE WHEN order_status = 'cancelled' THEN 'on_sale' ELSE 'sold' END AS status FROM last WHERE rn = 1""")
def trade_status_products(c, r):
    """TRD-2: product states the status changes leave behind."""
    _, products = T.apply_trade_status(r.trade_status, c.trade_order, c.product)
    return products


def trade_log_requests(c, r):
    """Purchase events as buys plus, per purchase, a follow-up status change
    by the same user ``value`` minutes later that refers to that buy."""
    e = c.raw("events").filter(F.col("event_type") == "purchase")
    product = _target(F.col("event_id"), c.n_resource)
    status = F.when(F.col("event_id") % 3 == 0, "cancelled").when(F.col("event_id") % 3 == 1, "completed") \
        .otherwise("created")
    buys = e.select((F.col("event_id") * 2).alias("request_id"), "ts", product.alias("product_id"),
                    F.lit("buy").alias("kind"), F.col("user_id").alias("actor_user_id"),
                    F.lit(None).cast("long").alias("order_ref"), F.lit(None).cast("string").alias("new_status"))
    changes = e.select((F.col("event_id") * 2 + 1).alias("request_id"),
                       plus(F.col("ts"), "MINUTE", F.floor(F.col("value")).cast("int")).alias("ts"),
                       product.alias("product_id"), F.lit("status").alias("kind"),
                       F.col("user_id").alias("actor_user_id"), (F.col("event_id") * 2).alias("order_ref"),
                       status.alias("new_status"))
    return buys.unionByName(changes)


_TRADE_LOG_SQL = """
WITH RECURSIVE lg AS (
  SELECT event_id * 2 AS request_id, ts, @TARGET@ AS product_id, 'buy' AS kind, user_id AS actor_user_id,
         CAST(NULL AS BIGINT) AS order_ref, CAST(NULL AS VARCHAR) AS new_status
  FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT event_id * 2 + 1, ts + to_minutes(CAST(floor(value) AS BIGINT)), @TARGET@, 'status', user_id, event_id * 2,
         CASE event_id % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' ELSE 'created' END
  FROM events WHERE event_type = 'purchase'),
x AS (SELECT lg.*, p.status AS init_status, p.seller_user_id AS seller,
             row_number() OVER (PARTITION BY lg.product_id ORDER BY lg.ts, lg.request_id) AS rn
      FROM lg LEFT JOIN product p ON p.product_id = lg.product_id),
walk(product_id, rn, request_id, status, ids, buyers, outcome) AS (
  SELECT product_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), any_value(init_status), CAST([] AS BIGINT[]),
         CAST([] AS BIGINT[]), CAST(NULL AS VARCHAR)
  FROM x GROUP BY product_id
  UNION ALL
  SELECT t.product_id, t.rn, t.request_id,
         CASE WHEN t.oc = 'accepted' THEN 'locked'
              WHEN t.oc = 'applied' AND t.new_status = 'cancelled' THEN 'on_sale'
              WHEN t.oc = 'applied' AND t.new_status = 'completed' THEN 'sold' ELSE t.cur END,
         CASE WHEN t.oc = 'accepted' THEN list_append(t.ids, t.request_id) ELSE t.ids END,
         CASE WHEN t.oc = 'accepted' THEN list_append(t.buyers, t.actor_user_id) ELSE t.buyers END,
         t.oc
  FROM (SELECT s.*,
               CASE WHEN s.kind = 'buy' THEN
                      CASE WHEN s.cur IS NULL THEN 'missing' WHEN s.cur <> 'on_sale' THEN 'not_on_sale'
                           WHEN s.actor_user_id = s.seller THEN 'own_product' ELSE 'accepted' END
                    ELSE
                      CASE WHEN s.new_status NOT IN ('created', 'cancelled', 'completed') THEN 'invalid_status'
                           WHEN s.pos = 0 THEN 'order_not_found'
                           WHEN s.actor_user_id <> s.buyers[s.pos] AND s.actor_user_id IS DISTINCT FROM s.seller THEN 'forbidden'
                           ELSE 'applied' END
               END AS oc
        FROM (SELECT x.*, w.status AS cur, w.ids, w.buyers, COALESCE(list_position(w.ids, x.order_ref), 0) AS pos
              FROM walk w JOIN x ON x.product_id = w.product_id AND x.rn = w.rn + 1) s) t)
SELECT w.request_id, x.kind, w.product_id, w.outcome, w.status AS product_status
FROM walk w JOIN x ON x.product_id = w.product_id AND x.rn = w.rn
WHERE w.rn >= 1"""


@query("trade_log", _TRADE_LOG_SQL.replace("@TARGET@", target_sql("(SELECT count(*) FROM part)")))
def trade_log(c, r):
    """TRD-3 / FOLD-3: buys and status changes replayed per product (the oracle is a recursive per-product replay in SQL)."""
    return T.replay_trade_log(trade_log_requests(c, r), c.product).select(
        "request_id", "kind", "product_id", "outcome", "product_status")


# -- streaming forms --------------------------------------------------------------------------

@query("stream_like_toggle", _LIKE_SQL)
def stream_like_toggle(c, r):
    """STR-4: the like table after the click stream is consumed (availableNow);
    equal to the batch LIK-1 result (see tests for split replays)."""
    from quadflow.streaming import jobs
    ckpt, out = jobs.scratch_paths(c.spark, "likes")
    jobs.like_stream(c.spark, c, jobs.event_stream(c.spark, c.root, glob="events.parquet"), out, ckpt).awaitTermination()
    return jobs.likes_after(c.spark, c, out)


@query("stream_registrations", _REG_SQL + "\nSELECT * FROM out")
def stream_registrations(c, r):
    """STR-2: sign-up outcomes from the admission stream (availableNow)."""
    from quadflow.streaming import jobs
    ckpt, out = jobs.scratch_paths(c.spark, "admission")
    jobs.admission_stream(c.spark, c, jobs.event_stream(c.spark, c.root, glob="events.parquet"), out, ckpt).awaitTermination()
    return jobs.stored(c.spark, out, "registration_outcome", jobs.OUTCOMES)


def _status_steps(c):
    from quadflow.streaming import jobs
    ckpt, out = jobs.scratch_paths(c.spark, "audit")
    jobs.audit_stream(c.spark, c, jobs.event_stream(c.spark, c.root, glob="events.parquet"), out, ckpt).awaitTermination()
    return jobs.status_steps(c.spark, out)


@query("stream_status_audit", _STATUS_SQL)
def stream_status_audit(c, r):
    """STR-3: audit rows from the status-change stream (availableNow)."""
    return S.status_audit(_status_steps(c))


_ACTIVITY_AFTER_SQL = _STATUS_SQL.split("\nSELECT 'activity' AS biz_type")[0] + """
SELECT a.* REPLACE (COALESCE(l.status, a.status) AS status)
FROM activity a LEFT JOIN (SELECT activity_id, max_by(status, (ts, request_id)) AS status FROM st GROUP BY activity_id) l
  ON l.activity_id = a.activity_id"""


@query("activity_after_status", _ACTIVITY_AFTER_SQL)
def activity_after_status(c, r):
    """STA-1: the activity table after every status change in the log."""
    return S.activities_after(c.activity, S.status_changes(r.status_change, c.activity, viewers(c)))


# -- second-table effects and their audit rows -------------------------------------------------

@query("checkin_registrations", f"""
WITH ok AS (
  SELECT q.* FROM checkin_request q
  JOIN activity_registration ar ON ar.reg_id = q.reg_id
  JOIN activity a ON a.activity_id = ar.activity_id
  JOIN ({_USER_DIM}) d ON d.user_id = q.actor_user_id
  WHERE (d.role = 'admin' OR (d.role = 'club' AND d.club_id = a.club_id)) AND ar.reg_status = 'confirmed')
SELECT reg_id, status AS checkin_status
FROM (SELECT *, row_number() OVER (PARTITION BY reg_id ORDER BY ts DESC, request_id DESC) AS rn FROM ok) t WHERE rn = 1""")
def checkin_registrations(c, r):
    """CHK-1: the check-in status every marked registration ends with."""
    return A.checkin_registration_updates(r.checkin, c.activity_registration, c.activity, viewers(c))


_AUDIT_JSON = ("CAST(json_object('order_status', {s}, 'actual_return_time', strftime({t}, '%Y-%m-%d %H:%M:%S')) "
               "AS VARCHAR)")


@query("audit_sweep", f"""
SELECT 'borrow_order' AS biz_type, order_id AS biz_id, 'status_change' AS action, applicant_user_id AS operator_id,
       {_AUDIT_JSON.format(s="order_status", t="actual_return_time")} AS old_data,
       {_AUDIT_JSON.format(s="'overdue'", t="actual_return_time")} AS new_data, {_ASOF} AS op_time
FROM borrow_order WHERE order_status = 'borrowed' AND expected_return_time < {_ASOF}""")
def audit_sweep(c, r):
    """AUD-1 for the orders one overdue sweep marks."""
    orders, _ = S.overdue_sweep(c.borrow_order, c.penalty, c.student, ts_lit(AS_OF))
    return S.audit_orders(c.borrow_order, orders, ts_lit(AS_OF))


@query("audit_returns", _RETURN_SQL + f"""
SELECT 'borrow_order' AS biz_type, bo.order_id AS biz_id, 'status_change' AS action, bo.applicant_user_id AS operator_id,
       {_AUDIT_JSON.format(s="bo.order_status", t="bo.actual_return_time")} AS old_data,
       {_AUDIT_JSON.format(s="'returned'", t="z.ts")} AS new_data, z.ts AS op_time
FROM z JOIN borrow_order bo ON bo.order_id = z.order_id WHERE z.outcome = 'returned'""")
def audit_returns(c, r):
    """AUD-1 for the orders the return requests close (at each return's time)."""
    _, orders, _, _ = _returns(c, r)
    return S.audit_orders(c.borrow_order, orders, F.col("actual_return_time"))


def _reserved(c, r):
    outcomes = B.reserve_stock(r.borrow, c.borrow_order, c.resource_item, viewers(c))
    return B.after_reservations(outcomes, c.borrow_order, c.resource_item)


_RESERVE_HEAD, _RESERVE_TAIL = REGISTRY["stock_reserve"][1].split("\nSELECT y.request_id", 1)
_RESERVED = _RESERVE_HEAD + ",\nres AS (SELECT y.request_id" + _RESERVE_TAIL + ")"


@query("audit_reservations", _RESERVED + f"""
, first_ok AS (SELECT order_id, min(ts) AS changed_at FROM res WHERE outcome = 'accepted' GROUP BY order_id)
SELECT 'borrow_order' AS biz_type, bo.order_id AS biz_id, 'status_change' AS action, bo.applicant_user_id AS operator_id,
       {_AUDIT_JSON.format(s="bo.order_status", t="bo.actual_return_time")} AS old_data,
       {_AUDIT_JSON.format(s="'borrowed'", t="bo.actual_return_time")} AS new_data, f.changed_at AS op_time
FROM first_ok f JOIN borrow_order bo ON bo.order_id = f.order_id WHERE bo.order_status <> 'borrowed'""")
def audit_reservations(c, r):
    """AUD-1 for the orders reservations move to 'borrowed' (at the first
    accepted line of each)."""
    orders, _ = _reserved(c, r)
    return S.audit_orders(c.borrow_order, orders, F.col("_changed_at"))


@query("stock_after_reserve", _RESERVED + """
SELECT r.resource_id, CAST(r.available_qty - COALESCE(u.used, 0) AS INTEGER) AS available_qty
FROM resource_item r LEFT JOIN (SELECT resource_id, sum(borrow_qty) AS used FROM res WHERE outcome = 'accepted'
                                GROUP BY resource_id) u ON u.resource_id = r.resource_id""")
def stock_after_reserve(c, r):
    """BOR-2 state: stock of every resource after the accepted reservations."""
    _, stock = _reserved(c, r)
    return stock


@query("stream_sweep", f"""
WITH t AS (SELECT max(ts) AS as_of FROM events),
bo2 AS (SELECT order_id, activity_id, applicant_user_id,
               CASE WHEN order_status = 'borrowed' AND expected_return_time < (SELECT as_of FROM t) THEN 'overdue'
                    ELSE order_status END AS order_status FROM borrow_order),
todo AS (SELECT st.student_id, bo2.activity_id, bo2.order_id FROM bo2
         JOIN user_account ua ON ua.user_id = bo2.applicant_user_id JOIN student st ON st.user_id = ua.user_id
         WHERE bo2.order_status = 'overdue'
           AND NOT EXISTS (SELECT 1 FROM penalty p WHERE p.order_id = bo2.order_id AND p.penalty_type = 'overdue'))
SELECT (SELECT max(penalty_id) FROM penalty) + row_number() OVER (ORDER BY order_id, student_id) AS penalty_id,
       student_id, activity_id, order_id, 'overdue' AS penalty_type, '{S.SWEEP_REASON}' AS reason,
       CAST(0 AS DECIMAL(10,2)) AS amount, 'unpaid' AS status, (SELECT as_of FROM t) AS create_time
FROM todo""")
def stream_sweep(c, r):
    """STR-1: the overdue sweep at one tick of the schedule, the newest event
    time; the penalties it inserts."""
    return _swept(c, [c.raw("events").select(F.max("ts").alias("ts"))])


def _swept(c, schedule):
    """The penalties of a sweep stream whose ticks are files, one micro-batch each."""
    from quadflow.streaming import jobs
    ckpt, out = jobs.scratch_paths(c.spark, "sweep")
    for k, ticks in enumerate(schedule):
        ticks.coalesce(1).write.mode("append").parquet(f"{out}/ticks")
    clock = c.spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{out}/ticks")
    jobs.sweep_stream(c.spark, c, clock, out, ckpt, {"availableNow": True}).awaitTermination()
    return jobs.stored(c.spark, out, "penalty", jobs._schema(c.penalty))


@query("stream_sweep_schedule", f"""
WITH bounds AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS b FROM events),
tick AS (SELECT unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS t FROM bounds),
hit AS (SELECT bo.order_id, bo.activity_id, bo.applicant_user_id, min(tick.t) AS at
        FROM borrow_order bo JOIN tick ON bo.order_status = 'overdue' OR (bo.order_status = 'borrowed' AND bo.expected_return_time < tick.t)
        GROUP BY bo.order_id, bo.activity_id, bo.applicant_user_id)
SELECT (SELECT max(penalty_id) FROM penalty) + row_number() OVER (ORDER BY hit.at, hit.order_id, st.student_id) AS penalty_id,
       st.student_id, hit.activity_id, hit.order_id, 'overdue' AS penalty_type, '{S.SWEEP_REASON}' AS reason,
       CAST(0 AS DECIMAL(10,2)) AS amount, 'unpaid' AS status, hit.at AS create_time
FROM hit JOIN student st ON st.user_id = hit.applicant_user_id
WHERE hit.order_id NOT IN (SELECT order_id FROM penalty WHERE penalty_type = 'overdue' AND order_id IS NOT NULL)""")
def stream_sweep_schedule(c, r):
    """STR-1: the overdue sweep every 30 minutes of the event log's time span,
    in four micro-batches, with no event driving it; the penalties it inserts."""
    bounds = c.raw("events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"))
    ticks = bounds.select("a", "b", F.explode(F.expr("sequence(a, b, interval 30 minutes)")).alias("ts"))
    quarter = F.least(F.floor(4 * F.timestamp_diff("MINUTE", F.col("a"), F.col("ts")) / F.timestamp_diff("MINUTE", F.col("a"), F.col("b"))), F.lit(3))
    return _swept(c, [ticks.filter(quarter == k).select("ts") for k in range(4)])


@query("dq_audit_foreign_key", "SELECT 'audit_log' AS table_name, 'operator_id->user_account' AS foreign_key, biz_type, biz_id, "
       "operator_id AS value FROM (" + "\nUNION ALL\n".join(
           f"SELECT biz_type, biz_id, operator_id FROM ({REGISTRY[n][1]}) a_{i}"
           for i, n in enumerate(["audit_orders", "audit_sweep", "audit_returns", "audit_reservations"]))
       + ") a WHERE operator_id IS NOT NULL AND operator_id NOT IN (SELECT user_id FROM user_account)")
def dq_audit_foreign_key(c, r):
    """DQ-2 (28th key): audit rows whose operator is not a user, over every audit row the order transitions write."""
    rows = None
    for part in (audit_orders(c, r), audit_sweep(c, r), audit_returns(c, r), audit_reservations(c, r)):
        part = part.select("biz_type", "biz_id", "operator_id")
        rows = part if rows is None else rows.unionByName(part)
    from quadflow.operators import quality
    return quality.audit_key_violations(rows, c.user_account)
