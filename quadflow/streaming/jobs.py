"""Streaming forms of the transitions (STR-1..4).

* Likes and status changes (STR-4, STR-3) keep their state in Spark's state
  store: one small value per pair or activity, packed by bucket of them, so a
  micro-batch does work for the buckets that it touches. What they emit, a row per toggle or per audited
  change, goes to Spark's own file sink (exactly once).
* Sign-ups (STR-2) and the sweep (STR-1) apply the batch operator per
  micro-batch. What they add only ever grows (registrations, penalties, marks
  of overdue orders), so micro-batch ``b`` writes plain Parquet under
  ``batch=b``, reads what earlier batches wrote, and a retried batch rewrites
  its own folder.
* Order is ``(ts, request_id)`` inside a micro-batch and arrival across them, so
  a log replayed in any split equals one batch run.
* The sweep is driven by a clock: ``rate-micro-batch`` in production, or any
  schedule of ticks. It needs no event to fire.
"""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadflow.functions.ordering import numbered
from quadflow.operators import admission, settlement
from quadflow.operators.listings import user_dim
from quadflow.session import ensure_checkpoint_dir
from quadflow.sources.domain import Campus
from quadflow.sources.requests import Requests
from quadflow.sources.tables import read_if_written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
EVERY_MINUTES = 30  # cadence of the sweep


def event_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def clock(spark: SparkSession, start_millis: int, every_minutes: int = EVERY_MINUTES) -> DataFrame:
    """A tick (``ts``) per micro-batch, ``every_minutes`` apart, from the clock alone."""
    source = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1)
              .option("startTimestamp", start_millis).option("advanceMillisPerBatch", every_minutes * 60_000).load())
    return source.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"))


# -- native state: likes and status changes --------------------------------------------------

LIKE_CHANGES = "request_id long, ts timestamp_ntz, post_id long, user_id long, liked boolean"
STATUS_STEPS = "request_id long, ts timestamp_ntz, activity_id long, old_status string, new_status string"


BUCKETS = 1 << 12  # fixed: the state of a running stream is kept by bucket


def _by_key(rows, keys):
    """(rows in order, key of each row by number, first row of each key)."""
    import numpy as np
    rows = rows.sort_values([*keys, "ts", "request_id"], kind="stable")
    key = rows[keys].to_numpy()
    new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    return rows, np.cumsum(new) - 1, np.flatnonzero(new)


def _toggles(key, frames, state):
    """A bucket of (post, user) pairs: every toggle of the batch turns its
    pair's like over."""
    import numpy as np
    import pandas as pd
    keys = ["post_id", "_user", "_anonymous"]
    rows, pair, first = _by_key(pd.concat(list(frames)), keys)
    pairs = rows.iloc[first][keys]
    liked = rows["_e"].to_numpy()[first].astype(bool)
    before = pd.DataFrame({c: [] for c in keys})
    if state.exists:
        posts, users, marks = (np.frombuffer(b, t) for b, t in zip(state.get, (np.int64, np.int64, np.uint8)))
        before = pd.DataFrame({"post_id": posts, "_user": users, "_anonymous": marks >= 2, "_liked": marks % 2 == 1})
        found = pairs.merge(before, "left", keys)["_liked"].to_numpy()
        liked = np.where(pd.isna(found), liked, found).astype(bool)
    after = ((np.arange(len(rows)) - first[pair]) % 2 == 0) != liked[pair]
    now = pairs.assign(_liked=after[np.r_[first[1:], len(rows)] - 1])
    now = pd.concat([before, now]).drop_duplicates(keys, keep="last") if state.exists else now
    marks = now["_liked"].to_numpy().astype(np.uint8) + 2 * now["_anonymous"].to_numpy().astype(np.uint8)
    state.update((*(now[c].to_numpy().astype(np.int64).tobytes() for c in keys[:2]), marks.tobytes()))
    yield rows[["request_id", "ts", *keys]].assign(liked=after)


def _steps(key, frames, state):
    """A bucket of activities: every accepted change follows the status before it."""
    import numpy as np
    import pandas as pd
    rows, activity, first = _by_key(pd.concat(list(frames)), ["activity_id"])
    ids, new = rows["activity_id"].to_numpy()[first], rows["status"].to_numpy()
    old = np.r_[new[:1], new[:-1]]
    old[first] = rows["_current"].to_numpy()[first]
    now = dict(zip(ids.tolist(), new[np.r_[first[1:], len(rows)] - 1].tolist()))
    if state.exists:
        before = dict(zip(*state.get))
        old[first] = [before.get(i, s) for i, s in zip(ids.tolist(), old[first])]
        now = before | now
    state.update((list(now), list(now.values())))
    yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "ts": rows["ts"].to_numpy(), "activity_id": rows["activity_id"].to_numpy(),
                        "old_status": old, "new_status": new})


def _to_files(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def like_stream(spark: SparkSession, campus: Campus, events: DataFrame, out: str, checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
    """STR-4: a row per toggle with the pair's like after it, below ``out``.
    The state is one boolean per touched pair, packed by bucket of pairs, so
    that a task handles many pairs at a time; a pair's first toggle looks up
    the like table as it was when the stream began."""
    req = Requests(campus, events).like.select("request_id", "ts", "post_id", F.col("actor_user_id").alias("user_id"))
    have = campus.post_like.select("post_id", "user_id", F.lit(True).alias("_e"))
    rows = (req.join(campus.post.select("post_id"), "post_id", "left_semi").join(have, ["post_id", "user_id"], "left")
            .select("request_id", "ts", "post_id", F.coalesce("user_id", F.lit(0)).cast("long").alias("_user"), F.col("user_id").isNull().alias("_anonymous"),
                    F.coalesce("_e", F.lit(False)).alias("_e")))
    bucket = F.pmod(F.xxhash64("post_id", "_user"), F.lit(BUCKETS))
    changes = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _toggles, "request_id long, ts timestamp_ntz, post_id long, _user long, _anonymous boolean, liked boolean",
        "posts binary, users binary, marks binary", "append", "NoTimeout")
    return _to_files(changes.select("request_id", "ts", "post_id", F.when(~F.col("_anonymous"), F.col("_user")).alias("user_id"), "liked"),
                     out, checkpoint, trigger)


def likes_after(spark: SparkSession, campus: Campus, out: str) -> DataFrame:
    """The like table behind a like stream: untouched rows, and the last insert
    of each touched pair that ends liked, with auto-increment ids over all
    inserts in request order."""
    changes = read_if_written(spark, out, LIKE_CHANGES)
    if changes is None:
        return campus.post_like
    first = campus.post_like.select(F.max("like_id")).scalar()
    inserts = numbered(changes.filter("liked"), ["ts", "request_id"], "_n")
    last = changes.groupBy("post_id", "user_id").agg(F.max(F.struct("ts", "request_id", "liked")).alias("_l"))
    live = last.filter("_l.liked").select(F.col("_l.request_id").alias("request_id"))
    new = inserts.join(live, "request_id", "left_semi").select(
        (F.coalesce(first, F.lit(0)) + F.col("_n")).cast("long").alias("like_id"), "post_id", "user_id", F.col("ts").alias("create_time"))
    kept = campus.post_like.join(last.select("post_id", "user_id"), ["post_id", "user_id"], "left_anti")
    return kept.select(*new.columns).unionByName(new)


def audit_stream(spark: SparkSession, campus: Campus, events: DataFrame, out: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """STR-3: a row per accepted status change with the status before it, below
    ``out``. The state is the last status of each touched activity, by bucket."""
    ok = settlement.permitted_changes(Requests(campus, events).status_change, campus.activity,
                                      user_dim(campus.user_account, campus.student, campus.club))
    rows = ok.select("request_id", "ts", "activity_id", "status", "_current")
    bucket = F.pmod(F.xxhash64("activity_id"), F.lit(BUCKETS))
    steps = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_steps, STATUS_STEPS, "activities array<long>, statuses array<string>", "append", "NoTimeout")
    return _to_files(steps, out, checkpoint, trigger)


def status_steps(spark: SparkSession, out: str) -> DataFrame:
    """What a status-change stream has stored so far."""
    steps = read_if_written(spark, out, STATUS_STEPS)
    return spark.createDataFrame([], STATUS_STEPS) if steps is None else steps


# -- batch operators per micro-batch -----------------------------------------------------------

def _run(stream: DataFrame, fn, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _put(rows: DataFrame, out: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def stored(spark: SparkSession, out: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows that the micro-batches (those before ``before``) have stored."""
    rows = read_if_written(spark, f"{out}/{name}", schema + ", batch int")
    if rows is None:
        return spark.createDataFrame([], schema)
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


OUTCOMES = "request_id long, activity_id long, student_id long, ts timestamp_ntz, outcome string, queue_no int, reg_id long"


def admission_stream(spark: SparkSession, campus: Campus, events: DataFrame, out: str, checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """STR-2: REG-1 per micro-batch against the registrations so far; the
    outcomes are stored, and the admitted rows follow from them."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        before = stored(spark, out, "registration_outcome", OUTCOMES, batch_id)
        regs = admission.registrations_after(campus.activity_registration, before)
        outcomes = admission.admit_registrations(Requests(campus, batch).registration, campus.activity, campus.student, regs)
        _put(outcomes, out, "registration_outcome", batch_id)
    return _run(events, apply, checkpoint, trigger or {"availableNow": True})


def sweep_stream(spark: SparkSession, campus: Campus, ticks: DataFrame, out: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """STR-1: the overdue sweep, fired by the clock. ``ticks`` is a stream of
    times (``ts``), one micro-batch per tick in production, several after an
    outage: every order is then marked, and its penalty written, at the first
    tick after it was due. New penalties and marks are stored per batch."""
    penalties, marks = _schema(campus.penalty), "order_id long"

    def apply(batch: DataFrame, batch_id: int) -> None:
        times = [r[0] for r in batch.filter("ts is not null").select("ts").distinct().orderBy("ts").collect()]  # ticks of one trigger
        if not times:
            return
        done = stored(spark, out, "overdue", marks, batch_id).withColumn("_marked", F.lit(True))
        orders = campus.borrow_order.join(done, "order_id", "left").withColumn(
            "order_status", F.when(F.col("_marked"), "overdue").otherwise(F.col("order_status"))).drop("_marked")
        known = campus.penalty.unionByName(stored(spark, out, "penalty", penalties, batch_id))
        marked, new = settlement.sweep_ticks(orders, known, campus.student, times)
        _put(new, out, "penalty", batch_id)
        _put(marked, out, "overdue", batch_id)
    return _run(ticks, apply, checkpoint, trigger or {"processingTime": f"{EVERY_MINUTES} minutes"})


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Checkpoint and output folders for one run, inside the shared
    ``spark.checkpoint.dir``."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/checkpoint", f"{base}/out"
