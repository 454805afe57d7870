"""Equipment lending: order uids, stock reservation, returns."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.functions.ordering import PIECE, PLACE, pieces_for, scan_sums, sorted_pieces
from quadflow.functions.scalar import order_uid, strip
from quadflow.session import cut_lineage
from quadflow.sources.tables import add_column_if_missing


def backfill_order_uid(borrow_order: DataFrame) -> DataFrame:
    """SCH-1 / BOR-1: add ``order_uid`` to an older snapshot and fill every
    NULL with ``BOR-<apply day>-<id padded to 6>`` (never truncated)."""
    df = add_column_if_missing(borrow_order, "order_uid", T.StringType())
    return df.withColumn("order_uid", F.coalesce(F.col("order_uid"), order_uid(F.col("order_id"), F.col("apply_time"))))


# The per-partition kernels of this module run in Python workers; they are
# shipped by value so executors need no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _digits(c):
    return F.coalesce(strip(c).rlike(r"\A[0-9]+\z"), F.lit(False))


PIECE_ROWS = 200_000  # requests that one task walks
WINDOW = 4096  # requests looked at together


def _greedy_walk(qty, left: int):
    """Greedy skip-if-insufficient over one resource's requests (in order).

    Looks at a window at a time: what exceeds the stock is rejected for good
    (stock only falls), of the rest the longest prefix whose running total fits
    is accepted at once; the walk goes on behind the first that doesn't fit.
    Returns (accepted flags, stock after each, stock left)."""
    import numpy as np
    n = len(qty)
    ok = np.zeros(n, dtype=bool)
    after = np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        window = qty[i:i + WINDOW]
        fits = np.flatnonzero(window <= left)
        run = np.cumsum(window[fits])
        k = int(np.searchsorted(run, left, side="right"))
        done = len(window) if k == len(fits) else int(fits[k]) + 1
        ok[i + fits[:k]] = True
        after[i:i + done] = left - np.cumsum(np.where(ok[i:i + done], window[:done], 0))
        left = int(after[i + done - 1])
        i += done
    return ok, after, left


def _stock_steps(qty, top: int):
    """The walk from every stock 0..top at once, as a step table: (first stock
    of each step, what it loses). Stocks that have met are walked as one, and
    requests beyond the largest stock left are passed over."""
    import numpy as np
    place = np.arange(top + 1)
    now = np.arange(top + 1)
    i = 0
    while i < len(qty):
        hits = np.flatnonzero(qty[i:i + WINDOW] <= now[-1])
        if not len(hits):
            i += WINDOW
            continue
        i += int(hits[0])
        now = np.where(now >= qty[i], now - qty[i], now)
        now, met = np.unique(now, return_inverse=True)
        place = met[place]
        i += 1
    lost = np.arange(top + 1) - now[place]
    first = np.flatnonzero(np.r_[True, lost[1:] != lost[:-1]])
    return first, lost[first]


def _stretches(batch):
    """(resource, first row, end row) of a sorted piece."""
    import numpy as np
    res = batch.column("resource_id").to_numpy()
    cuts = np.r_[0, np.flatnonzero(res[1:] != res[:-1]) + 1, len(res)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(res[a]), int(a), int(b)


def _whole(batches):
    """A sorted piece as one record batch (None if empty); its rows are bounded."""
    import pyarrow as pa
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if batches else None


def _edge_tables(batches):
    """Kernel: step tables of the first and the last resource of a piece, the
    only ones that may lie in other pieces too."""
    import pyarrow as pa
    piece = _whole(batches)
    if piece is None:
        return
    stretches, rows = list(_stretches(piece)), []
    for side in sorted({0, len(stretches) - 1}):
        res, a, b = stretches[side]
        part = piece.slice(a, b - a)
        top = part.column("available_qty")[0].as_py()
        first, lost = _stock_steps(part.column("borrow_qty").to_numpy().astype("int64"), max(top, 0))
        rows.append((res, piece.column(PIECE)[0].as_py(), top, first.tolist(), lost.tolist()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                                     names=["resource_id", "piece", "top", "first", "lost"])


def _chain(table):
    """Reducer over one resource's step tables: its stock at the start of every
    piece but the first."""
    import numpy as np
    import pyarrow as pa
    rows, left, out = sorted(table.to_pylist(), key=lambda r: r["piece"]), None, []
    for row in rows:
        left = row["top"] if left is None else left
        if row is not rows[0]:
            out.append((row["resource_id"], row["piece"], left))
        if left >= 0:
            left -= row["lost"][int(np.searchsorted(row["first"], left, side="right")) - 1]
    return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate((("resource_id", pa.int64()), ("piece", pa.int32()), ("stock", pa.int64())))})


def _walk_pieces(starts):
    """Kernel: every piece from its known start stocks; rows come back with
    ``accepted`` and ``left_after``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        piece = _whole(batches)
        if piece is None:
            return
        number = piece.column(PIECE)[0].as_py()
        ok, after = np.zeros(piece.num_rows, bool), np.zeros(piece.num_rows, np.int64)
        qty = piece.column("borrow_qty").to_numpy().astype(np.int64)
        for res, a, b in _stretches(piece):
            stock = starts.value.get((res, number), piece.column("available_qty")[a].as_py())
            ok[a:b], after[a:b], _ = _greedy_walk(qty[a:b], stock)
        names = ["request_id", "ts", "order_id", "resource_id", "borrow_qty"]
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(ok), pa.array(after, pa.int64())],
                                         names=[*names, "accepted", "left_after"])

    return run


def reserve_stock(requests: DataFrame, borrow_order: DataFrame, resource_item: DataFrame,
                  viewers: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """BOR-2: add detail lines to borrow orders while stock lasts.

    Static checks first (form, order by id or uid, role and ownership,
    resource exists, positive quantity); then per resource, in request order,
    a request is accepted when the remaining stock covers it. A rejected
    request consumes nothing, so a later smaller one may still pass.

    FOLD-2 over many tasks: the log is sorted by (resource, ts, request_id)
    into pieces of about ``piece_rows``. Where a resource goes on in the next
    piece, its part is first walked from every possible stock at once (stock is
    bounded, so that is a short step table); the tables are chained per
    resource, and then all pieces are walked at once from known stocks. What is
    broadcast is one number per piece. Rows carry their columns through the
    walk, so nothing is joined back; only those that the checks leave open are
    dealt out, sorted and kept for it.
    """
    spark = requests.sparkSession
    orders = backfill_order_uid(borrow_order)
    # each row looks its order up once, by id or by uid; uids are ASCII, so the collation only ignores their case
    named = orders.select(F.explode(F.array(F.concat(F.lit("i"), F.col("order_id").cast("string")), F.concat(F.lit("u"), F.upper("order_uid")))).alias("_key"),
                          "order_id", F.col("applicant_user_id").alias("_applicant"))
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"))
    by_id = _digits(F.col("order_ref"))
    ref = strip("order_ref")
    key = F.when(by_id, F.concat(F.lit("i"), ref.try_cast("long").cast("string"))).otherwise(F.concat(F.lit("u"), F.upper(ref)))
    form_ok = (F.coalesce(ref != "", F.lit(False)) & F.col("resource_id").isNotNull()
               & (F.col("resource_id") >= 0) & F.col("borrow_qty").isNotNull() & (F.col("borrow_qty") >= 0))
    # what the joins move is no wider than needed: the texts end as a key and a flag
    forms = requests.select("request_id", "ts", "actor_user_id", "resource_id", "borrow_qty", key.alias("_key"), form_ok.alias("_form_ok"))
    x = forms.join(named, "_key", "left").join(actors, "actor_user_id", "left")
    early = (F.when(~F.coalesce(F.col("_role").isin("admin", "club"), F.lit(False)), "forbidden")
             .when(~F.col("_form_ok"), "invalid_form").when(F.col("order_id").isNull(), "order_not_found")
             .when((F.col("_role") != "admin") & (F.col("_applicant") != F.col("actor_user_id")), "forbidden"))
    x = x.select("request_id", "ts", "order_id", "resource_id", "borrow_qty", early.alias("_reason"))
    stock = resource_item.select("resource_id", F.col("available_qty").cast("long").alias("available_qty"), F.lit(True).alias("_has_res"))
    late = F.when(F.col("_has_res").isNull(), "resource_not_found").when(F.col("borrow_qty") == 0, "db_error")
    checked = x.filter("_reason is null").drop("_reason").join(stock, "resource_id", "left").withColumn("_reason", late)
    columns = ["request_id", "ts", "order_id", F.col("resource_id").cast("long").alias("resource_id"), "borrow_qty"]
    rows = checked.filter("_reason is null").select(*columns, "available_qty")
    order = ["resource_id", "ts", "request_id"]
    sorted_ = sorted_pieces(rows, order, order, pieces_for(requests, piece_rows))
    edges = sorted_.select("resource_id", "borrow_qty", "available_qty", PIECE).mapInArrow(
        _edge_tables, "resource_id long, piece int, top long, first array<long>, lost array<long>")
    chained = edges.groupBy("resource_id").applyInArrow(_chain, "resource_id long, piece int, stock long").collect()
    starts = spark.sparkContext.broadcast({(r["resource_id"], r["piece"]): r["stock"] for r in chained})
    fields = {f.name: f.dataType.simpleString() for f in sorted_.schema}
    kept = ["request_id", "ts", "order_id", "resource_id", "borrow_qty"]
    walked = sorted_.mapInArrow(_walk_pieces(starts), ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", accepted boolean, left_after long")
    out = walked.select(*kept, F.when(F.col("accepted"), "accepted").otherwise("insufficient_stock").alias("outcome"),
                        F.col("left_after").cast("int").alias("left_after"))
    # the checks refused these; a resource that is there twice counts for them as for the others
    for refused in (x.filter("_reason is not null").join(stock, "resource_id", "left"), checked.filter("_reason is not null")):
        out = out.unionByName(refused.select(*columns, F.col("_reason").alias("outcome"), F.lit(None).cast("int").alias("left_after")))
    return out


def _refused(needs: DataFrame, room: DataFrame) -> DataFrame:
    """Orders refused by ordered all-or-nothing admission: ``needs`` (order_id,
    ts, request_id, resource_id, _qty) in request order take room on all their
    resources or on none.

    Only resources asked for more than their room matter. Per round two running
    sums over them bound what is taken before a row: all earlier orders not
    refused yet, and all earlier ones surely admitted. An order within its room
    under the first on every resource is admitted, one beyond it under the
    second on any is refused. The earliest undecided order of a component of
    the order-resource graph is decided in every round, so rounds are at most
    the longest chain of orders that wait for each other. What a round decides
    leaves the rows after the next one, which adds it up in ``_taken``, so a
    round keeps on disk little more than what is undecided."""
    # a resource listed twice has its room once: an order would wait for its own copy, round after round, without end
    room = room.groupBy("resource_id").agg(F.min("_room").alias("_room"))
    tight = (needs.groupBy("resource_id").agg(F.sum("_qty").alias("_all")).join(room, "resource_id")
             .filter(F.col("_all") > F.col("_room")).drop("_all"))
    order = ["resource_id", "ts", "request_id"]
    rows = sorted_pieces(needs.join(tight, "resource_id"), order, order).select(
        "order_id", "resource_id", "_qty", "_room", PIECE, PLACE, F.lit(0).cast("long").alias("_taken"), F.lit(None).cast("boolean").alias("_ok"))
    refused = rows.filter("not _ok").select("order_id")
    while not rows.filter("_ok is null").isEmpty():
        rows = scan_sums(rows, "resource_id", {"_most": F.when(F.coalesce("_ok", F.lit(True)), F.col("_qty")), "_least": F.when(F.col("_ok"), F.col("_qty"))})
        rows = rows.filter("_ok is null").withColumns({"_most": F.col("_taken") + F.col("_most"), "_taken": F.col("_taken") + F.col("_least")}).drop("_ok", "_least")
        fits = F.min(F.col("_most") + F.col("_qty") <= F.col("_room"))
        fails = F.max(F.col("_taken") + F.col("_qty") > F.col("_room"))
        told = rows.groupBy("order_id").agg(F.when(fails, False).when(fits, True).alias("_ok"))
        rows = cut_lineage(rows.drop("_most").join(told, "order_id"))
        refused = refused.unionByName(rows.filter("not _ok").select("order_id"))
    return refused.distinct()


def return_orders(requests: DataFrame, borrow_order: DataFrame, borrow_detail: DataFrame,
                  resource_item: DataFrame, viewers: DataFrame):
    """BOR-3: full returns. Only borrowed/overdue orders with at least one
    detail; the first valid request per order returns it, later ones find
    it returned. Stock grows by each detail's outstanding quantity.

    A return is all or nothing: one that would lift any of its resources above
    ``total_qty`` is the database's error as a whole, gives nothing back, and
    later returns find the room it left (``_refused``).

    Returns (outcomes, new orders, new details, new resource stock)."""
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"))
    has_detail = borrow_detail.select("order_id").distinct().withColumn("_has_det", F.lit(True))
    x = (requests.join(borrow_order.select("order_id", "applicant_user_id", "order_status",
                                           F.lit(True).alias("_has")), "order_id", "left")
         .join(has_detail, "order_id", "left").join(actors, "actor_user_id", "left"))
    reason = (F.when(~F.coalesce(F.col("_role").isin("admin", "club"), F.lit(False)), "forbidden")
              .when(F.col("_has").isNull(), "order_not_found")
              .when((F.col("_role") != "admin") & (F.col("applicant_user_id") != F.col("actor_user_id")), "forbidden")
              .when(~F.col("order_status").isin("borrowed", "overdue"), "not_returnable")
              .when(F.col("_has_det").isNull(), "no_detail"))
    # kept, as the rounds of refusals need them before the outcomes do
    x = cut_lineage(x.select("request_id", "order_id", "ts", reason.alias("_reason")))
    first = (x.filter(F.col("_reason").isNull()).groupBy("order_id")
             .agg(F.min(F.struct("ts", "request_id")).alias("_first")))
    owed = F.greatest(F.col("borrow_qty") - F.col("returned_qty"), F.lit(0))
    needs = (borrow_detail.select("order_id", "resource_id", owed.alias("_qty")).filter("_qty > 0").join(first, "order_id")
             .groupBy("order_id", "_first", "resource_id").agg(F.sum("_qty").alias("_qty"))
             .select("order_id", "_first.ts", "_first.request_id", "resource_id", "_qty"))
    room = resource_item.select("resource_id", (F.col("total_qty") - F.col("available_qty")).cast("long").alias("_room"))
    refused = _refused(needs, room).withColumn("_refused", F.lit(True))
    x = x.join(first, "order_id", "left").join(refused, "order_id", "left")
    later = F.struct("ts", "request_id") > F.col("_first")
    outcome = F.when(F.col("_refused"), "db_error").when(later, "not_returnable").otherwise("returned")
    outcomes = x.select("request_id", "order_id", F.coalesce("_reason", outcome).alias("outcome"), "ts")
    done = outcomes.filter(F.col("outcome") == "returned").select("order_id", F.col("ts").alias("_rt"))
    new_orders = (borrow_order.join(done, "order_id", "left")
                  .withColumn("order_status", F.when(F.col("_rt").isNotNull(), "returned").otherwise(F.col("order_status")))
                  .withColumn("actual_return_time", F.coalesce("_rt", "actual_return_time")).drop("_rt"))
    det = borrow_detail.join(done, "order_id", "left")
    outstanding = F.when(F.col("_rt").isNotNull(), F.col("borrow_qty") - F.col("returned_qty")).otherwise(0)
    det = det.withColumn("_back", F.greatest(outstanding, F.lit(0)))
    back = det.groupBy("resource_id").agg(F.sum("_back").alias("_back")).filter(F.col("_back") > 0)
    new_details = det.withColumn("returned_qty", F.when(F.col("_back") > 0, F.col("borrow_qty"))
                                 .otherwise(F.col("returned_qty"))).drop("_rt", "_back")
    new_stock = (resource_item.join(back, "resource_id", "left")
                 .withColumn("available_qty", (F.col("available_qty") + F.coalesce("_back", F.lit(0))).cast("int"))
                 .withColumn("_changed", F.col("_back").isNotNull()).drop("_back"))
    return outcomes, new_orders, new_details, new_stock


def ingest_borrow_orders(requests: DataFrame, borrow_order: DataFrame, activity: DataFrame,
                         viewers: DataFrame) -> DataFrame:
    """DQ-9 + BOR-1: create borrow orders. Activity id must be digits, the
    status one of the order states (omitted -> 'approved'); the activity must
    exist (foreign key). New ids follow request order; the uid uses the
    request day and a six-digit-at-least id."""
    from quadflow.sources.schemas import ORDER_STATUS
    from quadflow.sources.tables import with_defaults
    # SCH-2: a form without the status field gets the default; a row with the
    # field left empty (NULL) is treated the same way.
    requests = with_defaults(requests, {"order_status": F.lit(None).cast("string")})
    actors = viewers.select(F.col("user_id").alias("actor_user_id"), F.col("role").alias("_role"))
    status = F.coalesce(strip("order_status"), F.lit("approved"))
    x = (requests.withColumn("_status", status).withColumn("_act", strip("activity_ref").try_cast("long"))
         .join(actors, "actor_user_id", "left")
         .join(activity.select(F.col("activity_id").alias("_act"), F.lit(True).alias("_has")), "_act", "left"))
    reason = (F.when(~F.coalesce(F.col("_role").isin("admin", "club"), F.lit(False)), "forbidden")
              .when(~_digits(F.col("activity_ref")) | ~F.col("_status").isin(*ORDER_STATUS), "invalid_form")
              .when(F.col("_has").isNull() | F.col("expected_return_time").isNull(), "db_error"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("created")))
    from quadflow.operators.settlement import _ids
    made = _ids(x.filter(F.col("outcome") == "created"), borrow_order.select(F.max("order_id")).scalar(),
                "order_id", ["ts", "request_id"])
    made = made.select("request_id", "outcome", "order_id", order_uid(F.col("order_id"), F.col("ts")).alias("order_uid"),
                       F.col("_act").alias("activity_id"), F.col("actor_user_id").alias("applicant_user_id"),
                       F.col("ts").alias("apply_time"), "expected_return_time", F.col("_status").alias("order_status"))
    bad = x.filter(F.col("outcome") != "created").select(
        "request_id", "outcome", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("order_id", "long"), ("order_uid", "string"), ("activity_id", "long"), ("applicant_user_id", "long"),
            ("apply_time", "timestamp_ntz"), ("expected_return_time", "timestamp_ntz"), ("order_status", "string"))])
    return made.unionByName(bad)


def after_reservations(outcomes: DataFrame, borrow_order: DataFrame, resource_item: DataFrame):
    """BOR-2 state: every order with an accepted line becomes 'borrowed'
    (whatever it was; its first accepted line is when it changed), and each
    resource loses the accepted quantities; one without any keeps its stock.
    Returns (orders with the time of the change, all resources)."""
    ok = outcomes.filter(F.col("outcome") == "accepted")
    first = ok.groupBy("order_id").agg(F.min("ts").alias("_changed_at"))
    orders = (borrow_order.join(first, "order_id", "left")
              .withColumn("order_status", F.when(F.col("_changed_at").isNotNull(), "borrowed")
                          .otherwise(F.col("order_status"))))
    used = ok.groupBy("resource_id").agg(F.sum("borrow_qty").alias("_used"))
    stock = (resource_item.join(used, "resource_id", "left")
             .select("resource_id", (F.col("available_qty") - F.coalesce("_used", F.lit(0))).cast("int").alias("available_qty")))
    return orders, stock
