"""Second-hand trade: order admission, status changes and the mixed log fold."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.functions.ordering import pieces_for, running_count
from quadflow.session import cut_lineage
from quadflow.sources.schemas import TRADE_STATUS


# The per-partition kernels of this module run in Python workers; they are
# shipped by value so executors need no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


PIECE_ROWS = 200_000  # log rows that one sorted piece holds
KEY = ("ts", "request_id")


def _authorised(requests: DataFrame, trade_order: DataFrame) -> DataFrame:
    """Status changes of a listed state, by the buyer or seller of an existing order."""
    valid = requests.filter(F.col("order_status").isin(*TRADE_STATUS))
    orders = trade_order.select("order_id", "product_id", "buyer_user_id", "seller_user_id", F.col("finish_time").alias("_fin"))
    return valid.join(orders, "order_id").filter(
        (F.col("actor_user_id") == F.col("buyer_user_id")) | (F.col("actor_user_id") == F.col("seller_user_id")))


def _effect(status):
    """Product state that an applied change leaves behind; null if it leaves it alone."""
    return F.when(status == "cancelled", "on_sale").when(status == "completed", "sold")


def admit_trades(requests: DataFrame, product: DataFrame, trade_order: DataFrame, changes: DataFrame | None = None,
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """TRD-1 for a log of buy attempts: per product, the first buy by someone
    other than the seller while the product is on sale locks it; reasons in
    order: missing, not on sale (or already taken), own product.

    ``changes`` (request_id, ts, actor_user_id, order_id, order_status) are the
    status changes of the same time on orders made before it: an authorised
    cancel puts the product on sale again, a completion sells it. They cut a
    product's log into segments (of equal (ts, request_id) the buy comes
    first); each segment starts in a known state, and the first eligible buy of
    one on sale wins it."""
    from quadflow.operators.settlement import _ids
    p = product.select("product_id", "seller_user_id", F.col("status").alias("_pstatus"), F.lit(True).alias("_has"))
    buys = requests.select("request_id", "ts", "product_id", "actor_user_id")
    if changes is None:
        x, starts = buys.withColumn("_seg", F.lit(0).cast("long")), None
    else:
        resets = _authorised(changes, trade_order).withColumn("_start", _effect(F.col("order_status"))).filter("_start is not null")
        log = buys.withColumn("_start", F.lit(None).cast("string")).unionByName(resets.select(*buys.columns, "_start"))
        log = log.withColumn("_change", F.col("_start").isNotNull())
        x = running_count(log, "product_id", [*KEY, "_change"], F.col("_change"), "_seg", pieces_for(requests, piece_rows))
        starts = x.filter("_change").select("product_id", (F.col("_seg") + 1).alias("_seg"), "_start")
        x = x.filter("not _change").drop("_change", "_start")
    x = x.join(p, "product_id", "left")
    if starts is not None:
        x = x.join(starts, ["product_id", "_seg"], "left").withColumn("_pstatus", F.coalesce("_start", "_pstatus"))
    own = F.col("actor_user_id") == F.col("seller_user_id")
    win = (x.filter(F.col("_has") & (F.col("_pstatus") == "on_sale") & ~own)
           .groupBy("product_id", "_seg").agg(F.min(F.struct(*KEY)).alias("_win")))
    x = x.join(win, ["product_id", "_seg"], "left")
    key = F.struct(*KEY)
    reason = (F.when(F.col("_has").isNull(), "missing")
              .when((F.col("_pstatus") != "on_sale") | (F.col("_win").isNotNull() & (key > F.col("_win"))), "not_on_sale")
              .when(own, "own_product"))
    x = x.withColumn("outcome", F.coalesce(reason, F.lit("accepted")))
    ok = _ids(x.filter(F.col("outcome") == "accepted"), trade_order.select(F.max("order_id")).scalar(), "order_id",
              ["ts", "request_id"])
    cols = ["request_id", "product_id", "outcome", "order_id", F.col("actor_user_id").alias("buyer_user_id"),
            "seller_user_id"]
    bad = x.filter(F.col("outcome") != "accepted").withColumn("order_id", F.lit(None).cast("long"))
    return ok.select(*cols).unionByName(bad.select(*cols))


def apply_trade_status(requests: DataFrame, trade_order: DataFrame, product: DataFrame):
    """TRD-2: buyer or seller sets any listed status. Last accepted change
    wins; finish_time is the latest accepted 'completed' (kept otherwise);
    the product follows the last accepted cancel (on sale, even after sold)
    or complete (sold). Returns (order changes, product changes)."""
    x = _authorised(requests, trade_order)
    orders = x.groupBy("order_id").agg(
        F.max(F.struct("ts", "request_id", "order_status")).alias("_last"),
        F.max(F.when(F.col("order_status") == "completed", F.col("ts"))).alias("_done"),
        F.max("_fin").alias("_fin"))
    orders = orders.select("order_id", F.col("_last.order_status").alias("order_status"),
                           F.coalesce("_done", "_fin").alias("finish_time"))
    effects = (x.filter(F.col("order_status").isin("cancelled", "completed")).groupBy("product_id")
               .agg(F.max(F.struct("ts", "request_id", "order_status")).alias("_last")))
    products = effects.select("product_id", F.when(F.col("_last.order_status") == "cancelled", "on_sale")
                              .otherwise("sold").alias("status"))
    return orders, products


WALKED = "product_id long, seg long, start string, won boolean"


def _walk_segments(batches):
    """Kernel over one row per segment, sorted by (product, seg): the state each
    starts in and whether its first eligible buy is accepted.

    Columns: initial (state of the product), candidate (is there an eligible
    buy), ref (segment of the buy that the change at the segment's end refers
    to, -1 for none), effect (state that the change sets). Only what takes
    effect is stepped through: the next candidate of a product on sale, or the
    next change of an accepted buy. Between batches a product keeps its state
    and one byte per segment."""
    import heapq

    import numpy as np
    import pyarrow as pa
    product, status, won, base = None, None, bytearray(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        products = batch.column("product_id").to_numpy()
        cuts = np.r_[0, np.flatnonzero(products[1:] != products[:-1]) + 1, len(products)]
        starts, flags = [], np.zeros(len(products), bool)
        initial, effect = batch.column("initial"), batch.column("effect").to_pylist()
        candidate = batch.column("candidate").to_numpy(zero_copy_only=False)
        ref = batch.column("ref").to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if product is None or products[a] != product:
                product, status, won, base = products[a], initial[a].as_py(), bytearray(), 0
            n, here = b - a, ref[a:b]
            own = np.flatnonzero(candidate[a:b])
            early = np.flatnonzero((here >= 0) & (here < base))
            due = [int(k) for k in early if won[here[k]]]  # changes here on buys of earlier batches
            heapq.heapify(due)
            late = np.flatnonzero(here >= base)
            late = late[np.argsort(here[late], kind="stable")]
            owner = here[late] - base
            won.extend(bytes(n))
            marks, at = [(0, status)], 0
            while True:
                change = due[0] if due else n
                if status == "on_sale":
                    i = int(np.searchsorted(own, at))
                    if i < len(own) and own[i] <= change:
                        at = int(own[i])
                        won[base + at], flags[a + at], status = 1, True, "locked"
                        marks.append((at + 1, status))
                        lo, hi = np.searchsorted(owner, [at, at + 1])
                        for k in late[lo:hi].tolist():
                            heapq.heappush(due, k)
                        at += 1
                        continue
                if not due:
                    break
                at = heapq.heappop(due) + 1
                status = effect[a + at - 1]
                marks.append((at, status))
            states = [None] * n
            for (lo, state), (hi, _) in zip(marks, [*marks[1:], (n, None)]):
                states[lo:hi] = [state] * (min(hi, n) - min(lo, n))
            starts += states
            base += n
        yield pa.RecordBatch.from_arrays([batch.column("product_id"), batch.column("seg"), pa.array(starts, pa.string()), pa.array(flags)],
                                         names=["product_id", "seg", "start", "won"])


def replay_trade_log(log: DataFrame, product: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """TRD-3: a mixed log (kind 'buy' | 'status') replayed per product; a
    change names the buy that made its order, by request id.

    Whether a change would be authorised needs no replay: it is so if its buy
    stands earlier in the log of the same product and the actor is that buyer
    or the seller. Such changes that set a state cut the product's log into
    segments (a skew-safe running count), and of a segment's buys only the
    first by another than the seller can be accepted. So FOLD-3 shrinks to one
    small row per segment: they are walked in order, and every row of the log
    reads its outcome off its segment by a join on (product, segment)."""
    p = product.select("product_id", F.col("status").alias("_initial"), "seller_user_id")
    buys = log.filter(F.col("kind") == "buy")
    named = buys.select(F.col("request_id").alias("order_ref"), F.col("product_id").alias("_bp"), F.col("actor_user_id").alias("_buyer"),
                        F.struct(*KEY).alias("_bk"))
    changes = log.filter(F.col("kind") != "buy").join(named, "order_ref", "left")
    x = changes.unionByName(buys, allowMissingColumns=True).join(p, "product_id", "left")
    actor, seller = F.col("actor_user_id"), F.col("seller_user_id")
    known = (F.col("_bp") == F.col("product_id")) & (F.col("_bk") < F.struct(*KEY))
    by_party = (actor == F.col("_buyer")) | (F.coalesce(actor == seller, F.lit(False)))
    valid = F.col("new_status").isin(*TRADE_STATUS)
    x = x.select(*log.columns, "_initial", "seller_user_id",
                 F.coalesce(valid, F.lit(False)).alias("_valid"), F.coalesce(known & by_party, F.lit(False)).alias("_party"),
                 F.coalesce(known, F.lit(False)).alias("_known"), _effect(F.col("new_status")).alias("_effect"))
    cuts = (F.col("kind") != "buy") & F.col("_valid") & F.col("_party") & F.col("_effect").isNotNull() & F.col("_initial").isNotNull()
    x = running_count(x.withColumn("_cuts", cuts), "product_id", list(KEY), F.col("_cuts"), "_seg", pieces_for(log, piece_rows))
    open_ = (F.col("kind") == "buy") & F.col("_initial").isNotNull() & (actor != seller)
    first = x.filter(open_).groupBy("product_id", "_seg").agg(F.min(F.struct(*KEY)).alias("_first"), F.first("_initial").alias("initial"))
    marks = x.filter("_cuts").select("product_id", "_seg", "order_ref", F.col("_effect").alias("effect"), F.col("_initial").alias("initial"))
    refs = first.select(F.col("_first.request_id").alias("order_ref"), F.col("_seg").alias("ref"))
    marks = marks.join(refs, "order_ref", "left").select("product_id", "_seg", "initial", "effect", F.coalesce("ref", F.lit(-1)).alias("ref"))
    every = marks.withColumn("candidate", F.lit(False)).unionByName(
        first.select("product_id", "_seg", "initial", F.lit(None).cast("string").alias("effect"), F.lit(-1).cast("long").alias("ref"),
                     F.lit(True).alias("candidate")))
    segments = every.groupBy("product_id", F.col("_seg").alias("seg")).agg(
        F.max("initial").alias("initial"), F.max("candidate").alias("candidate"), F.max("ref").alias("ref"), F.max("effect").alias("effect"))
    walked = (segments.repartition("product_id").sortWithinPartitions("product_id", "seg").mapInArrow(_walk_segments, WALKED)
              .withColumnRenamed("seg", "_seg"))
    walked = cut_lineage(walked.join(first.select("product_id", "_seg", "_first"), ["product_id", "_seg"], "left"))
    accepted = walked.filter("won").select(F.col("_first.request_id").alias("order_ref"), F.lit(True).alias("_made"))
    x = x.join(walked, ["product_id", "_seg"], "left")
    key = F.struct(*KEY)
    start = F.when(F.col("_initial").isNotNull(), F.coalesce("start", "_initial"))
    before = F.when(F.coalesce(F.col("won") & (key > F.col("_first")), F.lit(False)), "locked").otherwise(start)
    buy = (F.when(F.col("_initial").isNull(), "missing").when(F.coalesce(F.col("won") & (key == F.col("_first")), F.lit(False)), "accepted")
           .when(before != "on_sale", "not_on_sale").otherwise("own_product"))
    done = x.filter("kind = 'buy'").select(*log.columns, buy.alias("outcome"),
                                           F.when(buy == "accepted", "locked").otherwise(before).alias("product_status"))
    change = (F.when(~F.col("_valid"), "invalid_status").when(F.col("_made").isNull() | ~F.col("_known"), "order_not_found")
              .when(~F.col("_party"), "forbidden").otherwise("applied"))
    other = x.filter("kind <> 'buy'").join(accepted, "order_ref", "left")
    other = other.select(*log.columns, change.alias("outcome"),
                         F.when(change == "applied", F.coalesce("_effect", before)).otherwise(before).alias("product_status"))
    return done.unionByName(other)
