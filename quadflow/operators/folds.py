"""FOLD-1: clamped score updates applied in order.

A clamped add ``x -> min(hi, max(lo, x + d))`` does not commute with other
clamped adds, so the final credit depends on order. The family of maps
``x -> min(H, max(L, x + a))`` is closed under composition, though:

    (g o f) = (a_f + a_g,  clamp(L_f + a_g, L_g, H_g),  clamp(H_f + a_g, L_g, H_g))

so a long ordered sequence reduces associatively: a tree with a fixed fan-in.
Each step's place in its key's sequence is counted over sorted pieces; runs of
``FAN_IN`` places are composed into one map, then runs of ``FAN_IN`` maps, until
every key has one, which is applied to its start score. No row ever holds more
than ``FAN_IN`` maps, however long one key's sequence is or how many of its
steps have the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.functions.ordering import running_count

FAN_IN = 512  # maps that are composed in one row
_WIDE = 1_000_000_000  # identity bounds: wider than any score


def _compose(acc: Column, op: Column) -> Column:
    a = acc["a"] + op["a"]
    lo = F.least(op["hi"], F.greatest(op["lo"], acc["lo"] + op["a"]))
    hi = F.least(op["hi"], F.greatest(op["lo"], acc["hi"] + op["a"]))
    return F.struct(a.alias("a"), lo.alias("lo"), hi.alias("hi"))


def _identity() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(-_WIDE).cast("long").alias("lo"),
                    F.lit(_WIDE).cast("long").alias("hi"))


def clamped_fold(ops: DataFrame, start: DataFrame, key: str, lo: int, hi: int,
                 ts: str = "ts", order: tuple[str, ...] = (), value: str = "score") -> DataFrame:
    """Apply ``ops`` (key, ts, *order, delta) in (ts, *order) order to the
    ``start`` score (key, value), clamping to [lo, hi] after every step.
    Returns (key, value) for keys that have ops."""
    op = F.struct(F.col("delta").cast("long").alias("a"), F.lit(lo).cast("long").alias("lo"),
                  F.lit(hi).cast("long").alias("hi"))
    maps = running_count(ops.select(key, ts, *order, op.alias("_f")), key, [ts, *order], F.lit(True), "_at").select(key, "_at", "_f")
    longest = (maps.agg(F.max("_at")).first()[0] or 0) + 1
    while True:
        runs = maps.groupBy(key, F.floor(F.col("_at") / FAN_IN).cast("long").alias("_at"))
        listed = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("k"), F.col("_f").alias("f")))).alias("_fs"))
        maps = listed.select(key, "_at", F.aggregate("_fs", _identity(), lambda acc, x: _compose(acc, x["f"])).alias("_f"))
        longest = -(-longest // FAN_IN)
        if longest == 1:
            break
    applied = maps.join(start.select(key, F.col(value).alias("_x")), key)
    f = F.col("_f")
    return applied.select(key, F.least(f["hi"], F.greatest(f["lo"], F.col("_x") + f["a"])).cast("int").alias(value))
