"""Skew-safe ordinals: ``row_number()`` over a key without one task per key.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sorts every row of
a key in a single task, so a key holding a third of the input serialises a
third of the job. ``ordinal`` splits each key into ordered buckets (by default
fixed-width time slices of the first order column):

1. count rows per (key, bucket)                -- partial aggregate, small output
2. prefix-sum those counts per key             -- window over the *count* table
3. number rows inside each (key, bucket)       -- many independent tasks
4. ordinal = bucket offset + local number      -- join on (key, bucket)

The result equals the single-window ``row_number`` whenever bucket order is
consistent with the row order, which holds because the bucket is a
non-decreasing function of the leading order column.

``numbered`` (no key) and ``running_count`` (segmented) go by sampled ranges of
the whole order instead, which also splits rows of one and the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadflow.session import cut_lineage

DEFAULT_BUCKET_MICROS = 60 * 1_000_000  # one minute of request time
PIECE, PLACE = "_piece", "_place"


def time_bucket(ts: Column | str, width_micros: int = DEFAULT_BUCKET_MICROS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width_micros)).cast("long")


def value_bucket(value: Column | str, width: int = 1024) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width)).cast("long")


def sorted_pieces(df: DataFrame, cut: list[Column | str], order: list[Column | str], pieces: int | None = None) -> DataFrame:
    """``df`` in globally sorted pieces, with ``_piece`` (from 0, in order) and
    ``_place`` (from 0 in its piece, in order).

    Spark samples the ``cut`` columns, deals the rows out by range and sorts
    each piece by ``order``, of which ``cut`` must be a prefix (or coarser): a
    key holding a third of the rows is spread over many pieces, as long as
    ``cut`` tells its rows apart. The pieces are kept in the checkpoint folder
    as they are, in partitions of the same numbers, because a second sampling
    could cut elsewhere; mapInArrow may read them in order. Without ``pieces``
    there are as many as shuffle partitions, small ones coalesced.
    """
    dealt = (df.repartitionByRange(pieces, *cut) if pieces else df.repartitionByRange(*cut)).sortWithinPartitions(*order)
    kept = cut_lineage(dealt.withColumn("_dealt_at", F.monotonically_increasing_id()))
    return (kept.withColumn(PIECE, F.shiftright("_dealt_at", 33).cast("int"))
            .withColumn(PLACE, F.col("_dealt_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_dealt_at"))


def pieces_for(df: DataFrame, rows: int) -> int:
    """Pieces of about ``rows`` rows each, as many as shuffle partitions at
    least (counts ``df``, which should be cheap to count, such as a table)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: the 1-based position of each row by ``order`` (a
    total one). Rows are dealt out by sampled ranges of the whole order, so one
    timestamp that holds a third of them is numbered by several tasks; a row's
    number is its place in its piece after the sizes of the earlier pieces."""
    rows = sorted_pieces(df, order, order)
    sizes = rows.groupBy(PIECE).agg(F.count("*").alias("_n"))
    before = _prior(sizes, [], PIECE, "_n", "_before").select(F.col(PIECE).alias("_p"), "_before")
    # one row per piece, so never more than there are shuffle partitions
    out = rows.join(F.broadcast(before), F.col(PIECE) == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop("_p", "_before", PIECE, PLACE)


def running_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], pieces: int | None = None) -> DataFrame:
    """``df`` with, per entry of ``sums``, the sum of that long amount over the
    earlier rows of the same ``key`` (by ``order``, a total one); null amounts
    count nothing. A segmented scan: summed inside each sorted piece, after the
    sums of the earlier pieces that hold the key, so a hot key is summed by
    many tasks."""
    return scan_sums(sorted_pieces(df, [key, *order], [key, *order], pieces), key, sums).drop(PIECE, PLACE)


def scan_sums(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """``running_sums`` over rows that already are in sorted pieces of the key
    (and may have been shuffled since: their piece and place say the order)."""
    amounts = {f"_amount{i}": F.coalesce(c, F.lit(0)).cast("long") for i, c in enumerate(sums.values())}
    part = [key, PIECE]
    inside = Window.partitionBy(*part).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(amounts).withColumns({f"_in{i}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for i, a in enumerate(amounts)})
    before = rows.groupBy(*part).agg(*[F.sum(a).alias(a) for a in amounts])
    for i, a in enumerate(amounts):
        before = _prior(before, [key], PIECE, a, f"_before{i}")
    before = before.select(*[F.col(c).alias(f"_off_{c}") for c in part], *[f"_before{i}" for i in range(len(sums))])
    out = rows.join(before, part_eq(rows, before, part, "_off_"))
    out = out.withColumns({name: F.col(f"_before{i}") + F.col(f"_in{i}") for i, name in enumerate(sums)})
    return out.drop(*amounts, *[f"_in{i}" for i in range(len(sums))], *before.columns)


def running_count(df: DataFrame, key: str, order: list[str], flag: Column, name: str, pieces: int | None = None) -> DataFrame:
    """``df`` with ``name``: how many earlier rows of the same key are flagged
    (``running_sums`` of ones)."""
    return running_sums(df, key, order, {name: F.when(flag, 1)}, pieces)


def ordinal(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
            name: str = "ordinal") -> DataFrame:
    """Add ``name`` = 1-based position of each row within ``keys`` by ``order``.

    ``bucket`` must be non-decreasing in ``order`` (e.g. ``time_bucket`` of
    the leading timestamp). NULL buckets sort first, like NULL timestamps.
    """
    b = "_ord_bucket"
    part = keys + [b]
    # Number rows inside each (key, bucket) first. The bucket sizes are read
    # off the numbered rows (max of the local number), so both branches hang
    # off the same (key, bucket) shuffle, which Spark reuses: the input
    # lineage is computed once.
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    numbered = df.withColumn(b, bucket).withColumn("_ord_local", local)
    counts = numbered.groupBy(*part).agg(F.max("_ord_local").alias("_ord_n"))
    offsets = _prior(counts, keys, b, "_ord_n", "_ord_off").select(*[F.col(c).alias(f"_off_{c}") for c in part], "_ord_off")
    joined = numbered.join(offsets, part_eq(numbered, offsets, part, "_off_"), "inner")
    return (joined.withColumn(name, (F.col("_ord_off") + F.col("_ord_local")).cast("long"))
            .drop("_ord_off", "_ord_local", b, *[f"_off_{c}" for c in part]))


def _prior(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the earlier rows of the key."""
    spec = Window.partitionBy(*keys) if keys else Window
    earlier = spec.orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def part_eq(left: DataFrame, right: DataFrame, cols: list[str], prefix: str = "") -> Column:
    """Null-safe equality of ``cols`` with the prefixed columns of ``right``
    (a NULL key or bucket still matches itself)."""
    cond = None
    for c in cols:
        term = left[c].eqNullSafe(right[prefix + c])
        cond = term if cond is None else cond & term
    return cond
