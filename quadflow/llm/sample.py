"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 62


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def bounded(rows: DataFrame, label: str, ident: str, per_label: int) -> tuple[DataFrame, dict]:
    """At most ``per_label`` rows of each label, those whose hashed id is
    smallest, and the number of rows of each label.

    The counts pick a hash threshold per label, so that only about twice the
    rows wanted are sorted; a second, exact cut follows."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    key = F.pmod(F.xxhash64(ident), F.lit(SPAN))
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, 2.0 * per_label / n + 100.0 / n)
        keep = keep | ((F.col(label) == F.lit(value)) & (key <= F.lit(int(share * SPAN))))
    first = Window.partitionBy(label).orderBy("__key", ident)
    out = (rows.withColumn("__key", key).filter(keep).withColumn("__rank", F.row_number().over(first))
           .filter(F.col("__rank") <= per_label).drop("__key", "__rank"))
    return out, counts


def labelled(documents: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``per_label`` labelled
    documents of each label, one row per document and label.

    The sample is drawn from the labels alone, so that the join's small side
    is bounded by ``per_label`` and no text is shuffled to find it. Labels
    other than 0 and 1, null ids and null texts are left out; of several texts
    of one id the smallest counts."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    taken, _ = bounded(own.dropDuplicates(), "label", "doc_id", per_label)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(taken), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
