"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quadflow.llm import bpe, decontaminate, jaccard, quality, toxicity
from quadflow.session import cut_lineage


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _keyed(docs):
    """The rows with a key made of all their values, so that a row is named by
    what it holds and no id is needed; only equal rows share one."""
    return docs.withColumn("__key", F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]))


def toxic(spark, docs, sf_dir):
    """Drops the rows that the toxicity operator rejects (score of 0.3 or more).
    Null and empty texts have the score of no evidence and stay; equal rows
    fare alike; columns and null doc_ids pass through; no rows give no rows."""
    return toxicity.accepted(docs, _labels(spark, sf_dir))


def poor(spark, docs, sf_dir):
    """Drops the rows that the quality classifier rejects (score below 0.5).
    Null and empty texts are scored like texts without n-grams; equal rows fare
    alike; columns and null doc_ids pass through; no rows give no rows."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def duplicates(spark, docs, sf_dir):
    """Keeps of each group of linked rows the one with the smallest doc_id
    (null last), and of equal rows one."""
    rows = _keyed(docs)
    classes = jaccard.linked(rows, "__key").select(F.col("doc_id").alias("__key"), "component_id")
    named = classes.distinct().join(rows.select("__key", "doc_id").distinct(), "__key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first"))
    kept = rows.join(first.select("first.__key"), "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def leaks(spark, docs, sf_dir):
    """Drops the rows that hold a benchmark passage."""
    rows = _keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """Token ids of what is left: doc_id, lang, source, n_tokens and ids
    (little-endian unsigned 32-bit integers); the ids decode to the text. A row
    per row, repeated ones and null doc_ids too; null and empty texts have no
    ids; other columns are left out; no rows give no rows."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # an eighth of the cache of the operator's own query: here the workers also keep the memory of four stages before
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), "text", path, public_tokenizers.PATTERN, cache_bytes=10_000_000)
    digests = coded.withColumn("decoded_sha256", F.sha2("decoded", 256))
    return digests.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("toxicity", toxic), ("quality", poor), ("duplicates", duplicates), ("decontamination", leaks), ("tokens", tokens)]
ORACLE_SQL = None  # learned models and BPE have no SQL form; the stages are tested against plain versions


def run(spark, sf_dir):
    """All stages over the documents table; each stage's rows are kept in the
    checkpoint folder, so a lost executor costs no earlier stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
