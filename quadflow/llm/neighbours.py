"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: principal directions, a learned rotation (ITQ),
signs. A block of vectors indexes its codes by substring: per substring, the
rows sorted by its value. A query looks up, in every substring, all values
within radius // substrings bits of its own (pigeonhole), which retrieves every
code of the block within the Hamming radius; these are reranked by the cosine
of the original vectors in double precision. A query that finds too few in a
block widens its radius there until it has enough or has seen the block.

Blocks of queries meet blocks of vectors, so no task holds more than one of
each, and no vector is met by key: equal or crowded vectors are dealt out like
any others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.session import cut_lineage

SAMPLE = 8192  # distinct vectors that the rotation is learned from, at most
ROUNDS = 20
BITS = 64
SUBSTRING = 8  # bits
WIDTH = 3  # bits that a substring may differ in, at first: radius 31
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
PAIRS = 1_000_000  # candidates held at a time
SCORED = 50_000  # and their vectors


def learn(x: np.ndarray) -> dict:
    """Mean and projection (ITQ) of the sample's unit vectors. If there are
    fewer dimensions than BITS, further bits come from random directions."""
    dim = x.shape[1]
    if not len(x):
        return {"mean": np.zeros(dim), "project": np.random.default_rng(1).normal(size=(dim, BITS))}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    k = min(BITS, dim)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    top = vectors[:, ::-1][:, :k]
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.normal(size=(k, k)))[0]
    v = centred @ top
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    project = top @ turn
    if k < BITS:
        project = np.concatenate([project, rnd.normal(size=(dim, BITS - k))], axis=1)
    return {"mean": mean, "project": project}


def codes(x: np.ndarray, model: dict) -> np.ndarray:
    """The BITS // SUBSTRING substring values of each vector."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.packbits((unit - model["mean"]) @ model["project"] >= 0, axis=1)


class Block:
    """Multi-index over the codes of one block of vectors."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order = [np.argsort(code[:, j], kind="stable") for j in range(code.shape[1])]
        self.start = [np.searchsorted(code[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        ball = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.flips = [np.flatnonzero(ball <= r).astype(np.uint8) for r in range(SUBSTRING + 1)]

    def within(self, query: np.ndarray, width: int):
        """The (query, row) pairs whose codes differ in at most
        (width + 1) * substrings - 1 bits, each once."""
        n, parts = len(self.code), self.code.shape[1]
        flips = self.flips[min(width, SUBSTRING)]
        seen = np.zeros((len(query), n), bool)
        for j in range(parts):
            probes = query[:, j][:, None] ^ flips[None, :]
            lo, hi = self.start[j][probes], self.start[j][probes.astype(np.int64) + 1]
            for q in range(len(query)):
                for a, b in zip(lo[q].tolist(), hi[q].tolist()):
                    if b > a:
                        seen[q, self.order[j][a:b]] = True
        q, row = np.nonzero(seen)
        near = np.bitwise_count(self.code[row] ^ query[q]).sum(axis=1) < (width + 1) * parts
        return q[near], row[near]


def _nearest(vectors: np.ndarray, code: np.ndarray, query: np.ndarray, query_code: np.ndarray, k: int):
    """(query, row, cosine) of the k nearest rows found for each query."""
    block = Block(code)
    norm, query_norm = np.linalg.norm(vectors, axis=1), np.linalg.norm(query, axis=1)
    out = []
    step = max(1, PAIRS // max(1, len(code)))
    for lo in range(0, len(query), step):
        todo = np.arange(lo, min(lo + step, len(query)))
        width = WIDTH
        while len(todo):
            q, row = block.within(query_code[todo], width)
            enough = np.bincount(q, minlength=len(todo)) >= min(k, len(code))
            if width >= SUBSTRING:
                enough[:] = True
            use = enough[q]
            mine, row = todo[q[use]], row[use]
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", vectors[row[a:a + SCORED]], query[mine[a:a + SCORED]])
                                                   for a in range(0, len(row), SCORED))]) / (norm[row] * query_norm[mine])
            order = np.lexsort((row, -score, mine))
            mine, row, score = mine[order], row[order], score[order]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
            place = np.arange(len(mine)) - np.repeat(first, np.diff(np.r_[first, len(mine)]))
            # a tie at the end stays whole: ids decide, and the caller knows them
            last = score[np.minimum(first + k, np.r_[first[1:], len(mine)]) - 1] if len(first) else np.zeros(0)
            keep = (place < k) | (score >= np.repeat(last, np.diff(np.r_[first, len(mine)])))
            out.append((mine[keep], row[keep], score[keep]))
            todo = todo[~enough]
            width += 1
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _meet(model, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            query, x = _matrix(left.column("v")), _matrix(right.column("v"))
            m = model.value
            found = _nearest(x, codes(x, m), query, codes(query, m), k)
        q, row, score = found
        ids = right.column("members").combine_chunks()
        return pa.table({"vid": left.column("vid").take(pa.array(q)), "score": pa.array(score, pa.float64()), "members": pa.chunked_array([ids.take(pa.array(row))]) if right.num_rows else pa.chunked_array([ids])})
    return run


def search(vectors: DataFrame, is_query, ident: str = "vec_id", column: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest of every row that ``is_query`` (a condition on the id)
    picks, among all other rows: query_id, rank (from 1), vec_id, score (the
    cosine, in double precision), nearest first, ties to the smaller vec_id.

    Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part. Vectors of one length are searched
    among themselves, since others have no cosine with them; each length has
    its own index. Equal vectors are searched once: of each distinct vector the
    k + 1 smallest ids are kept, which no result can miss. Repeated ids with
    one vector count once. Fewer than k others: all of them. The rotation is
    learned from at most SAMPLE distinct vectors; every vector is indexed."""
    spark = vectors.sparkSession
    ok = (F.col("e").isNotNull() & F.col("id").isNotNull() & (F.size("e") > 0)
          & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0))
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(column).cast("array<double>").alias("e")).filter(ok)
    lengths = sorted(r["d"] for r in rows.select(F.size("e").alias("d")).distinct().collect())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        found = _search(rows.filter(F.size("e") == d) if len(lengths) > 1 else rows, is_query, k)
        out = found if d == lengths[0] else out.unionByName(found)
    return out


def _search(rows: DataFrame, is_query, k: int) -> DataFrame:
    """``search`` among vectors (id, e) of one length."""
    spark = rows.sparkSession
    # each distinct vector with its k + 1 smallest ids; its queries are kept apart. Two steps, so that one vector's many ids are thinned out first.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("e", "salt").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    distinct = (salted.groupBy("e").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice("ids", 1, k + 1))))), 1, k + 1).alias("members"))
                .withColumn("vid", F.element_at("members", 1)))
    distinct = cut_lineage(distinct)
    total = distinct.count()
    blocks = total // BLOCK_ROWS + 1
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("e").collect()]
    model = spark.sparkContext.broadcast(learn(np.array(sample, float).reshape(len(sample), -1)))
    queries = cut_lineage(rows.filter(is_query(F.col("id"))).select("id", "e").distinct())
    asked = queries.select("e").distinct().join(distinct.select("e", "vid"), "e")
    query_blocks = asked.count() // QUERY_ROWS + 1

    def packed(df, name, n, other, others):
        """Rows with their vector as bytes, dealt to ``n`` blocks, a copy for
        each block of the other side."""
        def run(batches):
            for b in batches:
                e = b.column("e")
                flat = e.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("members"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vid", "members", "v"])
        out = df.mapInArrow(run, "vid long, members array<long>, v binary")
        return (out.withColumn(name, F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    left = packed(asked.withColumn("members", F.array().cast("array<bigint>")).select("e", "vid", "members"), "qb", query_blocks, "xb", blocks)
    right = packed(distinct.select("e", "vid", "members"), "xb", blocks, "qb", query_blocks)
    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(_meet(model, k + 1), "vid long, score double, members array<long>")
    # per distinct query vector its nearest distinct vectors, then per query row its nearest rows
    ranked = found.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "members"))).alias("near"))
    named = queries.join(distinct.select("e", "vid"), "e").select(F.col("id").alias("query_id"), "vid").join(ranked, "vid")
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["members"], lambda i: F.struct(x["far"].alias("far"), i.alias("vec_id")))))
    best = F.slice(F.array_sort(F.filter(flat, lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    out = named.select("query_id", F.posexplode(best).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
