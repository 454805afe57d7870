"""Benchmark decontamination: SimHash over item-sized windows, multi-index
Hamming blocks, exact weighted-shingle similarity.

A document is read in windows as long as the benchmark items, at every word.
A window's fingerprint has 256 bits, each the majority of that bit over the
hashes of its five-word shingles. Fingerprints are cut into 32 blocks of 8
bits; if two differ in at most ``RADIUS`` bits, some block differs in at most
RADIUS // 32 (pigeonhole), so a table per block and value of the items that
near finds every item within the radius. What it finds is verified by the
exact similarity of the shingle multisets: sum of smaller over sum of larger
counts. Windows that hold no shingle of any item have similarity 0 and are not
fingerprinted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.llm.arrow import text_slices, utf8
from quadflow.llm.words import U, mix, shingles, words

SIZE = 5
SIMILARITY = 0.75
BLOCKS = 32
RADIUS = 72  # of 256; similarity 0.75 differs in 44 bits on average, with deviation 6
ITEM_BLOCK = 20_000  # items that one pass over the documents looks for
SPAN = 20_000  # window starts fingerprinted at a time
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _bits(h: np.ndarray) -> np.ndarray:
    """256 pseudo-random bits of each hash, one byte per bit."""
    parts = np.stack([mix(h + U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) for k in range(1, 5)], 1)
    return np.unpackbits(np.ascontiguousarray(parts).view(np.uint8), axis=1)


def _majority(counts: np.ndarray, total) -> np.ndarray:
    return np.packbits(2 * counts > total, axis=1)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The 32 bytes of a shingle multiset's SimHash."""
    return _majority(_bits(h).sum(axis=0, dtype=np.int64)[None, :], len(h))[0]


def _distances(byte_a, byte_b):
    return np.bitwise_count(byte_a ^ byte_b)


class Items:
    """Items by length in words, each length with its multi-index tables."""

    def __init__(self, ids: list[int], hashes: np.ndarray, offsets: np.ndarray, size: int):
        grams, at = shingles(hashes, offsets, size)
        lengths = np.diff(offsets)
        self.size = size
        self.by_length = {}
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BLOCKS
        anchors: dict[int, set] = {}
        for length in sorted(set(lengths.tolist()) - {0}):
            own = np.flatnonzero(lengths == length)
            multisets = [np.unique(grams[at[i]:at[i + 1]], return_counts=True) for i in own]
            prints = np.stack([fingerprint(grams[at[i]:at[i + 1]]) for i in own])
            tables = np.stack([np.packbits(near[:, prints[:, b]], axis=1) for b in range(BLOCKS)])
            self.by_length[length] = ([ids[i] for i in own], multisets, prints, tables)
            for names, _ in multisets:
                for g in names.tolist():
                    anchors.setdefault(g, set()).add(length)
        self.anchors = np.array(sorted(anchors), U)
        self.anchor_lengths = [sorted(anchors[int(g)]) for g in self.anchors]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.anchors >> U(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray):
        """(position, anchor number) of the shingles that an item holds."""
        if not len(self.anchors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.flatnonzero(self.maybe[(grams >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.anchors, grams[pos]), len(self.anchors) - 1)
        ok = self.anchors[at] == grams[pos]
        return pos[ok], at[ok]

    def search(self, grams: np.ndarray, starts: np.ndarray, width: int, length: int):
        """(window start, item id, similarity) of the windows of ``width``
        shingles at ``starts`` that are similar enough to an item."""
        ids, multisets, prints, tables = self.by_length[length]
        lo = int(starts[0])
        counts = np.zeros((int(starts[-1]) - lo + width + 1, 256), np.int32)
        np.cumsum(_bits(grams[lo:lo + len(counts) - 1]), axis=0, out=counts[1:])
        got = _majority(counts[starts - lo + width] - counts[starts - lo], width)
        found = np.zeros((len(starts), tables.shape[2]), np.uint8)
        for b in range(BLOCKS):
            found |= tables[b][got[:, b]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(ids)))
        close = _distances(got[window], prints[item]).sum(axis=1) <= RADIUS
        for w, i in zip(window[close].tolist(), item[close].tolist()):
            names, n = np.unique(grams[starts[w]:starts[w] + width], return_counts=True)
            theirs, m = multisets[i]
            _, a, b = np.intersect1d(names, theirs, assume_unique=True, return_indices=True)
            least = int(np.minimum(n[a], m[b]).sum())
            similarity = least / (int(n.sum()) + int(m.sum()) - least)
            if similarity >= SIMILARITY:
                yield int(starts[w]), ids[i], similarity


def _windows(items: Items, hashes: np.ndarray, offsets: np.ndarray):
    """(text, item id, first word in the text, words, similarity) of every
    similar window of some texts."""
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    for kind in sorted({min(n, items.size) for n in items.by_length}):  # shingles of 5 words, or whole items of fewer
        scale = mix(np.arange(1, items.size + 1, dtype=U)) | U(1)
        m = len(hashes) - kind + 1
        if m <= 0:
            continue
        grams = np.zeros(m, U)
        for k in range(kind):
            grams += hashes[k:k + m] * scale[k]
        grams = mix(grams if kind == items.size else grams + U(kind))
        pos, anchor = items.hits(grams)
        inside = text[pos] == text[pos + kind - 1]
        pos, anchor = pos[inside], anchor[inside]
        ranges: dict[tuple, list] = {}
        for p, a in zip(pos.tolist(), anchor.tolist()):
            t = text[p]
            for length in items.anchor_lengths[a]:
                if min(length, items.size) == kind:
                    first, last = int(offsets[t]), int(offsets[t + 1])
                    ranges.setdefault((int(t), length), []).append((max(first, p + kind - length), max(first, min(p, last - length))))
        for (t, length), own in ranges.items():
            first, last = int(offsets[t]), int(offsets[t + 1])
            width = min(length, last - first) - kind + 1
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in own]))
            cuts = np.flatnonzero(np.diff(starts) > length) + 1
            for group in np.split(starts, cuts):
                for k in range(0, len(group), SPAN):
                    for s, item, similarity in items.search(grams, group[k:k + SPAN], width, length):
                        yield t, item, s - first, width + kind - 1, similarity


def _item_rows(table: pa.Table, size: int) -> Items:
    data, off = utf8(table.column("text"))
    hashes, _, _, word_offsets = words(data, off)
    return Items(table.column("item_id").to_pylist(), hashes, word_offsets, size)


def contaminated(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id,
    the best window (start_word from 0, n_words) and its similarity, 0.75 or
    more; of equally similar windows the first.

    A document shorter than an item is one window. Items of fewer than five
    words match as whole sequences; null texts, texts without words, and null
    ids match nothing. Repeated rows count once; other columns are ignored;
    empty tables give no rows. Items are looked for ``ITEM_BLOCK`` at a time,
    so what is sent to the tasks is bounded."""
    spark = documents.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks = own.count() // ITEM_BLOCK + 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).filter("doc_id is not null and text is not null")
    out = None
    for k in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else own
        items = spark.sparkContext.broadcast(_item_rows(part.toArrow(), size))

        def run(batches, items=items):
            for batch in batches:
                for piece, data, off in text_slices(batch, "__text"):
                    hashes, _, _, word_offsets = words(data, off)
                    best: dict[tuple, tuple] = {}
                    ids = None
                    for t, item, start, n, similarity in _windows(items.value, hashes, word_offsets):
                        ids = ids or piece.column("doc_id").to_pylist()
                        key = (ids[t], item)
                        if key not in best or (-similarity, start) < (-best[key][2], best[key][0]):
                            best[key] = (start, n, similarity)
                    if best:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()),
                             pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64()),
                             pa.array([v[2] for v in best.values()], pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = rows.mapInArrow(run, FOUND)
        out = found if out is None else out.union(found)
    best = F.min_by(F.struct("start_word", "n_words", "similarity"), F.struct(-F.col("similarity"), F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start_word", "b.n_words", "b.similarity")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, all columns as they are.
    Rows with a null doc_id can't be named in a finding and stay."""
    found = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti")
