"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Every adjacent pair that is a
vocabulary entry waits in the bucket of its merge rank; a three-level bitmap of
64-bit words marks the non-empty buckets, so the next rank is three
find-first-set steps away whatever the pre-token's length. An entry whose pair
has changed since it was queued is stale and skipped. A pre-token of n bytes
costs O(n log n), where rescanning the pairs after every merge costs O(n^2).
All the new pre-tokens of a slice of rows share one queue.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.llm.arrow import release, slices, texts, utf8, worker_store

CACHE_BYTES = 80_000_000  # of units, and as many of pre-tokens, in a generation of a Python worker's memory
ENTRY_BYTES = 250  # that an entry takes besides its characters
OUT_BYTES = 4_000_000


def read_ranks(lines) -> dict[bytes, int]:
    """Ranks from lines of ``base64(token) rank``."""
    out = {}
    for line in lines:
        part = line.split()
        if part:
            out[base64.b64decode(part[0])] = int(part[1])
    return out


class RankQueue:
    """Positions by merge rank. Three levels of 64-bit words mark the ranks
    whose bucket holds something; ``first`` finds the smallest of them."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        """Fills an empty bucket."""
        self.buckets[rank] = positions
        word, group = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def first(self) -> int:
        top = self.top
        group = (top & -top).bit_length() - 1
        mid = self.mid[group]
        word = (group << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        return (word << 6) + (low & -low).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empties a bucket."""
        word, group = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.mid[group] ^= 1 << (word & 63)
            if not self.mid[group]:
                self.top ^= 1 << group
        return self.buckets.pop(rank)


class Recent:
    """A bounded dictionary of two generations: when the young one is full it
    becomes the old one, whose entries come back when they are asked for again
    and are forgotten otherwise."""

    def __init__(self, limit: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.limit = 0, limit

    def missing(self, wanted: set[str]) -> list[str]:
        """Those not remembered; afterwards ``young`` holds all the others."""
        if self.size >= self.limit:
            self.young, self.old, self.size = {}, self.young, 0
        young, old, out = self.young, self.old, []
        for key in wanted.difference(young):
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
            self.size += len(key) + ENTRY_BYTES
        return out


class Encoder:
    """Encodes texts with the merge ranks; every match of ``pattern`` is
    encoded on its own, no special tokens. ``ranks`` must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int | None = None):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.joined = {}  # left id * size + right id -> id of the two together
        self.two = np.full(65536, -1, np.int32)
        self.one = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.joined[a * self.size + b] = rank
        self.find = regex.compile(pattern).findall
        self.units = regex.compile(r"\s*\S+|\s+").findall
        self.uneven = regex.compile(r" (?:(?<=\s )|\Z)").search
        self.known, self.pieces = (Recent(cache_bytes or CACHE_BYTES) for _ in range(2))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens that are no entries themselves, all in one rank
        queue: pieces don't touch, so the smallest rank of all is the smallest
        of every piece that has it."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        first = self.two[data[:-1].astype(np.int32) << 8 | data[1:]] if n > 1 else np.zeros(0, np.int32)
        pairs = np.append(first, -1)
        pairs[stops - 1] = -1
        after = np.arange(1, n + 1)
        after[stops - 1] = -1
        before = np.arange(-1, n - 1)
        before[stops[:-1]] = -1
        queue, size, joined = RankQueue(self.size), self.size, self.joined.get
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0):]
        if len(order):
            cuts = np.flatnonzero(np.diff(pairs[order])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                queue.put(int(pairs[order[lo]]), order[lo:hi].tolist())
        pair, nxt, back, ids = pairs.tolist(), after.tolist(), before.tolist(), self.one[data].tolist()
        buckets, put = queue.buckets, queue.put
        while queue.top:
            rank = queue.first()
            bucket = queue.take(rank)
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = nxt[i]
                k = nxt[i] = nxt[j]
                ids[i] = rank
                ids[j] = -1
                pair[j] = -1
                smaller = False
                r = -1
                if k >= 0:
                    back[k] = i
                    r = joined(rank * size + ids[k], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            put(r, [i])
                        smaller = r < rank
                pair[i] = r
                h = back[i]
                if h >= 0:
                    r = pair[h] = joined(ids[h] * size + rank, -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            put(r, [h])
                        smaller |= r < rank
                if smaller and at + 1 < len(bucket):
                    put(rank, bucket[at + 1:])  # the smaller rank goes first
                    break
        out = np.array(ids, np.int32)
        kept = out >= 0
        ends = np.cumsum(kept)[stops - 1] * 4
        raw = out[kept].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, units: list[str]) -> None:
        """Adds units to the known ones."""
        found = [self.find(u) for u in units]
        todo, names = [], []
        new = self.pieces.missing(set().union(*found))
        ids = self.pieces.young
        for text in new:
            piece = text.encode("utf-8", "replace")
            whole = self.ranks.get(piece)
            if whole is not None:
                ids[text] = whole.to_bytes(4, "little")
            else:
                todo.append(piece)
                names.append(text)
        if todo:
            ids.update(zip(names, self.merge(todo)))
        self.known.young.update((u, ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps))) for u, ps in zip(units, found))

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers.

        White space only ever joins what follows it, so a text is cut before
        each run of white space; a unit is encoded alike wherever it stands."""
        cut = []
        for text in rows:
            if self.uneven(text):
                cut.append(self.units(text))
            else:
                parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.units(text)
                cut.append(parts)
        self.learn(self.known.missing(set().union(*cut)))
        known = self.known.young
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]


class Decoder:
    """The bytes behind ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode_all(self, rows: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.tokens.__getitem__, memoryview(x).cast("I"))) if x else b"" for x in rows]


def _in_slices(batches, column: str, drop: bool, outs: list[str], convert):
    """The batches, cut by the bytes in ``column``, with the binary columns
    that ``convert`` makes of its rows."""
    for batch in batches:
        for lo, hi in slices(np.diff(utf8(batch.column(column))[1]), OUT_BYTES):
            part = batch.slice(lo, hi - lo)
            values = convert(texts(part.column(column)).to_pylist())
            rest = part.drop_columns([column]) if drop else part
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(v, pa.binary()) for v in values)],
                                             schema=pa.schema([*rest.schema, *(pa.field(n, pa.binary()) for n in outs)]))
        release()


def _stored(kind: str, key: tuple, make):
    """What ``make`` builds from the ranks, kept while the Python worker lives."""
    store = worker_store(kind)
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def _read(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with_binary(df: DataFrame, keep: list[str], outs: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.BinaryType()) for n in outs])


def encode(df: DataFrame, column: str, ranks_path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Replaces text ``column`` by binary ``out``: its token ids, as
    little-endian unsigned 32-bit integers.

    Null and empty texts give no ids (empty binary, never null); texts of any
    length are encoded whole; every row is kept, repeated rows too, and other
    columns pass through unchanged. ``ranks_path`` is read once, on the
    driver (a vocabulary, about 1 MB), and sent with the tasks. A column that
    already has the name ``out`` is replaced.
    """
    lines = _read(df, ranks_path)
    keep = [c for c in df.columns if c not in (column, out)]

    def run(batches):
        encoder = _stored("bpe", (ranks_path, pattern, len(lines.value)), lambda: Encoder(read_ranks(lines.value.splitlines()), pattern))
        yield from _in_slices(batches, "__text", True, [out], lambda rows: [encoder.encode_all(rows)])

    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(run, _with_binary(df, keep, [out]))


def decode(df: DataFrame, column: str, ranks_path: str, out: str = "decoded") -> DataFrame:
    """Adds binary ``out``: the bytes that the ids in ``column`` stand for.

    Null or empty ids give empty bytes. Rows, their number and the other
    columns are kept. Ids that the vocabulary lacks raise an error.
    """
    lines = _read(df, ranks_path)
    keep = [c for c in df.columns if c != out]

    def run(batches):
        decoder = Decoder(read_ranks(lines.value.splitlines()))
        yield from _in_slices(batches, column, False, [out], lambda rows: [decoder.decode_all(rows)])

    return df.select(*keep).mapInArrow(run, _with_binary(df, keep, [out]))


def round_trip(df: DataFrame, column: str, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded",
               cache_bytes: int | None = None) -> DataFrame:
    """``encode``, then ``decode`` of the ids, in one Python worker per task:
    text ``column`` becomes the binary columns ``ids`` and ``decoded``. Rows,
    nulls and other columns as there. ``cache_bytes`` bounds what a worker
    remembers, four times (``CACHE_BYTES`` by default); ids don't depend on it."""
    lines = _read(df, ranks_path)
    keep = [c for c in df.columns if c not in (column, ids, decoded)]

    def run(batches):
        def both():
            ranks = read_ranks(lines.value.splitlines())
            return Encoder(ranks, pattern, cache_bytes), Decoder(ranks)

        encoder, decoder = _stored("bpe_both", (ranks_path, pattern, len(lines.value), cache_bytes), both)

        def convert(rows):
            coded = encoder.encode_all(rows)
            return [coded, decoder.decode_all(coded)]

        yield from _in_slices(batches, "__text", True, [ids, decoded], convert)

    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(run, _with_binary(df, keep, [ids, decoded]))


def round_trip_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    coded = round_trip(documents.select("doc_id", "text"), "text", ranks_path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
