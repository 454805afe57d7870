"""N-gram Jaccard join by vertical partitioning.

A document is its set of word shingles. The sets are never compared whole:
a global n-gram order is cut into fragments, each fragment holds its slice of
every set, partial overlaps are counted fragment by fragment and summed per
pair. Three passes keep the work near the number of real links:

1. In hash order, every set gives its first shingles. A pair that links must
   share a known number of them (``_needed``), so a set with fewer shared ones
   links to nothing and is done. Shingles that many sets of a batch hold
   travel once, whatever their number.
2. The remaining sets are cut into fragments again; each fragment counts its
   document frequencies. In the order (frequency, hash) each set gives its
   prefix; sets that share a prefix shingle may link. Size, position and a
   256-bit parity signature (a lower bound of the symmetric difference) drop
   pairs that cannot.
3. Pairs are verified by summed partial overlaps, in the fragments that both
   sets reach; before, the marks of both sets (4,096 parity bits, and the
   number of shingles that no other set holds) rule out nearly all pairs that
   don't link, which spares the partial overlaps of near misses within large
   groups of near copies, and of the pairs left a few per set come first: the
   others are verified only if their sets are still apart then, so the partial
   overlaps follow the sets of a group of near copies, not its links. The
   first round tries each set with one other set per smallest shingle (sets that link mostly
   share one of the ``STARS`` smallest hashes) and joins what links into
   components; the second tries, per prefix shingle, each set with the middle
   one and with ``SHIFTS`` others picked by hash, where their components
   differ; the third tries every remaining pair of a prefix shingle between different
   components, so that no link is lost and a group of copies is never
   expanded into all its pairs. Groups of more than ``BLOCK`` sets are cut
   into block pairs.

Equal sets are one node all along. Sets and shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.llm.arrow import release, text_slices
from quadflow.llm.graph import components
from quadflow.llm.words import mix, shingles, words
from quadflow.session import cut_lineage

SIZE = 5
PERCENT = 75
EXTRA = 15  # percent of a set by which pass 1 lengthens the prefix
FRAGMENT_ENTRIES = 1_000_000  # shingles that one fragment is planned to hold
FLUSH_ENTRIES = 500_000  # shingles that a task holds before it sends them on
STARS = 4  # smallest shared shingles of a set that give it a partner in the first round
SHIFTS = (1, 2, 4, 8)  # places in a prefix shingle's hash order from a set to its partners in the second round
BLOCK = 2048
PICKS = 2  # pairs of a set, to smaller and to larger ids each, that are verified before the others
PAIR_BLOCK = 2_000_000  # pairs that one verification task is planned to hold
PAIR_SLICE = 100_000  # pairs that are Python integers at a time
SIGNATURE_BITS = 12  # a set's mark has 2^12 parity bits
HOT = 1024  # sets that one task pairs with the first set of a shingle
MAX_BITS = 27  # the survivors' bitmap has at most 2^27 bits (16 MB)


def _ceil(a, b):
    return -(-a // b)


def _set_id(own: np.ndarray) -> int:
    total = mix(own + np.uint64(0x632BE59BD9B4E019)).sum() + np.uint64(len(own))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(batch, size):
    """(row of the batch slice, slice, sorted distinct shingles) per row."""
    for part, data, off in text_slices(batch, "__text"):
        hashes, _, _, word_offsets = words(data, off)
        all_shingles, at = shingles(hashes, word_offsets, size)
        for i in range(part.num_rows):
            yield i, part, np.unique(all_shingles[at[i]:at[i + 1]])


def _first_schema():
    return "fragment int, hashes binary, owner binary, sets binary, docs binary"


def _fragment_of(h: np.ndarray, count: int, reach: int) -> np.ndarray:
    """Contiguous ranges of the hash order; ``reach`` percent of it is cut
    evenly, the rest goes to the last range."""
    return np.minimum((h >> np.uint64(32)).astype(np.int64) * count * 100 // (reach << 32), count - 1)


def _first_pass(count: int, size: int, percent: int):
    """Kernel of pass 1: prefixes in hash order, dealt out by fragment."""
    reach = min(100, 100 - percent + EXTRA + 2)

    def flush(docs, local, hashes, owners):
        sets = np.fromiter(local, np.int64, len(local))
        shared = np.zeros(len(sets), np.int64)
        pieces = {}
        if hashes:
            h, s = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, s = h[order], s[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            length = np.diff(np.r_[start, len(h)])
            many = np.repeat(length > 1, length)
            shared = np.bincount(s[many], minlength=len(sets))
            h, s = h[start], np.where(length > 1, -1, s[start])  # -1: held by several sets here, all counted here
            f = _fragment_of(h, count, reach)
            cuts = np.searchsorted(f, np.arange(count + 1))
            for k in range(count):
                a, b = cuts[k], cuts[k + 1]
                if b > a:
                    used, place = np.unique(s[a:b], return_inverse=True)
                    ids = np.where(used >= 0, sets[np.maximum(used, 0)], 0)
                    pieces[k] = (h[a:b].tobytes(), place.astype(np.uint32).tobytes(), np.stack([ids, used >= 0], 1).astype(np.int64).tobytes())
        rows = np.array(docs, np.int64).reshape(-1, 5)
        first = set()
        for r in rows:
            at = local.get(int(r[2]), -1) if r[3] else -1
            if at >= 0 and at not in first:  # a set's local count travels once
                first.add(at)
                r[4] = shared[at]
        out = []
        for k in range(count):
            own = rows[k::count]
            if k in pieces or len(own):
                out.append((k, *pieces.get(k, (b"", b"", b"")), own.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))],
                                          names=["fragment", "hashes", "owner", "sets", "docs"])

    def run(batches):
        docs, local, hashes, owners, held = [], {}, [], [], 0
        for batch in batches:
            ids = None
            for i, part, own in _sets(batch, size):
                if i == 0:
                    ids = part.column("__id").to_pylist()
                n = len(own)
                key = _set_id(own) if n else 0
                docs.append((ids[i] is not None, ids[i] or 0, key, n, 0))
                if n and key not in local:
                    prefix = own[:n - _ceil(percent * n, 100) + _ceil(EXTRA * n, 100)]
                    hashes.append(prefix)
                    owners.append(np.full(len(prefix), len(local), np.int64))
                    local[key] = len(local)
                    held += len(prefix)
                if held >= FLUSH_ENTRIES or len(docs) >= 50_000:
                    yield flush(docs, local, hashes, owners)
                    docs, local, hashes, owners, held = [], {}, [], [], 0
        if docs:
            yield flush(docs, local, hashes, owners)

    return run


def _number(places: list, tables: list):
    """(distinct set ids, number of its set per entry) from each batch's own
    numbering; -1 where an entry stands for several sets."""
    every = np.concatenate(tables)
    real = every[:, 1] != 0
    names, place = np.unique(every[real, 0], return_inverse=True)
    number = np.full(len(every), -1, np.int32)
    number[real] = place
    base = np.cumsum([0, *map(len, tables[:-1])])
    return names, np.concatenate([number[b + p] for b, p in zip(base, places)])


INFO = "doc_id long, sid long, n long, shared long, bucket int, counts binary"


def _count_shared(buckets: int):
    return lambda table: _shared_of(table, buckets)


def _shared_of(table: pa.Table, buckets: int) -> pa.Table:
    """Reducer of pass 1 for one fragment: the documents that came with it,
    and per set how many of its shingles here other sets hold too; these
    partial counts are packed, one row per bucket of set ids."""
    hashes, places, tables, docs = [], [], [], []
    for h, o, s, d in zip(*(table.column(c) for c in ("hashes", "owner", "sets", "docs"))):
        docs.append(np.frombuffer(d.as_buffer(), np.int64).reshape(-1, 5))
        if len(h.as_buffer()):
            hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
            places.append(np.frombuffer(o.as_buffer(), np.uint32).astype(np.int32))
            tables.append(np.frombuffer(s.as_buffer(), np.int64).reshape(-1, 2))
    doc = np.concatenate(docs) if docs else np.zeros((0, 5), np.int64)
    sets, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if hashes:
        names, owners = _number(places, tables)
        h = np.concatenate(hashes)
        order = np.lexsort((owners, h))
        h, owners = h[order], owners[order]
        new = np.r_[True, h[1:] != h[:-1]]
        fresh = np.r_[True, new[1:] | (owners[1:] != owners[:-1])]
        run = (np.cumsum(new) - 1).astype(np.int32)
        shared = (np.bincount(run[fresh]) > 1) | (owners[new] < 0)
        counts = np.bincount(owners[shared[run] & (owners >= 0) & fresh], minlength=len(names))
        sets, counts = names[counts > 0], counts[counts > 0]
    known = doc[:, 0] == 1
    home = sets % buckets
    order = np.argsort(home, kind="stable")
    used, start = np.unique(home[order], return_index=True)
    packed = [np.stack([sets[own], counts[own]]).tobytes() for own in np.split(order, start[1:])] if len(sets) else []
    d, p = len(doc), len(packed)
    release()
    return pa.table({
        "doc_id": pa.concat_arrays([pa.array(doc[:, 1], pa.int64(), mask=~known), pa.nulls(p, pa.int64())]),
        **{c: pa.concat_arrays([pa.array(doc[:, k], pa.int64()), pa.nulls(p, pa.int64())]) for c, k in (("sid", 2), ("n", 3), ("shared", 4))},
        "bucket": pa.concat_arrays([pa.nulls(d, pa.int32()), pa.array(used[:p], pa.int32())]),
        "counts": pa.concat_arrays([pa.nulls(d, pa.binary()), pa.array(packed, pa.binary())]),
    })


def _sum_counts(table: pa.Table) -> pa.Table:
    """Sums the partial counts of one bucket of set ids."""
    parts = [np.frombuffer(c.as_buffer(), np.int64).reshape(2, -1) for c in table.column("counts")]
    every = np.concatenate(parts, axis=1)
    sids, place = np.unique(every[0], return_inverse=True)
    total = np.zeros(len(sids), np.int64)
    np.add.at(total, place, every[1])
    release()
    return pa.table({"sid": pa.array(sids, pa.int64()), "shared": pa.array(total, pa.int64())})


def _needed(n, percent: int):
    """Shingles of its lengthened prefix that a set of n must share to link."""
    return F.ceil(F.lit(EXTRA) * F.ceil(F.lit(percent) * n / 100) / 100)


def _bitmap(survivors: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the surviving sets' ids, of a fixed largest size; sets that
    it lets through by chance do no harm."""
    bits = min(MAX_BITS, max(16, (16 * count).bit_length()))
    slot = F.pmod("sid", F.lit(1 << bits))
    words_ = survivors.select((slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(sid, {1 << bits}L) % 64 as int))").alias("bit"))
    got = words_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _second_pass(bitmap, count: int, size: int):
    """Kernel of pass 2: whole sets of the survivors, dealt out by fragment."""

    def flush(local, sizes, hashes, owners):
        sets, ns = np.fromiter(local, np.int64, len(local)), np.array(sizes, np.int64)
        h, s = np.concatenate(hashes), np.concatenate(owners)
        f = _fragment_of(h, count, 100)
        out = []
        for k in range(count):
            here = f == k
            if here.any():
                used, place = np.unique(s[here], return_inverse=True)
                out.append((k, h[here].tobytes(), place.astype(np.uint32).tobytes(), np.stack([sets[used], ns[used]], 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))],
                                          names=["fragment", "hashes", "owner", "sets"])

    def run(batches):
        bits = bitmap.value
        mask = len(bits) * 64 - 1
        local, sizes, hashes, owners, held = {}, [], [], [], 0
        for batch in batches:
            for _, _, own in _sets(batch, size):
                if not len(own):
                    continue
                key = _set_id(own)
                slot = key & mask
                if key in local or not (int(bits[slot >> 6]) >> (slot & 63)) & 1:
                    continue
                hashes.append(own)
                owners.append(np.full(len(own), len(local), np.int64))
                local[key] = len(local)
                sizes.append(len(own))
                held += len(own)
                if held >= FLUSH_ENTRIES:
                    yield flush(local, sizes, hashes, owners)
                    local, sizes, hashes, owners, held = {}, [], [], [], 0
        if held:
            yield flush(local, sizes, hashes, owners)

    return run


SEGMENTS = "fragment int, sid long, n long, hashes binary, frequency binary, signature binary"


def _segments(table: pa.Table) -> pa.Table:
    """Reducer of pass 2 for one fragment: per set its shingles here that
    other sets hold too, their document frequencies, and the parity
    signature of all its shingles here."""
    hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
    places = [np.frombuffer(o.as_buffer(), np.uint32) for o in table.column("owner")]
    tables = [np.frombuffer(t.as_buffer(), np.int64).reshape(-1, 2) for t in table.column("sets")]
    sids, s = _number(places, tables)  # a set has a shingle at least, so its size is never 0
    every = np.concatenate(tables)
    ns = np.zeros(len(sids), np.int64)
    ns[np.searchsorted(sids, every[:, 0])] = every[:, 1]
    h = np.concatenate(hashes)
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]
    h, s = h[fresh], s[fresh]
    new = np.r_[True, h[1:] != h[:-1]]
    frequency = np.diff(np.r_[np.flatnonzero(new), len(h)])[np.cumsum(new) - 1]
    order = np.argsort(s, kind="stable")  # by set, then hash
    h, s, frequency = h[order], s[order], frequency[order].astype(np.uint32)
    cuts = np.searchsorted(s, np.arange(len(sids) + 1))
    rows = []
    for i in range(len(sids)):
        a, b = cuts[i], cuts[i + 1]
        parity = np.bincount((mix(h[a:b]) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
        shared = frequency[a:b] > 1
        rows.append((h[a:b][shared].tobytes(), frequency[a:b][shared].tobytes(), np.packbits(parity.astype(np.uint8)).tobytes()))
    hs, fs, gs = zip(*rows)
    release()
    return pa.table({"fragment": pa.array([table.column("fragment")[0].as_py()] * len(sids), pa.int32()), "sid": pa.array(sids, pa.int64()),
                     "n": pa.array(ns, pa.int64()), "hashes": pa.array(hs, pa.binary()),
                     "frequency": pa.array(fs, pa.binary()), "signature": pa.array(gs, pa.binary())})


PREFIX = "shingle long, frequency int, sid long, n long, position long, signature binary"


def _prefixes(percent: int):
    """Kernel: a set's prefix in the order (frequency, hash), shared shingles
    only. Sets that share too few shingles give nothing."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for sid, n, parts in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "parts"))):
                h = np.concatenate([np.frombuffer(p["hashes"], np.uint64) for p in parts])
                df = np.concatenate([np.frombuffer(p["frequency"], np.uint32) for p in parts])
                alone, least = n - len(h), _ceil(percent * n, 100)
                take = n - least + 1 - alone
                if take <= 0:
                    continue
                sign = np.bitwise_xor.reduce([np.frombuffer(p["signature"], np.uint64) for p in parts]).tobytes()
                order = np.lexsort((h, df))[:take]
                k = len(order)
                for c, v in zip(cols, (h[order].view(np.int64), df[order].astype(np.int32), np.full(k, sid), np.full(k, n), alone + np.arange(k))):
                    c.append(v)
                cols[5] += [sign] * k
            if cols[5]:
                arrays = [pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[5], pa.binary())], names=["shingle", "frequency", "sid", "n", "position", "signature"])

    return run


MARKS = "sid long, n long, alone long, fragments array<int>, signature binary, smallest array<long>, frequency array<int>"


def _marks(batches):
    """Kernel: per set the shingles that no other set holds (their number), the
    fragments of the others, their parity signature, and the smallest of them
    with their frequencies."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    for batch in batches:
        rows = []
        for sid, n, parts in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "parts"))):
            h = np.concatenate([np.frombuffer(p["hashes"], np.uint64) for p in parts])
            df = np.concatenate([np.frombuffer(p["frequency"], np.uint32) for p in parts])
            parity = np.bincount((mix(h) >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64), minlength=1 << SIGNATURE_BITS) & 1
            first = np.argsort(h)[:STARS]
            rows.append((sid, n, n - len(h), [p["fragment"] for p in parts if p["hashes"]], np.packbits(parity.astype(np.uint8)).tobytes(),
                         h[first].view(np.int64).tolist(), df[first].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[k.split()[0] for k in MARKS.split(", ")])


def _near(percent: int):
    """Kernel over pairs with the marks of both sets: those that may link.
    Shingles that one set alone holds are in the symmetric difference, and so
    is at least one per differing bit of the parities of the others."""

    def run(batches):
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            nx, ny = number("nx"), number("ny")
            words_ = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(nx), -1) for c in ("sx", "sy")]
            apart = number("ax") + number("ay") + np.bitwise_count(words_[0] ^ words_[1]).sum(axis=1)
            least = _ceil(percent * (nx + ny), 100 + percent)
            yield batch.select(["x", "y", "nx", "ny", "fragments"]).filter(pa.array(apart <= nx + ny - 2 * least))

    return run


PAIRS = "x long, y long, nx long, ny long"


def _may_link(a, b, n, position, sign, percent: int) -> np.ndarray:
    """Which of the index pairs (a, b) can link, seen from one shared shingle:
    by size, by position and by signature."""
    na, nb = n[a], n[b]
    least = _ceil(percent * (na + nb), 100 + percent)
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - position[a], nb - position[b]) >= least)
    ok[ok] = np.bitwise_count(sign[a[ok]] ^ sign[b[ok]]).sum(axis=1) <= (na + nb - 2 * least)[ok]
    return ok


def _candidates(whole: bool, percent: int):
    """Kernel over rows sorted by group (shingle and block pair): pairs of
    different components; of each row with the middle row and a few picked
    by hash, or (``whole``) all."""

    def pairs_of(sid, n, position, sign, component, start, end):
        for s, e in zip(start, end):
            if component[s:e].min() == component[s:e].max():
                continue
            step = max(1, 500_000 // (e - s))
            for lo in range(s, e - 1, step):
                rows = np.arange(lo, min(lo + step, e - 1))
                a = np.repeat(rows, e - 1 - rows)
                if len(a):
                    b = np.concatenate([np.arange(r + 1, e) for r in rows])
                    use = component[a] != component[b]
                    yield a[use], b[use]

    def emit(cols, cut):
        """Pairs of the complete groups, rows [0, cut)."""
        key, sid, n, position, sign, component = (c[:cut] for c in cols)
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        end = np.r_[start[1:], cut]
        big = end - start > 1
        start, end = start[big], end[big]
        if not len(start):
            return None
        if whole:
            parts = pairs_of(sid, n, position, sign, component, start, end)
        else:
            rows = np.concatenate([np.arange(s, e) for s, e in zip(start, end)])
            group = np.repeat(np.arange(len(start)), end - start)
            order = rows[np.lexsort((mix(sid[rows].view(np.uint64) ^ mix(key[rows, 0].view(np.uint64))), group))]
            parts = [(rows, ((start + end) // 2)[group])]
            for k in SHIFTS:
                same = group[:-k] == group[k:]
                parts.append((order[:-k][same], order[k:][same]))
            parts = [(a[component[a] != component[b]], b[component[a] != component[b]]) for a, b in parts]
        found = []
        for a, b in parts:
            ok = _may_link(a, b, n, position, sign, percent) & (sid[a] != sid[b])
            a, b = a[ok], b[ok]
            if len(a):
                swap = sid[a] > sid[b]
                x, y = np.where(swap, b, a), np.where(swap, a, b)
                found.append(np.unique(np.stack([sid[x], sid[y], n[x], n[y]], 1), axis=0))
        if not found:
            return None
        got = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, k], pa.int64()) for k in range(4)], names=["x", "y", "nx", "ny"])

    def run(batches):
        held = None
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            cols = [np.stack([number("shingle"), number("low"), number("high")], 1), number("sid"), number("n"), number("position"),
                    np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(-1, 4), number("component")]
            if held:
                cols = [np.concatenate(p) for p in zip(held, cols)]
            cut = int(np.flatnonzero((cols[0] != cols[0][-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                out = emit(cols, cut)
                if out is not None:
                    yield out
            held = [c[cut:] for c in cols]
        if held:
            out = emit(held, len(held[0]))
            if out is not None:
                yield out

    return run


def _overlaps(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial overlaps of a block of pairs in one fragment."""
    parts = {s: np.frombuffer(h, np.uint64) for s, h in zip(left.column("sid").to_pylist(), left.column("hashes").to_pylist())}
    none = np.zeros(0, np.uint64)
    right, found = right.select(["x", "y", "nx", "ny"]), []
    for lo in range(0, len(right), PAIR_SLICE):
        own = right.slice(lo, PAIR_SLICE)
        counts = [len(np.intersect1d(parts.get(a, none), parts.get(b, none), assume_unique=True))
                  for a, b in zip(own.column("x").to_pylist(), own.column("y").to_pylist())]
        own = own.append_column("overlap", pa.array(counts, pa.int64()))
        found.append(own.filter(pa.compute.greater(own.column("overlap"), 0)))
    release()
    return pa.concat_tables(found) if found else right.append_column("overlap", pa.array([], pa.int64()))


def _plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that the marks don't rule out, with the fragments that both
    sets reach."""
    one, two = (marks.select(F.col("sid").alias(v), F.col("alone").alias(f"a{v}"), F.col("signature").alias(f"s{v}"), F.col("fragments").alias(f"f{v}")) for v in "xy")
    known = pairs.distinct().join(one, "x").join(two, "y").withColumn("fragments", F.array_intersect("fx", "fy"))
    kept = known.select("x", "y", "nx", "ny", "ax", "ay", "sx", "sy", "fragments").mapInArrow(_near(percent), PAIRS + ", fragments array<int>")
    return cut_lineage(kept)


def _picked(kept: DataFrame) -> DataFrame:
    """(x, y) of a few pairs of every set, picked by hash: random ones connect
    nearly all that the pairs connect, whatever their number."""
    draws = [F.min(F.struct(F.xxhash64("x", "y", F.lit(k)).alias("by"), "x", "y")) for k in range(PICKS)]
    some = [kept.groupBy(F.col(c).alias("sid")).agg(F.array(*draws).alias("pairs")).select(F.explode("pairs").alias("p")) for c in "xy"]
    return some[0].union(some[1]).select("p.x", "p.y").distinct()


def _verified(kept: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs whose partial overlaps sum up to a link. Each pair meets the
    fragments that both its sets reach, and no others."""
    blocks = kept.count() // PAIR_BLOCK + 1
    right = kept.select("x", "y", "nx", "ny", F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int").alias("block"), F.explode("fragments").alias("fragment"))
    asked = right.select("fragment", "block", F.explode(F.array("x", "y")).alias("sid")).distinct()
    left = segments.select("fragment", "sid", "hashes").join(asked, ["fragment", "sid"]).select(*[F.col(c).alias(c) for c in ("fragment", "block", "sid", "hashes")])
    part = (left.groupBy("fragment", "block").cogroup(right.groupBy("fragment", "block"))
            .applyInArrow(_overlaps, PAIRS + ", overlap long"))
    total = part.groupBy("x", "y", "nx", "ny").agg(F.sum("overlap").alias("o"))
    return total.filter(100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o"))).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _joined(near: DataFrame, found: DataFrame) -> DataFrame:
    return components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found))


def _apart(kept: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    one, two = (near.select(F.col("node").alias(v), F.col("component").alias(f"c{v}")) for v in "xy")
    return kept.join(one, "x", "left").join(two, "y", "left").filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select(kept.columns)


def _stars(marks: DataFrame, percent: int) -> DataFrame:
    """Each set with the first set that holds one of its smallest shingles; the
    sets of a frequent shingle are spread over several tasks."""
    small = marks.select("sid", "n", F.explode(F.arrays_zip(F.col("smallest").alias("shingle"), "frequency")).alias("s"))
    salts = F.ceil(F.col("s.frequency") / HOT)
    small = cut_lineage(small.select("sid", "n", "s.shingle", salts.alias("salts"), F.pmod("sid", salts).alias("salt")))
    some = small.groupBy("shingle", "salts", "salt").agg(F.min(F.struct("sid", "n")).alias("c"))
    centre = some.groupBy("shingle", "salts").agg(F.min("c").alias("c"))
    spread = centre.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return (small.join(spread, ["shingle", "salt"]).select(F.col("c.sid").alias("x"), F.col("sid").alias("y"), F.col("c.n").alias("nx"), F.col("n").alias("ny"))
            .filter((F.col("x") != F.col("y")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))))


def linked(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id (the integer ``ident``), n_shingles and
    component_id, the smallest doc_id that links reach.

    Two rows link when percent of the union of their shingle sets is shared:
    100 * intersection >= percent * union. Rows with fewer than ``size`` words
    have one shingle, their whole sequence; null texts and texts without words
    have none and are their own component. A null id takes part in linking, is
    never a component_id, and its own component_id is null if its component
    holds null ids alone. Repeated rows all come back; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(ident).cast("long").alias("__id"), F.col(text).alias("__text"))
    volume = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    count = max(4, _ceil(volume // 14, FRAGMENT_ENTRIES))  # a word in six bytes, two words in five not in the prefix
    first = rows.mapInArrow(_first_pass(count, size, percent), _first_schema())
    info = cut_lineage(first.groupBy("fragment").applyInArrow(_count_shared(count), INFO))
    documents = info.filter("n is not null").select("doc_id", "sid", "n")
    counts = info.filter("bucket is not null").select("bucket", "counts").groupBy("bucket").applyInArrow(_sum_counts, "sid long, shared long")
    known = info.filter("n is not null").select("doc_id", "sid", "n", "shared").unionByName(counts, allowMissingColumns=True)
    sets = known.groupBy("sid").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.min("doc_id").alias("doc_id"))
    sets = sets.filter("n > 0")
    survivors = sets.filter(F.col("shared") >= _needed(F.col("n"), percent))
    stats = survivors.agg(F.count("*"), F.sum("n")).first()
    if not stats[0]:
        return _result(documents, sets.select("sid", F.col("sid").alias("component"), "doc_id"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(survivors, stats[0]))
    count = max(8, _ceil(stats[1], FRAGMENT_ENTRIES))
    dealt = rows.mapInArrow(_second_pass(bitmap, count, size), "fragment int, hashes binary, owner binary, sets binary")
    segments = cut_lineage(dealt.groupBy("fragment").applyInArrow(_segments, SEGMENTS))
    gathered = segments.groupBy("sid", "n").agg(F.collect_list(F.struct("fragment", "hashes", "frequency", "signature")).alias("parts"))
    prefixes = gathered.mapInArrow(_prefixes(percent), PREFIX)
    blocks = F.ceil(F.col("frequency") / BLOCK).cast("int")
    own = F.pmod("sid", blocks).cast("int")
    grouped = (prefixes.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
               .withColumn("low", F.least(own, "other")).withColumn("high", F.greatest(own, "other")))

    def candidates(near, whole):
        rows = grouped.join(near.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        spread = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "n", "sid")
        return spread.select("shingle", "low", "high", "sid", "n", "position", "signature", "component").mapInArrow(_candidates(whole, percent), PAIRS)

    marks = cut_lineage(gathered.mapInArrow(_marks, MARKS))
    near = components(_verified(_plausible(_stars(marks, percent), marks, percent), segments, percent))
    for every in (False, True):
        kept = _plausible(candidates(near, every), marks, percent)
        picked = cut_lineage(kept.join(_picked(kept), ["x", "y"], "left_semi"))
        near = _joined(near, _verified(picked, segments, percent))
        rest = cut_lineage(_apart(kept.join(picked, ["x", "y"], "left_anti"), near))
        if not rest.isEmpty():
            near = _joined(near, _verified(rest, segments, percent))
    named = sets.join(near.withColumnRenamed("node", "sid"), "sid", "left")
    return _result(documents, named.select("sid", F.coalesce("component", "sid").alias("component"), "doc_id"))


def _result(documents: DataFrame, named: DataFrame) -> DataFrame:
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.select("sid", "component").join(least, "component").select("sid", "component_id")
    out = documents.withColumn("sid", F.when(F.col("n") > 0, F.col("sid"))).join(names, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
