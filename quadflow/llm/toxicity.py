"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max
inverted indexes, distance-weighted votes, calibrated scores and evidence.

Terms are words and word beginnings. Every labelled text of a bounded sample is
an example with all its terms. Its vector has unit length; the terms that tell
label 1 (chosen on the sample) are weighted up to a fixed share of it, so that
a cosine is a weighted sum of those over telling and over other terms. The
index keeps, per term, the examples that hold it in blocks of falling weight
with each block's largest weight; the lists of frequent terms are rows with a
place per example and come first, in one product for many texts. Blocks are
taken by falling bound until no example not met can reach the nearest found;
what may still be among them gets its exact cosine, so the result is that of an
exhaustive search. A logistic curve, fitted on votes for examples left out of
the search, turns votes into scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.llm.arrow import release, text_slices, utf8
from quadflow.llm.sample import fold, labelled
from quadflow.llm.words import LOWER, U, mix, powers, words, BASE, BASE_INVERSE

PER_LABEL = 1500  # labelled documents indexed per class, at most
CALIBRATED = 300  # of them left out one by one for the calibration curve
TELLING = 2000  # telling terms, at most; all others are indexed too
TELLING_SHARE = 0.9  # of a vector's squared length
MIN_DOCS = 4  # label-1 texts that hold a telling term, at least
LIFT = 8  # a telling term is so many times as frequent in label 1, at least
SLACK = 1e-5  # over the rounding of the rows' single-precision weights
NEIGHBOURS = 15
BLOCK = 64
FREQUENT = 12  # lists of this part of the examples and more are kept as rows
STEP = 1024  # blocks taken before the first look, doubled each time
TOGETHER = 128  # texts whose frequent terms are scored at once, or whose weights are worked out at once
BEGINNINGS = (4, 5, 6)  # letters; bytes of UTF-8
THRESHOLD = 0.3


def _trim(data, starts, ends):
    """Word bounds without the punctuation around them (ASCII)."""
    punct = np.zeros(256, bool)
    punct[33:48] = punct[58:65] = punct[91:97] = punct[123:127] = True
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        some = starts < ends
        starts[some] += punct[data[starts[some]]]
        some = starts < ends
        ends[some] -= punct[data[ends[some] - 1]]
    return starts, ends


def terms(data: np.ndarray, offsets: np.ndarray):
    """(hash per term occurrence, text per occurrence)."""
    _, starts, ends, word_offsets = words(data, offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))
    starts, ends = _trim(data, starts, ends)
    run = np.zeros(len(data) + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * powers(BASE, len(data)), out=run[1:])
    inverse = powers(BASE_INVERSE, len(data) + 1)
    some = ends > starts
    starts, ends, text = starts[some], ends[some], text[some]
    out, owner = [mix((run[ends] - run[starts]) * inverse[starts])], [text]
    for n in BEGINNINGS:
        long = ends - starts > n
        out.append(mix((run[starts[long] + n] - run[starts[long]]) * inverse[starts[long]]))
        owner.append(text[long])
    return np.concatenate(out), np.concatenate(owner)


class Index:
    """Block-max inverted index over unit-length example vectors, given as
    (term, weight) lists one after the other with their bounds ``at``."""

    def __init__(self, model: dict):
        self.at, self.term, self.weight = model["at"], model["term"], model["weight"]
        self.labels, self.ids = model["labels"], model["ids"]
        n_terms = len(model["vocabulary"])
        size = np.bincount(self.term, minlength=n_terms)
        owner = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))
        frequent = np.flatnonzero(FREQUENT * size >= max(FREQUENT, len(self.at) - 1))
        self.row = np.full(n_terms, -1, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        dense = (self.row >= 0)[self.term]
        self.dense = np.zeros((len(frequent), len(self.at) - 1), np.float32)
        self.dense[self.row[self.term[dense]], owner[dense]] = self.weight[dense]
        size[frequent] = 0
        rest = np.flatnonzero(~dense)
        falling = self.weight[rest]
        np.negative(falling, out=falling)
        order = rest[np.lexsort((falling, self.term[rest]))]  # each term's examples, heaviest first, then by number
        self.example, self.impact = owner[order].astype(np.int64), self.weight[order]
        del owner, dense, rest, falling, order
        release()
        blocks = -(-size // BLOCK)
        self.first = np.r_[0, np.cumsum(blocks)]  # blocks of each term
        inside = spread(np.zeros(n_terms, np.int64), blocks)
        self.start = np.repeat(np.r_[0, np.cumsum(size)][:-1], blocks) + inside * BLOCK
        self.length = np.minimum(BLOCK, np.repeat(size, blocks) - inside * BLOCK)
        self.top = self.impact[self.start]
        self.query = np.zeros(n_terms)

    def begun(self, queries) -> np.ndarray:
        """What the frequent terms add to the cosine of every example, of some
        queries at once."""
        wide = np.zeros((len(queries), len(self.dense)), np.float32)
        for own, (term, weight) in zip(wide, queries):
            row = self.row[term]
            own[row[row >= 0]] = weight[row >= 0]
        return wide @ self.dense

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1, begun: np.ndarray | None = None):
        """The k examples of largest cosine above 0, ties to the smaller
        example number: [(cosine, example)]."""
        n = len(self.at) - 1
        if not n or not len(term):
            return []
        total = (self.begun([(term, weight)])[0] if begun is None else begun).astype(float)
        count = self.first[term + 1] - self.first[term]
        block, q = spread(self.first[term], count), np.repeat(weight, count)
        bound = q * self.top[block]
        ends = np.cumsum(count)[count > 0]
        after, closed = np.r_[bound[1:], 0.0][:len(bound)], np.zeros(len(bound))
        after[ends - 1] = 0.0  # the bound that stays when a block is done
        closed[ends - 1] = q[ends - 1] ** 2
        order = np.argsort(-bound, kind="stable")  # of equal bounds the earlier block of a list
        heads = bound[ends - count[count > 0]].sum()
        left = np.r_[heads, heads - np.cumsum((bound - after)[order])]
        far = np.r_[closed.sum(), closed.sum() - np.cumsum(closed[order])]  # squared length of the query in open lists
        done, step = 0, STEP
        while True:
            if skip >= 0:
                total[skip] = 0.0
            rest = max(0.0, min(float(left[done]), float(np.sqrt(max(0.0, far[done]))))) + SLACK
            floor = np.partition(total, n - k)[n - k] if n > k else 0.0
            if done == len(order) or rest < floor:  # an example not met yet stays under the sum of the next blocks' bounds
                near = np.flatnonzero((total > 0) & (total >= floor - rest))
                if done == len(order) or len(near) <= 2 * k:
                    break
            take = np.sort(order[done:done + step])  # in the order they lie in
            own = self.length[block[take]]
            post = spread(self.start[block[take]], own)
            total += np.bincount(self.example[post], self.impact[post] * np.repeat(q[take], own), minlength=n)
            done += len(take)
            step *= 2
        if not len(near):
            return []
        self.query[term] = weight
        parts = [slice(self.at[e], self.at[e + 1]) for e in near]
        cosine = np.round([self.weight[own] @ self.query[self.term[own]] for own in parts], 12)
        self.query[term] = 0.0
        best = np.lexsort((near, -cosine))[:k]
        return [(float(cosine[i]), int(near[i])) for i in best if cosine[i] > 0]

    def vote(self, near) -> float:
        """Share of label 1 among the nearest, weighted by squared cosine."""
        weight = np.array([c ** 2 for c, _ in near]) + 1e-9
        return min(1.0, float((weight @ np.array([self.labels[e] for _, e in near], float)) / weight.sum()))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + length, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def calibrated(model: dict, near, index: Index) -> float:
    """Score of a text by its nearest examples."""
    if not near:
        return model["prior"]
    slope, shift = model["curve"]
    return float(1 / (1 + np.exp(-np.clip(slope * index.vote(near) + shift, -30, 30)))) if slope else index.vote(near)


def curve(votes: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes to the chance of label
    1, the classes weighted to ``share``, targets drawn in by one count of
    each class, by Newton's steps. (0, 0): votes stand as they are, as they do
    where a label is missing or larger votes don't go with label 1."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 0.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    x, b = np.stack([votes, np.ones(len(y))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * b
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        b -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(b[0]), float(b[1])) if b[0] > 0 else (0.0, 0.0)


def _weights(term: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """TF-IDF weights of n texts' terms, each text's of unit length: the
    telling terms make up TELLING_SHARE of the squared length and the others
    the rest; a text without either has the whole length in the other."""
    w, tells = (1 + np.log(count)) * idf[term], telling[term]
    part = owner * 2 + tells
    square = np.bincount(part, w * w, minlength=2 * n)
    share = np.where(np.arange(2 * n) % 2 == 1, TELLING_SHARE, 1 - TELLING_SHARE)
    share[(square.reshape(n, 2)[:, ::-1].ravel()) == 0] = 1.0
    return w * np.sqrt(share / np.where(square > 0, square, 1))[part]


def _vectors(h: np.ndarray, text: np.ndarray, n: int, model: dict):
    """(term numbers, weights) of each of n texts, over the sample's terms."""
    vocabulary, size = model["vocabulary"], max(1, len(model["vocabulary"]))
    names, number = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, names), size - 1)
    hit = (vocabulary[at] == names if len(vocabulary) else np.zeros(len(names), bool))[number]
    at = at[number]
    key, count = np.unique(text[hit] * size + at[hit], return_counts=True)
    owner, term = np.divmod(key, size)
    weight = _weights(term, owner, count, n, model["idf"], model["telling"])
    cuts = np.searchsorted(owner, np.arange(n + 1))
    return [(term[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:])]


def _telling(names, df, y, rows) -> np.ndarray:
    """Terms that tell label 1: again and again the one most over chance
    among the label-1 texts that no chosen term is in yet, so that the other
    words of a family of copies don't get in beside the term that they share."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    toxic = [rows[i] for i in np.flatnonzero(y)]
    df1 = np.bincount(np.concatenate(toxic), minlength=len(names)) if toxic else np.zeros(len(names), np.int64)
    df0, left = df - df1, df1.copy()
    clean = (df0 + 0.5) / (n0 + 1)
    order = np.argsort(np.concatenate(toxic), kind="stable") if toxic else np.zeros(0, np.int64)
    holder = np.repeat(np.arange(len(toxic)), [len(t) for t in toxic])[order]
    cuts = np.searchsorted(np.concatenate(toxic)[order], np.arange(len(names) + 1)) if toxic else np.zeros(len(names) + 1, np.int64)
    covered = np.zeros(len(toxic), bool)
    chosen = []
    while len(chosen) < TELLING:
        expected = clean * max(1, n1)
        gain = np.where((left >= MIN_DOCS) & (df1 >= LIFT * expected), (left - expected) / np.sqrt(expected + 1), 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 0:
            break
        chosen.append(best)
        for t in holder[cuts[best]:cuts[best + 1]]:
            if not covered[t]:
                covered[t] = True
                left[toxic[t]] -= 1
    return np.sort(np.array(chosen, np.int64))


def fit(ids: list, y: np.ndarray, flat: np.ndarray, times: np.ndarray, offsets: np.ndarray, share: float | None = None) -> dict:
    """The model from each labelled text's distinct term hashes and their
    counts, all texts in one array: every text is an example with all its
    terms. ``share`` is that of label 1 among all labelled rows (by default
    the sample's)."""
    n = len(y)
    share = (float(y.mean()) if n else 0.0) if share is None else share
    names = np.unique(flat)
    number, df = np.empty(len(flat), np.int32), np.zeros(len(names), np.int64)
    some = [slice(lo, min(lo + TOGETHER, n)) for lo in range(0, n, TOGETHER)]  # a few texts at a time, as this runs on the driver
    parts = [slice(offsets[t.start], offsets[t.stop]) for t in some]
    for own in parts:
        number[own] = np.searchsorted(names, flat[own])
        np.add.at(df, number[own], 1)
    often = np.flatnonzero(df >= MIN_DOCS)  # others can't be telling
    place = np.full(len(names), -1, np.int32)
    place[often] = np.arange(len(often))
    kept = (place[number[a:b]] for a, b in zip(offsets, offsets[1:]))
    use = _telling(often, df[often], y, [r[r >= 0] for r in kept]) if len(often) else np.zeros(0, np.int64)
    telling = np.zeros(len(names), bool)
    telling[often[use]] = True
    idf = np.log((1 + n) / (1 + df)) + 0.1
    weight, plain = np.empty(len(number)), np.empty(n, bool)
    for texts, own in zip(some, parts):
        m = texts.stop - texts.start
        owner = np.repeat(np.arange(m), np.diff(offsets[texts.start:texts.stop + 1]))
        weight[own] = _weights(number[own], owner, times[own], m, idf, telling)
        plain[texts] = np.bincount(owner, telling[number[own]], minlength=m) == 0
    release()
    odds = np.where(y == 1, share / max(1, int(y.sum())), (1 - share) / max(1, int((1 - y).sum())))
    model = {"vocabulary": names, "idf": idf, "telling": telling, "at": np.asarray(offsets, np.int64), "term": number, "weight": weight,
             "labels": y, "ids": ids, "prior": float((odds * y)[plain].sum() / odds[plain].sum()) if odds[plain].sum() > 0 else share, "curve": (0.0, 0.0)}
    index, votes, own = Index(model), [], []
    for label in (0, 1):
        every = np.flatnonzero(y == label)
        for e in every[np.unique(np.linspace(0, len(every) - 1, CALIBRATED).astype(int))] if len(every) else ():
            part = slice(offsets[e], offsets[e + 1])
            if near := index.nearest(number[part], weight[part], NEIGHBOURS, skip=e):
                votes.append(index.vote(near))
                own.append(label)
    return model | {"curve": curve(np.array(votes), np.array(own, np.int64), share)}


def train(rows: DataFrame, share: float | None = None) -> dict:
    """Fits on rows of (doc_id, text, label), a bounded sample such as
    ``sample.labelled`` draws. ``share``: see ``fit``."""
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("label").alias("__label"))

    def run(batches):
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                h, owner = terms(data, off)
                order = np.argsort(owner, kind="stable")
                h, cuts = h[order], np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                own = [np.unique(h[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").cast(pa.int64()), part.column("__label"), pa.array([s.tobytes() for s, _ in own], pa.binary()),
                     pa.array([c.astype("<i4").tobytes() for _, c in own], pa.binary())], names=["id", "label", "terms", "counts"])

    got = rows.mapInArrow(run, "id long, label int, terms binary, counts binary").toArrow()
    got = got.take(pa.compute.sort_indices(got.select(["id", "label"]), [("id", "ascending"), ("label", "ascending")])).combine_chunks()
    release()
    raw, at = utf8(got.column("terms"))
    model = fit(got.column("id").to_pylist(), np.array(got.column("label").to_pylist(), np.int64),
                raw.view(U), utf8(got.column("counts"))[0].view("<i4"), at // 8, share)
    del got, raw
    release()
    return model


def score(docs: DataFrame, text: str, model: dict, out: str = "score", evidence: str = "evidence", whole: bool = False) -> DataFrame:
    """Adds the score of each whole text (0 to 1) and its evidence, the ids of
    its nearest examples, nearest first.

    Null and empty texts, and texts without a term of any example, have no
    neighbours and get the share of label 1 among texts without telling terms.
    Every row is kept; the text column is dropped unless ``whole`` is set,
    others pass through; columns named ``out`` or ``evidence`` are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text, out, evidence)]
    back = ["__text"] if whole else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in back] + [T.StructField(out, T.DoubleType()), T.StructField(evidence, T.ArrayType(T.LongType()))])

    def run(batches):
        m = shared.value
        index = Index(m)
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                h, owner = terms(data, off)
                values, near_ids = [], []
                queries = _vectors(h, owner, part.num_rows, m)
                for lo in range(0, len(queries), TOGETHER):
                    some = queries[lo:lo + TOGETHER]
                    for (t, w), begun in zip(some, index.begun(some)):
                        near = index.nearest(t, w, NEIGHBOURS, begun=begun)
                        values.append(calibrated(m, near, index))
                        near_ids.append([index.ids[e] for _, e in near])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep + back), pa.array(values, pa.float64()), pa.array(near_ids, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema).withColumnRenamed("__text", text)


def fitted(documents: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> dict:
    """The model learned from the documents outside the held-out fold."""
    known = labels.filter(fold("doc_id", folds) != held_out)
    share = known.filter(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    return train(labelled(documents, known, "toxic", PER_LABEL), share)


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not rejected, each by its own text."""
    scored = score(documents, "text", fitted(documents, labels), "__score", "__evidence", whole=True)
    return scored.filter(F.col("__score") < THRESHOLD).select(*documents.columns)


def judge(documents: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Learns ``labels.toxic`` from the documents outside the held-out fold
    and scores all documents. A null doc_id is in no fold: held_out is false."""
    mod = fold("doc_id", folds)
    model = fitted(documents, labels, held_out, folds)
    rows = documents.select("doc_id", F.coalesce(mod == held_out, F.lit(False)).alias("held_out"), "text")
    return score(rows, "text", model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
