"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: hashed word unigrams, and n-grams of the
text's shape (letters folded to two signs by case, digits to one, runs cut,
a word that repeats the one before it a sign of its own), each shape n-gram
with an indicator for every share of the text that it reaches. Indicators are
scaled by their class log-count ratio; a linear hinge-loss model is fitted to
the scaled, unit-length rows by dual coordinate descent, and a logistic curve,
fitted on rows that the model has not seen, turns margins into scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.llm.arrow import text_slices
from quadflow.llm.sample import fold, labelled
from quadflow.llm.words import LOWER, mix, words

WORD_BUCKETS = 1 << 17
SHAPE_BUCKETS = 1 << 15
LEVELS = (0.0, 0.004, 0.03)  # shares of a text's shape n-grams
SHAPE_ORDERS = (1, 2, 3, 4)
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS * len(LEVELS)
PER_LABEL = 3000  # labelled documents fitted per class, at most
EPOCHS = 12
COST = 1.0
THRESHOLD = 0.5

SIGNS = LOWER.copy()
SIGNS[97:123] = 97
SIGNS[65:91] = 65
SIGNS[48:58] = 48
SIGNS[128:] = 97
SIGNS[[9, 11, 12, 13]] = 32
REPEAT = 1


def _shape(data: np.ndarray, offsets: np.ndarray, hashes, starts, ends, word_offsets):
    """The shape signs of all texts and their offsets."""
    signs = SIGNS[data]
    upper = (data >= 65) & (data <= 90)
    signs[upper] = 65
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        same = (signs[1:] == signs[:-1]) & np.isin(signs[1:], (97, 65, 48, 32))
        keep[1:] = ~same
        keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    if len(hashes) > 1:
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        first = np.isin(again, word_offsets)
        again = again[~first]
        if len(again):
            inside = np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, starts[again], 1)
            np.add.at(inside, ends[again], -1)
            covered = np.cumsum(inside[:-1]) > 0
            keep[covered] = False
            keep[starts[again]] = True
            signs[starts[again]] = REPEAT
    place = np.concatenate([[0], np.cumsum(keep)])
    return signs[keep], place[offsets]


def indicators(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct indicator numbers of each text; a text without
    bytes has none."""
    hashes, starts, ends, word_offsets = words(data, offsets)
    own = (mix(hashes) >> np.uint64(47)).astype(np.int64)
    signs, sign_offsets = _shape(data, offsets, hashes, starts, ends, word_offsets)
    shapes = []
    code = np.zeros(len(signs), np.uint64)
    for n in range(1, max(SHAPE_ORDERS) + 1):
        code = code[:len(signs) - n + 1] * np.uint64(257) + signs[n - 1:].astype(np.uint64) + np.uint64(1)
        shapes.append((mix(code + np.uint64(n)) >> np.uint64(49)).astype(np.int64))
    out = []
    for i in range(len(offsets) - 1):
        a, b = sign_offsets[i], sign_offsets[i + 1]
        got = [np.unique(own[word_offsets[i]:word_offsets[i + 1]])]
        if b > a:
            all_grams = np.concatenate([s[a:max(a, b - n)] for n, s in enumerate(shapes)])
            count = np.bincount(all_grams, minlength=SHAPE_BUCKETS)
            there = np.flatnonzero(count)
            share = count[there] / (b - a)
            got += [WORD_BUCKETS + k * SHAPE_BUCKETS + there[share >= level] for k, level in enumerate(LEVELS)]
        out.append(np.concatenate(got))
    return out


def _descend(rows, y, ratio, cost, epochs, seed=7):
    """Weights and bias of the hinge-loss model, by dual coordinate descent;
    the cost of each class is scaled to equal weight."""
    w, bias = np.zeros(len(ratio)), 0.0
    scaled = []
    for idx in rows:
        v = ratio[idx]
        norm = np.sqrt(v @ v)
        scaled.append(v / norm if norm else v)
    alpha = np.zeros(len(rows))
    size = np.array([v @ v + 1 for v in scaled])
    bound = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rnd.permutation(len(rows)):
            idx, v = rows[i], scaled[i]
            gradient = y[i] * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[idx] += step * v
                bias += step
    return w, bias


def _margin(idx, ratio, w, bias):
    v = ratio[idx]
    norm = np.sqrt(v @ v)
    return float(w[idx] @ v / norm + bias) if norm else float(bias)


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """The model from indicator rows and labels in {0, 1}. With one class, or
    none, every score is that class's share (0.5 without any row)."""
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    sign = np.where(y == 1, 1.0, -1.0)
    part = np.arange(len(rows)) % 4 == 3
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part = np.zeros(len(rows), bool)

    def model(use):
        counts = {s: np.ones(BUCKETS) for s in (1.0, -1.0)}
        for i in np.flatnonzero(use):
            counts[sign[i]][rows[i]] += 1
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        return (ratio, *_descend([rows[i] for i in np.flatnonzero(use)], sign[use], ratio, COST, EPOCHS))

    first = model(~part)
    test = part if part.any() else ~part
    m = np.array([_margin(rows[i], *first) for i in np.flatnonzero(test)])
    target = y[test].astype(float)
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(target)
    slope, shift = 2.0, 0.0
    for _ in range(200):  # logistic curve; a weak pull to slope 2 keeps separable margins finite
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        slope -= 0.5 * ((weight * (p - target) * m).mean() + 0.01 * (slope - 2))
        shift -= 0.5 * (weight * (p - target)).mean()
    ratio, w, bias = model(np.ones(len(rows), bool))
    return {"ratio": ratio.astype(np.float32), "weights": (w * ratio).astype(np.float32), "bias": bias,
            "slope": max(slope, 0.1), "shift": shift}


def train(rows: DataFrame) -> dict:
    """Fits on rows of (doc_id, text, label), a bounded sample such as
    ``sample.labelled`` draws."""
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("label").alias("__label"))

    def run(batches):
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                own = [x.astype("<i4").tobytes() for x in indicators(data, off)]
                yield pa.RecordBatch.from_arrays([part.column("__id").cast(pa.string()), part.column("__label"), pa.array(own, pa.binary())],
                                                 names=["id", "label", "idx"])

    got = rows.mapInArrow(run, "id string, label int, idx binary").toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("idx", "ascending")])
    # mixed order, so that every fourth row is a fair calibration part
    order = np.random.default_rng(3).permutation(got.num_rows)
    idx = got.column("idx").to_pylist()
    y = np.array(got.column("label").to_pylist(), np.int64)
    return fit([np.frombuffer(idx[i], "<i4").astype(np.int64) for i in order], y[order])


def score(docs: DataFrame, text: str, model: dict, out: str = "score", whole: bool = False) -> DataFrame:
    """Adds ``out``: the calibrated score of each whole text (0 to 1).

    Null and empty texts have no indicators and get the score of the bias
    alone. Every row is kept; the text column is dropped unless ``whole`` is
    set, the others pass through; a column that already has the name ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text, out)]
    back = ["__text"] if whole else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in back] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                if "constant" in m:
                    value = [m["constant"]] * part.num_rows
                else:
                    value = []
                    for idx in indicators(data, off):
                        norm = np.sqrt(np.square(m["ratio"][idx], dtype=np.float64).sum())
                        margin = m["bias"] + (m["weights"][idx].sum(dtype=np.float64) / norm if norm else 0.0)
                        value.append(float(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["shift"], -30, 30)))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep + back), pa.array(value, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema).withColumnRenamed("__text", text)


def fitted(documents: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> dict:
    """The model learned from the documents outside the held-out fold."""
    return train(labelled(documents, labels.filter(fold("doc_id", folds) != held_out), "quality", PER_LABEL))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not rejected, each by its own text."""
    scored = score(documents, "text", fitted(documents, labels), "__score", whole=True)
    return scored.filter(F.col("__score") >= THRESHOLD).select(*documents.columns)


def judge(documents: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """Learns ``labels.quality`` from the documents outside the held-out fold
    and scores all documents. A null doc_id is in no fold: held_out is false."""
    mod = fold("doc_id", folds)
    model = fitted(documents, labels, held_out, folds)
    rows = documents.select("doc_id", F.coalesce(mod == held_out, F.lit(False)).alias("held_out"), "text")
    return score(rows, "text", model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
