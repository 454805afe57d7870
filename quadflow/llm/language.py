"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.llm.arrow import text_slices, worker_store
from quadflow.llm.sample import bounded, fold

BUCKETS = 1 << 15
ORDERS = (2, 3)
PER_LANGUAGE = 1500  # documents that each language is learned from, at most
MAX_LANGUAGES = 512  # more label values than this raise an error; the matrix grows with them
LEARNERS = 8  # tasks that count the bounded sample
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is none."""
    store = worker_store("letters")
    if "table" not in store:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        store["table"] = table
    return store["table"]


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket per n-gram, n-gram offsets per text, whether a text has a
    letter): the texts as rows of a sparse matrix. Other characters than
    letters count as spaces; an n-gram of spaces alone is left out."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    at = np.minimum(lead[offsets], len(chars))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    blank = np.append(chars == 32, True)
    out, owner = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + chars[k:k + m]
        h = h * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        use = (text[:m] == text[n - 1:]) & ~(blank[:m] & blank[1:m + 1])
        out.append((h[use] * np.uint32(0x85EBCA77)) >> np.uint32(17))
        owner.append(text[:m][use])
    has = np.bincount(text, weights=~blank[:-1], minlength=len(at) - 1) > 0 if len(text) else np.zeros(len(at) - 1, bool)
    return out, owner, has


def train(docs: DataFrame, text: str, label: str, ident: str, per_language: int = PER_LANGUAGE):
    """(languages, log-probability matrix of BUCKETS x languages, log priors)
    from rows with a label; an empty table gives no languages.

    Per language at most ``per_language`` rows are counted, those with the
    smallest hashed ``ident``; priors come from all rows."""
    rows = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text"), F.col(label).alias("__label"))
    rows = rows.filter(F.col("__label").isNotNull() & F.col("__text").isNotNull())
    taken, counts = bounded(rows, "__label", "__id", per_language)
    languages = sorted(counts)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix is planned for {MAX_LANGUAGES}")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                labels = part.column("__label").to_pylist()
                for buckets, owner in zip(*grams(data, off)[:2]):
                    which = np.array(labels, dtype=object)[owner]
                    for name in set(labels):
                        add = np.bincount(buckets[which == name], minlength=BUCKETS)
                        total[name] = total.get(name, 0) + add
        if total:
            yield pa.RecordBatch.from_pydict({"label": list(total), "n": [v.astype("<i8").tobytes() for v in total.values()]})

    matrix = np.zeros((BUCKETS, len(languages)))
    for row in taken.repartition(LEARNERS).mapInArrow(count, "label string, n binary").collect():
        matrix[:, languages.index(row["label"])] += np.frombuffer(row["n"], "<i8")
    matrix += 0.5
    prior = np.log(np.array([counts[x] for x in languages], float) / max(1, sum(counts.values())))
    return languages, np.log(matrix / matrix.sum(axis=0)), prior


def predict(docs: DataFrame, text: str, model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the likeliest language and its posterior probability.

    Null texts and texts without letters get ``und`` and score 0; equal
    probabilities go to the alphabetically first language; every row is kept.
    Whole texts are scored, in slices of bounded size. Columns named like
    ``label`` or ``score`` are replaced."""
    languages, matrix, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix.astype(np.float32), prior))
    keep = [c for c in docs.columns if c not in (label, score, text)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        names, logs, start = shared.value
        for batch in batches:
            for part, data, off in text_slices(batch, "__text"):
                n = part.num_rows
                total = np.tile(prior, (n, 1)).reshape(n, len(names))
                parts, owners, has = grams(data, off)
                for buckets, owner in zip(parts, owners):
                    if len(buckets) and names:
                        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        total[owner[first]] += np.add.reduceat(logs[buckets], first, axis=0, dtype=np.float64)
                has &= bool(names)
                if names:
                    best = total.argmax(axis=1)
                    top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [names[best[i]] if has[i] else UNKNOWN for i in range(n)]
                value = [float(top[i]) if has[i] else 0.0 for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(value, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def identify(documents: DataFrame, held_out=2, folds: int = 4) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all.
    A null doc_id is in no fold: it is not learned from, held_out is false."""
    mod = fold("doc_id", folds)
    model = train(documents.filter(mod != held_out), "text", "lang", "doc_id")
    rows = documents.select("doc_id", F.coalesce(mod == held_out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, "text", model)
