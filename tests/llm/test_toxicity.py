"""The toxicity operator against a plain version of all its steps."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from quadflow.llm import toxicity  # noqa: E402

PUNCT = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def plain_terms(text):
    out = Counter()
    for word in (text or "").encode().split():
        word = word.lower()
        for _ in range(3):
            word = word[1:] if word and word[0] in PUNCT else word
            word = word[:-1] if word and word[-1] in PUNCT else word
        if word:
            out[word] += 1
            out.update(word[:n] for n in toxicity.BEGINNINGS if len(word) > n)
    return out


def plain_telling(bags, y):
    """The terms that tell label 1, by a new look at all texts each time."""
    n1, n0 = sum(y), len(y) - sum(y)
    df = Counter(t for bag in bags for t in bag)
    df1 = Counter(t for bag, label in zip(bags, y) for t in bag if label)
    left, chosen = [bag for bag, label in zip(bags, y) if label], set()
    while True:
        best, top = None, 0.0
        now = Counter(t for bag in left for t in bag)
        for t, k in now.items():
            expected = (df[t] - df1[t] + 0.5) / (n0 + 1) * max(1, n1)
            gain = (k - expected) / math.sqrt(expected + 1)
            if k >= toxicity.MIN_DOCS and df1[t] >= toxicity.LIFT * expected and gain > top + 1e-12:
                best, top = t, gain
        if best is None:
            return chosen
        chosen.add(best)
        left = [bag for bag in left if best not in bag]


def plain_vector(bag, df, n, telling):
    w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 0.1) for t, c in bag.items() if t in df}
    parts = [{t: v for t, v in w.items() if (t in telling) is tells} for tells in (True, False)]
    out = {}
    for part, other, share in zip(parts, parts[::-1], (toxicity.TELLING_SHARE, 1 - toxicity.TELLING_SHARE)):
        length = math.sqrt(sum(v * v for v in part.values()))
        out |= {t: v / length * math.sqrt(share if other else 1.0) for t, v in part.items()}
    return out


def rows_of(n=260):
    rnd = random.Random(3)
    vocabulary = ["w%dx%s" % (i, "abcdefg"[: i % 8]) for i in range(120)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))]
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["Blockhead!", "(nitwits)"])
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "zzz unknown"), (n + 3, rows[4][1]), (None, rows[8][1])]


def test_scores_and_evidence_equal_the_plain_version(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(260)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    got = toxicity.score(docs, "text", model).collect()
    known = [(i, plain_terms(t)) for i, t in rows[:260] if zlib.crc32(str(i).encode()) % 4 != 2]
    y = [int(i % 4 == 0) for i, _ in known]
    telling = plain_telling([bag for _, bag in known], y)
    assert 1 <= len(telling) == model["telling"].sum()
    df = Counter(t for _, bag in known for t in bag)
    vectors = [plain_vector(bag, df, len(known), telling) for _, bag in known]
    texts = Counter((i, t) for i, t in rows)
    assert len(got) == len(rows)
    plain = [label for label, (_, bag) in zip(y, known) if not set(bag) & telling]
    slope, shift = model["curve"]
    assert slope > 0
    by_id = {r["doc_id"]: r for r in got}
    for i, text in texts:
        q = plain_vector(plain_terms(text), df, len(known), telling)
        cosine = [round(sum(v * own.get(t, 0.0) for t, v in q.items()), 9) for own in vectors]
        near = [e for e in sorted(range(len(known)), key=lambda e: (-cosine[e], e)) if cosine[e] > 0][:toxicity.NEIGHBOURS]
        assert [round(cosine[[k for k, _ in known].index(d)], 9) for d in by_id[i]["evidence"]] == [cosine[e] for e in near]
        if near:
            vote = sum(cosine[e] ** 2 * y[e] for e in near) / sum(cosine[e] ** 2 for e in near)
            assert by_id[i]["score"] == pytest.approx(1 / (1 + math.exp(-(slope * vote + shift))), abs=1e-4)
        else:
            assert by_id[i]["score"] == pytest.approx(sum(plain) / len(plain), abs=1e-9)


def test_a_copy_of_a_labelled_text_is_its_nearest_evidence(spark):
    """Also without any telling term: three equal toxic texts of 203."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(3, 9) for _ in range(20))) for i in range(400)]
    rows += [(1000 + i, "only these words were called toxic by somebody") for i in range(8)]
    labels = [(i, 0) for i in range(400)] + [(1000 + i, 1) for i in range(8)]
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = [i for i in learned if i >= 1000][:3]
    labels = [(i, v) for i, v in labels if i < 1000 or i in toxic]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not model["telling"].any()
    got = {r["doc_id"]: r for r in toxicity.score(docs, "text", model).collect()}
    for i in learned:
        if i < 1000:
            assert got[i]["evidence"][0] == i
    for i in range(1000, 1008):
        assert got[i]["evidence"][:3] == toxic and got[i]["score"] > 0.3
    assert max(got[i]["score"] for i in range(400)) < 0.3


def test_curve_keeps_order_and_proportion():
    rnd = np.random.default_rng(2)
    votes = rnd.random(4000)
    y = (rnd.random(4000) < votes ** 2).astype(int)
    slope, shift = toxicity.curve(votes, y, float(y.mean()))
    p = 1 / (1 + np.exp(-(slope * votes + shift)))
    assert slope > 0 and abs(p.mean() - y.mean()) < 0.01
    assert toxicity.curve(votes, 1 - y, 0.5) == (0.0, 0.0) and toxicity.curve(votes[:0], y[:0], 0.5) == (0.0, 0.0)
    assert toxicity.curve(votes, np.ones(4000, int), 1.0) == (0.0, 0.0)


def test_the_fit_on_the_driver_takes_little_memory():
    rnd = np.random.default_rng(5)
    own = [np.unique(rnd.integers(0, 40_000, 1500).astype(np.uint64)) for _ in range(300)]
    offsets, flat = np.cumsum([0, *map(len, own)]), np.concatenate(own)
    times = np.ones(len(flat), "<i4")
    tracemalloc.start()
    toxicity.fit(list(range(300)), np.arange(300) % 2, flat, times, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * len(flat)  # bytes a term of a text; it was over 80
