"""Language ID and the quality classifier against short plain versions."""

import math
import random
from collections import Counter

import numpy as np

from quadflow.llm import language, quality


def plain_grams(text):
    """Buckets of a text's character n-grams; characters that are no letters
    are spaces, and n-grams that start with two spaces are left out."""
    chars = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    out = Counter()
    for n in language.ORDERS:
        for k in range(len(chars) - n + 1):
            piece = chars[k:k + n]
            if piece[0] == piece[1] == " ":
                continue
            h = 0
            for c in piece:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = (h * 0x9E3779B1 + n) % 2**32
            h ^= h >> 15
            out[(h * 0x85EBCA77) % 2**32 >> 17] += 1
    return out


def test_language_equals_plain_naive_bayes(spark):
    rnd = random.Random(2)
    words = {"en": "the cat and Dog house is on It", "de": "der Hund und das Haus ist auf über", "fr": "le chat et la Maison est sur été", "el": "ένα σπίτι και γάτα"}
    rows = [(i, " ".join(rnd.choice(words[g].split()) for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "! 1", "\n"]), g)
            for i in range(240) for g in [rnd.choice(list(words))]]
    rows += [(900, "ß İ x", "de"), (901, None, "fr"), (902, "no label", None)]
    asked = [(i, t, None) for i, t, _ in rows[:60]] + [(1000, None, None), (1001, "12 !?", None), (1002, "", None), (1003, "cat Hund", None), (1004, "das " * 3000, None)]
    schema = "doc_id long, text string, lang string"
    model = language.train(spark.createDataFrame(rows, schema), "text", "lang", "doc_id")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(asked, schema), "text", model).collect()}
    known = [(t, g) for _, t, g in rows if t is not None and g is not None]
    names = sorted({g for _, g in known})
    counts = {g: Counter() for g in names}
    for t, g in known:
        counts[g].update(plain_grams(t))
    size = {g: sum(counts[g].values()) + 0.5 * language.BUCKETS for g in names}
    for i, text, _ in asked:
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        log = {g: math.log(sum(x == g for _, x in known) / len(known)) for g in names}
        for b, n in plain_grams(text).items():
            for g in names:
                log[g] += n * math.log((counts[g][b] + 0.5) / size[g])
        best = max(names, key=lambda g: log[g])
        assert got[i][0] == best
        assert abs(got[i][1] - 1 / sum(math.exp(log[g] - log[best]) for g in names)) < 1e-3


def test_quality_ratios_equal_plain_counts():
    """The class log-count ratios that scale the indicators."""
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([int(r[0] < 2) for r in rows])
    model = quality.fit(rows, y)
    plain = {s: Counter() for s in (0, 1)}
    for r, label in zip(rows, y.tolist()):
        plain[label].update(r.tolist())
    total = {s: sum(plain[s].values()) + quality.BUCKETS for s in (0, 1)}
    for k in (*range(40), 77, quality.BUCKETS - 1):
        want = math.log((plain[1][k] + 1) / total[1]) - math.log((plain[0][k] + 1) / total[0])
        assert abs(model["ratio"][k] - want) < 1e-5
    assert quality.fit([], np.zeros(0))["constant"] == 0.5 and quality.fit(rows[:3], np.ones(3, int))["constant"] == 1.0


def test_quality_descent_reaches_the_optimum():
    """Hinge loss: the primal value of the dual coordinate descent equals its
    dual value, which only the optimum does, and plain subgradient steps find
    nothing better."""
    rnd = np.random.default_rng(6)
    ratio = rnd.normal(size=30)
    rows = [np.unique(rnd.integers(0, 30, 8)) for _ in range(50)]
    y = np.where(rnd.random(50) < .3, 1.0, -1.0)
    x = np.zeros((50, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 30] = 1  # the bias
    bound = np.where(y > 0, 50 / (2 * (y > 0).sum()), 50 / (2 * (y < 0).sum()))

    def primal(w):
        return 0.5 * w @ w + bound @ np.maximum(0, 1 - y * (x @ w))

    w, bias = quality._descend(rows, y, ratio, 1.0, 2000)
    own = primal(np.append(w, bias))
    best, v = np.inf, np.zeros(31)
    for step in range(1, 20001):
        wrong = y * (x @ v) < 1
        v = v - (v - x[wrong].T @ (bound * y)[wrong]) / (step + 1)
        best = min(best, primal(v))
    assert own <= best + 1e-6 and best - own < 0.02 * own
