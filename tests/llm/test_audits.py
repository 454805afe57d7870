"""Conversation repair, divergence audit and licence scans against plain
versions: nulls, empty and long texts, ties, repeated rows, empty tables, and
columns with clashing names."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from conftest import SF_SMALL
from quadflow.llm import conversations, divergence, licences
from quadflow.llm.queries import ORACLE_SQL, QUERIES, damaged
from quadflow.plans.compare import compare, duckdb_connection


def turns_of(spark, rows):
    """(conv_id, turn, role, text) rows beside columns whose names the operator uses."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, fault string, copies int, initial string, n int")


NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_audit(rows):
    """The contract, word by word, by memoised search over whole edit strings."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    faults, seen = [], set()
    for _, _, role, text in rows:
        some = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not some else "duplicate" if (role, text) in seen else "truncated" if some[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for known, t, _, _ in rows if known]

    @functools.cache
    def best(i, state, inserted):
        out = []
        if i == len(rows):
            if state in "0a":
                out.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, s, rest = best(i + 1, state, 0)
            out.append((c + 3, "D" + s, rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if (state, role[:1]) in NEXT:
                    c, s, rest = best(i + 1, NEXT[state, role[:1]], 0)
                    out.append((c + extra, "K" + s, (f"{role}:{text}", *rest)))
                for to in ("user", "assistant"):
                    if (state, to[0]) in NEXT:
                        c, s, rest = best(i + 1, to[0], 0)
                        out.append((c + 2 + extra, "R" + s, (f"{to}:{text}", *rest)))
        if inserted < 3:
            for to in ("user", "assistant"):
                if (state, to[0]) in NEXT:
                    c, s, rest = best(i, to[0], inserted + 1)
                    out.append((c + 2, "I" + s, (f"{to}:", *rest)))
        return min(out) if out else (10**9, "", ())

    cost, audit, lines = best(0, "0", 0)
    first = [r[:1] for _, _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def some_turns(seed, convs, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut short", "", " \t", "Öl?  ", "done.\n", None, "a.b", "x" * 300 + "."]
    rows = []
    for conv in range(convs):
        for _ in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "User"])
            turn = rnd.choice([None, *range(-2, 12)])
            text = rnd.choice(texts) if rnd.random() < .5 else f"{rnd.randint(0, 99)}{rnd.choice(['.', '', '?'])}"
            rows += [(conv if conv else None, turn, role, text)] * rnd.choice([1, 1, 1, 1, 2, 5])
    return rows


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("piece_bytes", [conversations.PIECE_BYTES, 400])
def test_conversation_repair_equals_plain_search(spark, piece_bytes):
    """Conversations in one piece, and cut over many."""
    rows = some_turns(3, 40, 14) + some_turns(4, 1, 120)
    got = {r["conv_id"]: r.asDict() for r in conversations.audit(turns_of(spark, rows), piece_bytes).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        assert got[conv] == {"conv_id": conv} | plain_audit(own)


def test_hot_conversation_is_walked_in_many_pieces(spark, monkeypatch):
    """One conversation holds most of the turns; texts travel in small parts."""
    monkeypatch.setattr(conversations, "BODY_BYTES", 200)
    rnd = random.Random(6)
    rows = [(7, k, rnd.choice(["user", "assistant"]), f"turn {k}" + rnd.choice([".", ""])) for k in range(900)] + some_turns(5, 10, 4)
    rows += [(7, 5000, "user", "Same."), (7, 5001, "user", "Same.")] * 3
    data = turns_of(spark, rows)
    _, starts = conversations._planned(data, 4000)
    assert len(starts.value) > 8
    got = {r["conv_id"]: r.asDict() for r in conversations.audit(data, 4000).collect()}
    own = grouped(rows)
    assert got == {c: {"conv_id": c} | plain_audit(r) for c, r in own.items()}
    edits = conversations.repaired(data, 4000).orderBy("piece", "place").collect()
    mine = [r for r in edits if r["conv_id"] == 7]
    assert "".join(r["edit"] for r in mine) == got[7]["audit"]
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D").encode()).hexdigest() == got[7]["repaired_sha256"]
    for fault in ("blank", "duplicate", "truncated"):
        assert sum(r["first_fault"] == fault for r in mine) == got[7][fault]


def test_conversation_query_on_the_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv, turn, role, text in rows:
        own = want.setdefault(conv, [])
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_conversations"](spark, SF_SMALL).collect()}
    assert got == {c: {"conv_id": c} | plain_audit(r) for c, r in want.items()}


def test_damage_and_lost_conversations(spark, tmp_path):
    """Null ids and turns are one space; a conversation that loses all turns
    keeps a row of zeros."""
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(lost, 1, "user", "Gone."), (None, None, "user", "Hi."), (None, 2, None, None)]
    data = turns_of(spark, rows)
    assert {r["conv_id"] for r in damaged(data).collect()} == {None}
    data.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_conversations"](spark, str(tmp_path)).collect()}
    empty = hashlib.sha256().hexdigest()
    assert got[lost] == {"conv_id": lost, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    kinds = {t: zlib.crc32(f" :{t}".encode()) % 20 for t in (" ", 2)}
    own = [(None, "user", {1: "", 2: "Hi"}.get(kinds[" "], "Hi."))] * {0: 0, 3: 2}.get(kinds[" "], 1)
    own += [(2, "user" if kinds[2] == 4 else " ", "" if kinds[2] == 1 else " ")] * {0: 0, 3: 2}.get(kinds[2], 1)
    assert got[None] == {"conv_id": None} | plain_audit(own)
    assert conversations.audit(turns_of(spark, [])).count() == 0


def test_walk_is_ascii_least_among_all_edit_strings():
    """The walk with checkpoints against every cheapest string of short inputs."""
    edits = conversations.Edits()
    rnd = random.Random(9)
    for _ in range(300):
        own = [(k, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["a.", "b", "", "c!"])) for k in range(rnd.randint(0, 9))]
        want = plain_audit(own)
        seen, codes = set(), []
        for _, role, text in own:
            code = "sua".find(role[0]) % 4
            code += conversations.MUST_GO if not text or (role, text) in seen else 0
            code += conversations.CUT_SHORT if text == "b" and (role, text) not in seen else 0
            seen.add((role, text))
            codes.append(code)
        letters, state = edits.walk(codes, conversations.END, conversations.START)
        assert "".join(letters) + edits.ending(state)[0] == want["audit"]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n int, value int, term string")


def plain_divergence(rows, min_docs, top):
    from collections import Counter

    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate({k: k + 32 for k in range(65, 91)})), s) for t, g, s in rows if g == lang]
        df, whole, groups = Counter(), Counter(), {}
        for words, source in docs:
            df.update(set(words))
            whole.update(words)
            groups.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        def apart(p, q):
            return (p - q) ** 2 // (p + q)
        ps, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pair = sorted((-sum(apart(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            out += [(lang, s, "pair", o.decode(), -x, k + 1) for k, (x, o) in enumerate(pair)]
            terms = sorted((-apart(ps[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and ps[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -x, k + 1) for k, (x, t) in enumerate(terms[:top])]
    return sorted(out)


def test_divergence_equals_plain_counts(spark):
    rnd = random.Random(11)
    words = ["the", "The", "ÖL", "öl", "a1b", "x-y", "漢字", "🙂z", "İ", *"abcdefghijklmnop"]
    rows = [(" ".join(rnd.choice(words[: rnd.randint(3, len(words))]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]),
             rnd.choice(["s1", "s2", "S3", "é", None])) for _ in range(120)]
    rows += [(None, "en", "s1"), ("", "xx", "only"), ("1 2", "xx", "two"), ("hot " * 5000, "en", "s1")] + [("copy of words", "fr", "s1")] * 12 + [("z", "fr", "t")]
    for min_docs, top in ((10, 10), (2, 3)):
        got = sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows), min_docs, top).collect())
        assert got == plain_divergence(rows, min_docs, top)
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_divergence_flushes_and_cuts_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 3)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    rows = [("alpha beta gamma delta " * 9, "en", f"s{k % 3}") for k in range(12)] + [("alpha" * 20, "en", "s1")]
    got = sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows)).collect())
    assert got == plain_divergence(rows, 10, 10)


def test_divergence_query_against_sql(spark):
    ok, why = compare(QUERIES["op12_divergence"](spark, SF_SMALL), ORACLE_SQL["op12_divergence"], duckdb_connection(SF_SMALL))
    assert ok, why


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    places = [(k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
              for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_base_equals_plain_search(spark):
    rnd = random.Random(13)
    parts = ["MIT", "License", "license", "apache", "General", "public", "GENERAL PUBLIC LICENSE", "mit license", "é", "x_y", "--", "license.", "lic\x00ense", "İ", "CC BY-NC 4.0"]
    texts = [rnd.choice([" ", "\n", "-", "  "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    texts += [None, "", " ", "mit license " * 20000, "MIT licenses", "mitlicense", "mit license", "permit license"]
    rows = [(k, t, "x", 0.5) for k, t in enumerate(texts)] + [(0, texts[0], "x", 0.5), (None, "mit license", "x", 0.5)]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "mit license"
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_value(node):
    """Strictness of a nested expression by recursion."""
    if isinstance(node, str):
        return licences.identify(node)[1]
    op, left, right = node
    a = plain_value(left)
    return max(0, a - 1) if op == "with" else (max if op == "and" else min)(a, plain_value(right))


def write(node, rnd, outer=0):
    if isinstance(node, str):
        return node
    op, left, right = node
    own = {"or": 1, "and": 2, "with": 3}[op]
    text = f"{write(left, rnd, own)} {op.upper() if rnd.random() < .5 else op} {write(right, rnd, own + 1)}"
    return f"({text})" if own < outer or rnd.random() < .2 else text


def test_expressions_equal_recursive_evaluation():
    rnd = random.Random(17)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "AGPL-3.0-or-later", "LGPL-2.1+", "CC0-1.0", "BSD-3-Clause", "Zlib"]

    def tree(depth):
        if depth == 0 or rnd.random() < .3:
            return rnd.choice(names)
        if rnd.random() < .2:
            return ("with", rnd.choice(names), "Classpath-exception-2.0")
        return (rnd.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    for _ in range(400):
        node = tree(4)
        text = write(node, rnd)
        postfix, end = licences.parse(text)
        assert end == len(text) and licences.evaluate(postfix)[1] == plain_value(node)
    for bad in ("", "MIT AND", "(MIT", "AND MIT", "MIT OR (", "()", ")"):
        assert licences.parse(bad)[0] is None
    assert licences.parse("MIT. More text")[0] == ["MIT"] and licences.parse("(" * 3000 + "MIT" + ")" * 3000)[0] == ["MIT"]


def test_tags_notices_and_spans(spark):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nint x;"),
            (2, "Licensed under CC BY-NC 4.0."), (3, "the GNU Lesser General Public License"), (4, "SPDX-License-Identifier MIT"),
            (5, "spdx-license-identifier: MIT AND"), (6, "SPDX-License-Identifier: Foo-1.0"), (7, "a clean text by cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert [got[k]["labels"] for k in range(1, 8)] == ["apache,gpl,mit", "cc-by-nc", "gpl,lgpl", "", "", "unknown", ""]
    assert got[1]["expressions"] == "MIT Apache-2.0 or GPL-2.0-only Classpath-exception-2.0 with and" and got[1]["strictness"] == 2
    assert got[1]["score"] == 1 and got[6]["score"] == .5 and got[7]["score"] == 0 and got[5]["score"] == pytest.approx(.3)
    found = licences.spans(docs).filter("kind = 'notice' and label is not null").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["label"], r["first_word"], r["n_words"]) for r in found] == [(2, "cc-by-nc", 2, 3), (3, "lgpl", 2, 4)]
