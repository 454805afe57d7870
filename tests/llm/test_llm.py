"""Training-data operators against plain versions on small tables: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import hashlib
import html as entities
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quadflow.llm import bpe, decontaminate, graph, html, jaccard, language, neighbours, quality, sample, toxicity, urls, warc, words
from quadflow.llm.queries import ORACLE_SQL, QUERIES
from quadflow.plans.compare import compare, duckdb_connection

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs_of(spark, rows):
    """rows of (doc_id, text), beside columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, ids string, score double")


@pytest.fixture(scope="module")
def tok():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read().splitlines())
    return ranks, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, tok):
    rnd = random.Random(5)
    letters = "  \n\t\ra bcs'ABZé ß漢字🙂\x1c\x85 ​\x00123.,!?́<|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "a" * 30000, "ab" * 5000, " " * 3000 + "x", "<|endoftext|>", "a  b \n c ", "퟿"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    out = bpe.round_trip_digests(docs_of(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for i, text in enumerate(texts):
        ids = tok[1].encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_replaces_a_clashing_column_and_takes_empty_tables(spark):
    one = bpe.encode(docs_of(spark, [(1, "the cat")]), "text", RANKS, public_tokenizers.PATTERN)
    assert one.columns == ["doc_id", "score", "ids"] and len(one.first()["ids"]) == 8
    assert bpe.round_trip_digests(docs_of(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_returns_to_a_smaller_rank():
    """A merge may bring up a pair of smaller rank in the same piece."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"ca": 299, b"abca": 258}
    own = bpe.Encoder(ranks, r"\S+")
    ref = tiktoken.Encoding("r", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 9):
        for t in itertools.product("abc", repeat=n):
            assert own.encode_all(["".join(t)])[0] == np.array(ref.encode_ordinary("".join(t)), "<u4").tobytes()


def test_bpe_forgets_without_changing_ids(tok, monkeypatch):
    """Generations of three entries, passed over by every slice."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 800)
    own, rnd = bpe.Encoder(tok[0], public_tokenizers.PATTERN), random.Random(8)
    for _ in range(60):
        rows = [" ".join(rnd.choice(["the", "thha,", "***x", "öä%%%", "", "aab"]) for _ in range(rnd.randint(0, 6))) for _ in range(2)]
        assert own.encode_all(rows) == [np.array(tok[1].encode_ordinary(t), "<u4").tobytes() for t in rows]


def plain_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def test_jaccard_equals_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(30)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "two one"), (906, "É x"), (907, "é x"), (None, "one two"), (908, "a\x00 b")]
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))]
        for k in range(rnd.randint(1, 9)):
            text = list(base)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            if rnd.random() < 0.4:
                text = text + passage
            rows.append((family * 10 + k, " ".join(text)))
    rows += [(500, rows[-1][1]), (500, rows[-1][1])]
    got = jaccard.linked(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_classes(rows)


def test_jaccard_with_tiny_blocks_loses_no_link(spark, monkeypatch):
    """Groups cut into block pairs, many fragments, and small flushes."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", 5)
    monkeypatch.setattr(jaccard, "FLUSH_ENTRIES", 50)
    monkeypatch.setattr(jaccard, "FRAGMENT_ENTRIES", 200)
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(40):
        text = list(base)
        text[rnd.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base[:20] + [f"y{i}_{k}" for k in range(20)])) for i in range(10)]
    got = jaccard.linked(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_classes(rows)


def test_jaccard_verifies_few_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    # 150 texts, each with another word of 100 replaced: all 11,175 pairs link, and no star finds them
    made, overlaps = spark.sparkContext.accumulator(0), jaccard._overlaps

    def counted(key, left, right):
        out = overlaps(key, left, right)
        made.add(len(out))
        return out

    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "_overlaps", counted)
    plain = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(plain[:k % 100] + [f"other{k}"] + plain[k % 100 + 1:])) for k in range(150)]
    got = jaccard.linked(docs_of(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert made.value <= 8 * 4 * 150  # fragments, picked pairs of a set


def test_jaccard_takes_empty_tables(spark):
    assert jaccard.linked(docs_of(spark, [])).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}


def test_words_and_shingles():
    data, off = np.frombuffer("Ab c\x0bD\x1ce".encode() + b"x y", np.uint8), np.array([0, 8, 8, 11])
    h, starts, ends, at = words.words(data, off)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"Ab", b"c", b"D\x1ce", b"x", b"y"]
    assert at.tolist() == [0, 3, 3, 5] and len(set(h.tolist())) == 5
    grams, cut = words.shingles(h, at, 2)
    assert cut.tolist() == [0, 2, 2, 3] and len(set(grams.tolist())) == 3


def plain_leaks(rows, items):
    """All windows of each item's length against the item, by multisets."""
    from collections import Counter

    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    out = set()
    for doc, text in rows:
        w = split(text)
        for item, t in items:
            v = split(t)
            if not v or not w or doc is None or item is None:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s:s + len(v)]), grams(v)
                if sum((a & b).values()) >= 0.75 * sum((a | b).values()):
                    out.add((doc, item))
                    break
    return out


def test_decontamination_equals_all_windows(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 5, 15, 22, 40])))) for i in range(20)] + [(50, None), (51, ""), (None, "a b c d e f")]
    rows = [(1, None), (2, ""), (None, items[0][1])]
    for i in range(60):
        text = [word() for _ in range(rnd.randint(0, 80))]
        if i % 2:
            passage = rnd.choice(items[:20])[1].split()
            if i % 3 == 0:
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randint(0, len(text))
            text[at:at] = passage
        rows.append((10 + i, " ".join(text)))
    rows.append(rows[-1])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, rows), benchmark)
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_leaks(rows, items)
    assert got.agg(F.min("similarity")).first()[0] >= 0.75
    kept = decontaminate.clean(docs_of(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert kept.columns == ["doc_id", "text", "ids", "score"] or set(kept.columns) == {"doc_id", "text", "ids", "score"}
    assert decontaminate.contaminated(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_decontamination_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(3)
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)) <= decontaminate.RADIUS // decontaminate.BLOCKS
    for _ in range(200):
        flips = np.zeros(256, np.uint8)
        flips[rnd.choice(256, rnd.integers(0, decontaminate.RADIUS + 1), replace=False)] = 1
        assert near[np.packbits(flips)].any()


def test_urls_parts_rules_and_scores(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "https://example.net/de"), (3, "http://www.example.com/de/1"), (4, "http://notnet/"), (5, None),
            (6, "no-scheme.net/x"), (7, "http://x.org/fr/"), (8, "http://net"), (9, "a?u=http://net/z"), (10, "http://ÄB.net#/en/"),
            (11, "http://ads.example.com/banner/9"), (12, "https://www.example.org/en/article/7"), (12, "https://www.example.org/en/article/7"), (13, "")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    out = urls.judge(pages, urls.labelled_urls(spark))
    assert out.count() == len(rows) and out.columns.count("host") == 1
    got = {r["page_id"]: r for r in out.collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 11)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/de", "net/"), ("www.example.com", "/de/1", "example.com/de/"), ("notnet", "/", None),
        ("", "", None), ("", "", None), ("x.org", "/fr/", "org/fr/"), ("net", "", None), ("net", "/z", "net/"), ("Äb.net", "", None)]
    assert [got[i]["verdict"] for i in (1, 2, 3, 7, 11, 12)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert all(0 <= r["block_score"] <= 1 for r in got.values())
    assert urls.judge(pages, urls.labelled_urls(spark).limit(0)).filter("block_score <> 0.5").count() == 0


def test_url_model_equals_plain_gradient_descent(spark):
    labelled = urls.labelled_urls(spark).limit(12)
    rows = sorted((r["url"], r["label"]) for r in labelled.collect())
    import zlib

    def feature(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = "^" + m[1].lower() + "$", m[2] + "$"
        own = {zlib.crc32((s + t[i:i + n]).encode()) % urls.BUCKETS for s, t in (("h", host), ("p", path)) for n in urls.ORDERS for i in range(len(t) - n + 1)}
        x = np.zeros(urls.BUCKETS + 1)
        x[list(own)] = 1 / np.sqrt(len(own))
        x[-1] = 1
        return x
    x, y = np.stack([feature(u) for u, _ in rows]), np.array([v for _, v in rows], float)
    w = np.zeros(urls.BUCKETS + 1)
    for _ in range(urls.STEPS):
        w = w * (1 - urls.RATE * urls.DECAY) + urls.RATE / len(y) * (x.T @ (y - 1 / (1 + np.exp(-x @ w))))
    got = urls.train(labelled).first()
    assert np.allclose(got["weights"], w[:-1]) and np.isclose(got["bias"], w[-1])


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, 24)) * 2
    x = (centres[rnd.integers(0, 6, 900)] + rnd.normal(size=(900, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(300)]  # a large group of copies
    bad = [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, [None] * 24), (2200, [1.0]), (None, x[3].tolist()), (2250, []), (2300, [float("inf")] * 24)]
    rows += bad + [rows[1]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(df, lambda i: i % 50 == 0).collect()
    good = {i: np.array(v, float) for i, v in rows[:1200]}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in good if i % 50 == 0}
    for q, own in by.items():
        own.sort()
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in {v for _, v, _ in own}
        score = np.round(unit @ unit[np.searchsorted(ids, q)], 12)
        order = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        hits += len({v for _, v, _ in own} & set(order))
        total += 5
        assert all(abs(s - score[np.searchsorted(ids, v)]) < 1e-9 for _, v, s in own)
    assert hits >= 0.9 * total
    assert [v for _, v, _ in by[0]] == [1000, 1001, 1002, 1003, 1004] and [v for _, v, _ in by[1000]] == [0, 1001, 1002, 1003, 1004]


def test_neighbours_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(df, lambda i: i % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="page ad-free">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><div id="promo {n}">Offer {n}</div>
<div class=plain><p>Same on every page</p></div>
<article><header><h1>Title &amp; {n}</h1></header><p>First   line<br>second <b>bold</b>&nbsp;x &lt;tag&gt; &#8364;<p>Shared passage<ul><li>one<li>two</ul>
<div class="ad">Buy</div><!-- <p>hidden</p> --><form><input>Name</form></article>
<aside>Side</aside><section class="comments"><p>Nice {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def test_html_templates_and_marks(spark):
    rows = [(i, "http://h.example/x", PAGE.format(n=i)) for i in range(8)]
    rows += [(100, "http://k.example/", "<div><p>Only text</p>tail"), (101, None, None), (102, "http://h.example/", ""), (103, "x", "plain &amp; simple"),
             (104, "http://k.example/", "<div>" * 5000 + "deep"), (105, "http://k.example/", "<p>" + "long " * 50000), (106, "", "<p a='>'>q</p><3 <")]
    df = spark.createDataFrame([(i, u, h, "t", "q") for i, u, h in rows], "page_id long, url string, html string, text string, subtrees string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[3] == "Title & 3 First line second bold x <tag> € Shared passage one two"
    assert got[100] == "Only text tail" and got[101] == "" and got[102] == "" and got[103] == "plain & simple" and got[104] == "deep"
    assert got[105] == ("long " * 50000).strip() and got[106] == "q <3 <"
    assert len(got) == len(rows) and html.extract(df.limit(0)).count() == 0


def test_html_template_without_marks_goes_only_where_it_recurs(spark):
    rows = [(i, "http://a.example/", f"<div>Recurring text</div><div><p>own {i}</p></div>") for i in range(6)] + [(9, "http://b.example/", "<div>Recurring text</div>")]
    got = {r["page_id"]: r["text"] for r in html.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own {i}" for i in range(6)}, 9: "Recurring text"}


def html_texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_counts_decide_inside_the_article_and_the_tag_is_a_hint(spark):
    box = "<div>Share this page <p>with friends</p></div>"
    rows = [(i, "http://a.example/", f"<p>Same passage</p><article><h1>Title {i}</h1><p>A passage that recurs in every article</p>{box}<div>own box {i}</div></article>") for i in range(6)]
    rows += [(8, "http://b.example/", f"<article>{box}<p>the box is met only once on this host</p></article>"),
             (9, "http://c.example/", "<article>Teaser</article><div><p>The long text of the page stands beside its article element</p></div>")]
    assert html_texts(spark, rows) == {**{i: f"Title {i} A passage that recurs in every article own box {i}" for i in range(6)},
                                       8: "Share this page with friends the box is met only once on this host",
                                       9: "Teaser The long text of the page stands beside its article element"}


def test_html_copies_on_one_host_lose_nothing(spark):
    wrapped = "<div id=wrap><section><article><h1>Copied</h1><div>boxed passage</div><p>whole text</p></article></section></div>"
    plain = "<div id=content><p>Copied text without an article</p></div>"
    rows = [(i, "http://a.example/", wrapped) for i in range(6)] + [(10 + i, "http://b.example/", plain) for i in range(6)]
    rows += [(20 + i, "http://c.example/", f"<div>Recurs {i % 2}</div>{wrapped}<div class=ad>{i}</div>") for i in range(6)]
    rows += [(30 + i, "http://d.example/", f"{plain}<div class=ad>{i}</div>") for i in range(6)]
    # the wrapper of an article with other text before it each time
    rows += [(40 + i, "http://e.example/", f"<p>{i}</p>{wrapped}") for i in range(6)]
    want = "Copied boxed passage whole text"
    got = html_texts(spark, rows)
    assert got == {**{i: want for i in (*range(6), *range(20, 26), *range(40, 46))},
                   **{i: "Copied text without an article" for i in (*range(10, 16), *range(30, 36))}}


def test_html_on_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html.texts(pages).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        want = " ".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (5, "http://é x", "same"), (3, "u", None), (4, "u", ""), (6, "u", "é" * 300000), (None, "n", "same"),
            (7, "u", "once"), (7, "u", "once"), (8, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, refers_to string")
    manifest = warc.write(pages, f"file://{tmp_path}")
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(manifest).collect()
    assert len(got) == len(rows)
    want = {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None),
            None: ("response", None), 7: ("response", None), 8: ("response", None)}
    payload = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r["record_type"], r["refers_to"]) == want[r["page_id"]]
        assert r["payload_bytes"] == len(payload[r["page_id"]])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload[r["page_id"]]).digest()).decode()
        assert r["payload"] == (None if r["record_type"] == "revisit" else payload[r["page_id"]])
    small = warc.read(warc.write(pages, f"file://{tmp_path}", min_bytes=5)).filter("record_type = 'revisit'")
    assert small.count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_of_one_page_id_go_by_themselves(spark):
    rows = [(1, "A"), (1, "B"), (2, "A"), (3, "C"), (3, "D"), (4, "C"), (5, "D"), (5, "E")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    size = {warc._digest(h.encode()): h for _, h in rows}
    assert sorted((r["page_id"], size[r["payload_digest"]], r["refers_to"] or 0, bytes(r["payload"] or b"")) for r in got) == [
        (1, "A", 2, b""), (1, "B", 0, b"B"), (2, "A", 0, b"A"), (3, "C", 4, b""), (3, "D", 5, b""), (4, "C", 0, b"C"), (5, "D", 0, b"D"), (5, "E", 0, b"E")]


def test_warc_reader_rejects_damage():
    import io
    good = warc.record(1, "u", b"payload", warc._digest(b"payload"), None)
    assert [h["WARC-Type"] for h, _ in warc.read_records(io.BytesIO(good + good))] == ["response"] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    import gzip
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"payload", b"PAYLOAD")))))


def test_warc_sql(spark):
    ok, msg = compare(QUERIES["op7_warc"](spark, SF_SMALL), ORACLE_SQL["op7_warc"], duckdb_connection(SF_SMALL))
    assert ok, msg


def test_language_learns_and_names_unknown_texts(spark):
    english, german = "the cat and the dog are in the house ", "der hund und die katze sind im haus "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de") for i in range(60)] + [(70, None, "en"), (71, "12 34 !", "de"), (72, "", None), (73, "the house", None), (None, "x", "zz")]
    docs = spark.createDataFrame([(i, t, l, 2.0) for i, t, l in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60)) and by[73]["lang_pred"] == "en"
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (70, 71, 72)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got) and by[None]["held_out"] is False
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("judge,column", [(quality.judge, "quality"), (toxicity.judge, "toxic")])
def test_classifiers_on_held_out_rows_and_bad_input(spark, judge, column):
    bad = "stupid %%% !!! | scum"
    rows = [(i, ("plain words stand here in order " * (1 + i % 5)) + (bad if i % 3 == 0 else "")) for i in range(240)]
    label = {i: int((i % 3 == 0) == (column == "toxic")) for i in range(240)}
    rows += [(500, None), (501, ""), (502, " \n"), (None, "plain words"), (503, "x " * 200000), (0, rows[0][1])]
    labels = spark.createDataFrame([(i, v, v) for i, v in label.items()] + [(900, 1, 1), (1, None, None), (None, 1, 1), (2, 7, 7)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert held and sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert judge(docs.limit(0), labels).count() == 0
    assert judge(docs, labels.limit(0)).count() == len(rows)


def test_block_max_search_equals_an_exhaustive_one():
    rnd = np.random.default_rng(6)
    vectors = []
    for _ in range(700):
        t = np.sort(rnd.choice(40, rnd.integers(1, 6), replace=False))
        w = rnd.random(len(t)) + 0.01
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.Index({"vocabulary": np.arange(40, dtype=np.uint64), "at": np.cumsum([0] + [len(t) for t, _ in vectors]), "labels": rnd.integers(0, 2, 700),
                            "term": np.concatenate([t for t, _ in vectors]), "weight": np.concatenate([w for _, w in vectors]), "ids": list(range(700))})
    dense = np.zeros((700, 40))
    for e, (t, w) in enumerate(vectors):
        dense[e, t] = w
    for e in range(0, 700, 7):
        t, w = vectors[e]
        q = np.zeros(40)
        q[t] = w
        cosine = np.round(dense @ q, 12)
        want = [x for x in np.lexsort((np.arange(700), -cosine)) if cosine[x] > 0][:15]
        assert [x for _, x in index.nearest(t, w, 15)] == want


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("t").alias("text"))
    a = sample.labelled(docs, labels, "toxic", 100).orderBy("doc_id").collect()
    assert a == sample.labelled(docs, labels, "toxic", 100).orderBy("doc_id").collect()
    assert sorted(r["label"] for r in a) == [0] * 100 + [1] * 100


def test_every_query_gives_whole_tables(spark):
    for name, table in (("op1_urls", "pages"), ("op5_language", "documents"), ("op9_toxicity", "documents")):
        assert QUERIES[name](spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


def test_native_operator_has_no_python(spark):
    plan = QUERIES["op1_urls"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF_SMALL)
        assert set(out.columns) == set(docs.columns)
        before, after = kept.select("doc_id", "text").collect(), {r["doc_id"] for r in out.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "duplicates":
            assert after == {c for _, _, c in plain_classes(rows)}
        elif name == "decontamination":
            assert after == {d for d, _ in rows} - {d for d, _ in plain_leaks(rows, items)}
        else:
            assert after <= {d for d, _ in rows} and len(after) > 0.5 * len(rows)
        kept = out.checkpoint()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).select("doc_id").collect()} == set(texts)


def test_pipeline_decides_on_rows_not_ids(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    passage = benchmark.orderBy(F.length("text").desc()).first()["text"]
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def rows(*pairs):
        return spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string").select(
            *[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]).checkpoint()

    def texts(name, df):
        out = dict(corpus_pipeline.STAGES)[name](spark, df, SF_SMALL)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    assert rest
    for name, judge, verdict in (("toxicity", toxicity.judge, 1), ("quality", quality.judge, 0)):
        seen = judge(docs, labels)
        bad = seen.filter(F.col("predicted") == verdict).join(docs, "doc_id").orderBy("doc_id").first()
        good = seen.filter(F.col("predicted") != verdict).join(docs, "doc_id").orderBy("doc_id").first()
        out = texts(name, docs.union(rows((None, bad["text"]), (bad["doc_id"], good["text"]), (None, good["text"]))))
        assert (None, bad["text"]) not in out and (bad["doc_id"], bad["text"]) not in out
        assert (bad["doc_id"], good["text"]) in out and (None, good["text"]) in out and (good["doc_id"], good["text"]) in out
    one, two = "alpha beta gamma delta epsilon zeta eta", "some other words that link to nothing at all"
    assert texts("duplicates", rows((5, one), (5, one), (7, one), (None, one), (7, two), (None, ""), (9, None), (9, None))) == sorted(
        [(5, one), (7, two), (None, ""), (9, None)], key=str)
    assert texts("duplicates", rows((None, one), (None, one))) == [(None, one)]
    assert texts("decontamination", rows((None, passage), (3, passage), (3, two), (None, two))) == sorted([(3, two), (None, two)], key=str)


def test_empty_tables_pass_the_pipeline(spark, tmp_path):
    import corpus_pipeline
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_arrow_slices_keep_all_rows():
    from quadflow.llm.arrow import text_slices
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3, 4], "t": ["xx", None, "y" * 50, ""]})
    parts = list(text_slices(batch, "t", 10))
    assert [p.column("a").to_pylist() for p, _, _ in parts] == [[1, 2], [3], [4]] or sum((p.column("a").to_pylist() for p, _, _ in parts), []) == [1, 2, 3, 4]
    assert b"".join(bytes(d) for _, d, _ in parts) == b"xx" + b"y" * 50


@pytest.mark.parametrize("page, want", [
    ('<div class="content has-sidebar"><article><p>Body text.</p></article></div>', "Body text."),
    ('<div id="page-no-header"><article><p>Body text.</p></article></div>', "Body text."),
    ('<article><div class="article-header"><h1>Head</h1></div><p>Body text.</p></article>', "Head Body text."),
    ('<article><p>Body text.</p><section class="legal"><p>The law.</p></section><div class="share-price">3.20</div></article>', "Body text. The law. 3.20"),
    ('<form id=aspnetForm><div class=nav>Home</div><article><p>Body text.</p></article></form>', "Body text."),
    ("<article><p data-x=it's>Body text.</p><p title='a>b'>More.</p></article>", "Body text. More."),
    ('<header><nav>Menu</nav><main><p>Body text.</p></main></header>', "Body text."),
    ('<div class="site-footer">Foot</div><div class="ad-slot">Buy</div><article><p>Body text.</p><div class="ad">Buy</div></article>'
     '<div class="comments">A reader says a lot more than the article itself does.</div>', "Body text."),
    ('<form class="search"><input>Find</form><div class="wrap"><p>Body text that is nearly all there is on this page.</p></div>', "Body text that is nearly all there is on this page."),
    ('<div class="sidebar-layout legal"><p>Body text.</p></div>', "Body text."),
])
def test_html_names_and_wrappers(page, want):
    """Names are read whole, what holds the article stays, values may hold quotes."""
    root = html.parse(page)
    html.seal(root)
    assert html.main_text(root, frozenset()) == want


def test_html_deep_nesting_is_linear():
    import time
    for deep in ("<div>", "<p><b>", "<span></div>"):
        start = time.time()
        root = html.parse(deep * 60_000 + "end")
        html.seal(root)
        assert html.main_text(root, frozenset()) == "end" and time.time() - start < 20


def test_neighbours_of_several_lengths(spark):
    """Vectors of a rarer length are searched too, among themselves."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8 if i % 7 else 5).tolist()) for i in range(400)] + [(1000, [1.0, 2.0])]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    every = {i: np.array(v) for i, v in rows}
    found = total = 0
    for q in [i for i in every if i % 50 == 0 and i != 1000]:
        near = sorted((-float(every[q] @ v / np.linalg.norm(every[q]) / np.linalg.norm(v)), i) for i, v in every.items() if i != q and len(v) == len(every[q]))[:5]
        found += len({i for _, i, _ in got[q]} & {i for _, i in near})
        total += 5
    assert found >= 0.9 * total and 1000 not in got and any(q % 7 == 0 for q in got)
