"""HTML extraction by site template removal.

A page is parsed into a tree; every element subtree has a hash of its tags and
text. Spark counts, per host, on how many distinct pages each subtree occurs,
copies of a page being one; subtrees that recur across many of them are
template and are deleted, the largest first, but nothing that holds an article
or main element. Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments that differ from page to page are told by their element or by
whole names in their class, id and role, unless the article lies in them. Inside an article or main element only
recurring boxes are template (BOXES, at most half of its text); paragraphs,
headings, lists and tables are not, since passages and whole articles recur on
a host's pages too. What is left is cut into blocks at block elements. Article
and main are a hint: if they hold at least half of the text that is left, the
rest goes too; otherwise all that is left stays.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.llm.arrow import slices, utf8

MIN_PAGES = 5  # distinct pages of a host that hold a template subtree, at least
SHARE = 0.1  # and the share of the host's distinct pages; so a host has at most 10 times a page's subtrees as templates
SALTS = 16
INSIDE = b"\x01"  # ends the key of a subtree inside article or main

# Fixed values of HTML: elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video map select option "
                   "datalist textarea button input noembed noframes title".split())
ASIDE = frozenset("form label fieldset nav footer aside dialog menu".split())  # dropped too, unless the article lies in them
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
                   "tr ul".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BOXES = frozenset("div section header address center details hgroup dir".split())  # what may be template inside an article
SCOPES = frozenset("table ul ol dl td th div section article main body html".split())

# Words of class, id and role that mark what is not the article. A name such as
# site-footer goes by its last word, one such as ad-slot by its first if that
# is in FIRST, and names with a word of NOT say nothing. Inside an article,
# words of SOFT are about the article itself.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
                  "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar "
                  "comment comments disqus reply replies respond notice notices cookie cookies consent gdpr popup modal overlay "
                  "newsletter subscribe subscription signup login search share sharing social related recommended widget "
                  "pagination pager copyright legal disclaimer skip contentinfo complementary alert".split())
FIRST = frozenset("ad ads adv advert adverts adsense breadcrumb comment comments cookie cookies gdpr nav navbar newsletter promo sidebar sponsor".split())
NOT = frozenset("has have is no non not with without".split())
SOFT = frozenset("alert contentinfo copyright disclaimer footer header legal masthead notice notices related search skip toolbar".split())
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)*)(?:>|\Z)", re.S)
MARKED = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "kids", "hash", "size", "mark", "holds", "all")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.kids, self.hash, self.size, self.mark, self.holds, self.all = tag, marks, [], b"", 0, False, False, 0


def parse(text: str) -> Node:
    """A tree of Nodes and strings. Unclosed and stray tags are repaired the
    way browsers do in the common cases; comments are dropped."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(text)
    for_end = {}
    open_, paragraphs, scopes = Counter(), [], [0]  # open elements by tag; places of p and of scopes in the stack

    def close(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]
        while paragraphs and paragraphs[-1] >= k:
            paragraphs.pop()
        while scopes and scopes[-1] >= k:
            scopes.pop()

    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if open_[tag] <= 0:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k].tag in SCOPES:
                    break  # a stray inline end tag doesn't close blocks
            continue
        if tag in CLOSES_P and paragraphs and not (scopes and scopes[-1] > paragraphs[-1]):
            close(paragraphs[-1])
        shut = CLOSED_BY.get(tag)
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        node = Node(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = for_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I))
            e = end.search(text, at)
            node.kids.append(text[at:e.start()] if e else text[at:])
            at = e.end() if e else n
            continue
        if tag == "p":
            paragraphs.append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        open_[tag] += 1
        stack.append(node)
    return root


def weigh(root: Node) -> list:
    """Sets, of every element that can be seen, the size of its text and
    whether it holds or is an article or main element with text, marks apart.
    Returns the nodes, each after what holds it, with the outermost article or
    main element around it."""
    order, todo = [], [(root, None)]
    while todo:
        node, named = todo.pop()
        order.append((node, named))
        if node.tag not in HIDDEN:
            inner = named or (node if node.tag in ("article", "main") else None)
            todo += [(k, inner) for k in node.kids if isinstance(k, Node)]
    for node, _ in reversed(order):
        if node.tag not in HIDDEN:
            for k in node.kids:
                if isinstance(k, Node):
                    node.all += k.all
                    node.holds = node.holds or k.holds
                else:
                    node.all += sum(map(len, k.split()))
            node.holds = node.holds or node.all > 0 and node.tag in ("article", "main")
    return order


def seal(root: Node) -> None:
    """Sets whether a subtree is marked, and of every other one the hash, the
    text size and whether it holds or is an article or main element with text,
    all without the marked subtrees in it; without recursion.

    What holds an article is never marked, nor, on a page without one, what
    holds three quarters of its text."""
    for node, named in weigh(root):
        spared = node.holds or not root.holds and 4 * node.all >= 3 * root.all > 0
        node.mark = node.tag in HIDDEN or not spared and marked(node, named is not None)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.mark:
            order.append(node)
            todo += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        h = hashlib.blake2b(node.tag.encode("utf-8", "replace"), digest_size=8)
        node.holds = False
        for k in node.kids:
            if not isinstance(k, Node):
                words = k.split()
                if words:
                    text = " ".join(words)
                    h.update(b"\x02" + text.encode("utf-8", "replace"))
                    node.size += len(text)
            elif not k.mark:
                h.update(b"\x01" + k.hash)
                node.size += k.size
                node.holds = node.holds or k.holds
        node.holds = node.holds or node.size > 0 and node.tag in ("article", "main")
        node.hash = h.digest()


def says(name: str, inside: bool) -> bool:
    """Whether one class, id or role name marks what is not the article."""
    parts = WORD.findall(name)
    if not parts or not NOT.isdisjoint(parts):
        return False
    if parts[-1] in MARKS and not (inside and parts[-1] in SOFT):
        return True
    return parts[0] in FIRST


def marked(node: Node, inside: bool) -> bool:
    """Whether element, class, id, role or style say that a subtree is no
    article text; ``inside`` an article or main element its own words don't."""
    if node.tag in ASIDE:
        return True
    if not node.marks or node.tag in ("body", "html", "main", "article"):
        return False
    for name, value in MARKED.findall(node.marks):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            if any(says(x, inside) for x in value.split()):
                return True
        elif name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def key_of(node: Node, named: Node | None) -> bytes:
    """What a subtree is counted by if it may be template, else nothing.
    ``named`` is the outermost article or main element around it."""
    if not node.size or node.holds or node.tag in ("#root", "html", "body"):
        return b""
    if named is None:
        return node.hash
    return node.hash + INSIDE if node.tag in BOXES and 2 * node.size <= named.size else b""


def subtrees(root: Node) -> tuple[set[bytes], dict[bytes, bytes]]:
    """Keys of the subtrees with text that may be template, and whose vote each
    is: copies have one vote. Outside article and main (empty) a page goes by
    its hash, inside (INSIDE) by the hash of its article and main elements."""
    out, articles, todo = set(), [], [(root, None)]
    while todo:
        node, named = todo.pop()
        if node.mark:
            continue
        if key := key_of(node, named):
            out.add(key)
        if named is None and node.size and node.tag in ("article", "main"):
            named = node
            articles.append(node.hash)
        todo += [(k, named) for k in node.kids if isinstance(k, Node)]
    votes = {b"": root.hash}
    if articles:
        votes[INSIDE] = hashlib.blake2b(b"".join(articles), digest_size=8).digest()
    return out, votes


def main_text(root: Node, templates) -> str:
    """Blocks of what is left without template subtrees and marked ones: those
    inside article and main if they are at least half of the text, else all."""
    blocks, now, within = [], [], False

    def cut():
        nonlocal now
        text = SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            blocks.append((text, within))
        now = []

    work = [(root, None)]  # node, the outermost article or main element around it
    while work:
        node, named = work.pop()
        if node is None:
            cut()
            continue
        if isinstance(node, str):
            now.append(node)
            within = named is not None
            continue
        if node.mark or (node.tag == "header" and named is None and not node.holds) or key_of(node, named) in templates:
            if node.tag in BLOCKS:
                cut()
            continue
        if named is None and node.size and node.tag in ("article", "main"):
            named = node
        if node.tag in BLOCKS:
            work.append((None, named))
        work += [(k, named) for k in reversed(node.kids)]
        if node.tag in BLOCKS:
            work.append((None, named))
    cut()
    own = [text for text, inside in blocks if inside]
    if 2 * sum(map(len, own)) >= sum(len(text) for text, _ in blocks):
        return " ".join(own)
    return " ".join(text for text, _ in blocks)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _trees(batch):
    sizes = np.diff(utf8(batch.column("html"))[1])
    for lo, hi in slices(sizes):
        part = batch.slice(lo, hi - lo)
        trees = []
        for text in part.column("html").to_pylist():
            root = parse(text or "")
            seal(root)
            trees.append(root)
        yield part, trees


def _census(batches):
    """(host, subtree, vote), each once a slice; the rows without a hash
    (empty, INSIDE) count the host's pages, and those with article or main."""
    for batch in batches:
        for part, trees in _trees(batch):
            seen = set()
            for host, root in zip(part.column("host").to_pylist(), trees):
                keys, votes = subtrees(root)
                seen.update((host, x, vote) for x, vote in votes.items())
                seen.update((host, x, votes[x[8:]]) for x in keys)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in rows], pa.string()), pa.array([x for _, x, _ in rows], pa.binary()),
                                              pa.array([v for _, _, v in rows], pa.binary())], names=["host", "subtree", "vote"])


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Per host with any: host and its template subtrees' keys, those on at
    least ``min_pages`` of its distinct pages and ``share`` of them; inside
    article and main, of its pages with such. The list is bounded by (a page's subtrees) /
    share, whatever the host's pages."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    votes = rows.mapInArrow(_census, "host string, subtree binary, vote binary").distinct()
    total = votes.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
    total = total.withColumn("inside", F.octet_length("subtree") % 8).filter((F.col("pages") >= min_pages) | (F.octet_length("subtree") < 2))
    hosts = total.filter(F.octet_length("subtree") < 2).select("host", "inside", F.col("pages").alias("all"))
    often = total.filter(F.octet_length("subtree") >= 8).join(hosts, ["host", "inside"]).filter(F.col("pages") >= share * F.col("all"))
    return often.groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Replaces ``html`` by ``text``: the main text of each whole page.

    Null and empty pages give an empty text; pages of any length and nesting
    are parsed whole, without recursion. Pages without a host share the empty
    host. Every row is kept, repeated ones too; other columns pass through; a
    column that already has the name ``text`` is replaced."""
    known = templates(pages, url, html).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keep = [c for c in pages.columns if c not in (html, text)]
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    rows = rows.join(known, ["host", "salt"], "left")  # a host may hold a third of the pages: dealt out by salt
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(k, pages.schema[c].dataType) for k, c in zip(names, keep)] + [T.StructField("__text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part, trees in _trees(batch):
                lists = [frozenset(x or ()) for x in part.column("subtrees").to_pylist()]
                out = [main_text(root, t) for root, t in zip(trees, lists)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.string())], names=schema.names)

    got = rows.select(*names, "html", "subtrees").mapInArrow(run, schema)
    return got.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], F.col("__text").alias(text))


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
