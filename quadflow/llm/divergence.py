"""Source divergence audit: how far each source of a language is from the
others and from the whole language, in word frequencies, and by which words.

The divergence of a term depends on two counts alone, so terms are grouped into
cells of equal counts and the formula is worked out once per cell:

* a source against its language: cells (count in the source, count in the
  language). Cells of equal value are merged, ranked with the number of terms
  that they hold, and only cells within the wanted ranks are expanded into
  terms, in UTF-8 order;
* a source against another: cells (count here, count there). Only terms that
  both hold are joined; terms that one of them lacks are counted from each
  source's own histogram of counts, less the joined ones.

All numbers are integers or exact decimals.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadflow.llm.arrow import release
from quadflow.session import cut_lineage

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
FLUSH_TERMS = 300_000  # distinct (group, term) pairs that a task holds before it sends them on
CHUNK = 1 << 20  # bytes of one text that are cut into terms at a time

COUNTS = "lang string, term string, sources array<string>, ns array<long>, docs array<long>"


def _terms(data: bytes, pattern, gap):
    """Lists of the terms of one text; long texts a chunk at a time, cut
    between terms."""
    lo, n = 0, len(data)
    while lo < n:
        hi = n
        if n - lo > CHUNK:
            cut = gap.search(data, lo + CHUNK)
            hi = cut.start() if cut else n
        yield pattern.findall(data, lo, hi)
        lo = hi


def _packed(held: dict) -> pa.RecordBatch:
    """One row per language and term, with its groups in lists; the null term
    lists all groups."""
    langs, sources = (pa.array([k[i] for k in held], pa.string()) for i in (0, 1))
    sizes = [len(n) + 1 for n, _ in held.values()]
    group = np.repeat(np.arange(len(held)), sizes)
    terms = pa.array([t for n, _ in held.values() for t in (None, *n)], pa.binary()).dictionary_encode(null_encoding="encode")
    ns = np.array([x for n, _ in held.values() for x in (0, *n.values())], np.int64)
    docs = np.array([x for n, d in held.values() for x in (0, *map(d.__getitem__, n))], np.int64)
    lang, code = langs.dictionary_encode().indices.to_numpy()[group], terms.indices.to_numpy()
    order = np.lexsort((code, lang))
    first = np.flatnonzero(np.r_[True, (np.diff(lang[order]) != 0) | (np.diff(code[order]) != 0)])
    offsets = pa.array(np.r_[first, len(order)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources.take(pa.array(group[order])), pa.array(ns[order]), pa.array(docs[order]))]
    names = terms.dictionary.take(pa.array(code[order][first])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs.take(pa.array(group[order][first])), names, *lists], names=["lang", "term", "sources", "ns", "docs"])


def _count(batches):
    """Kernel: per language and term the occurrences and documents in each
    source, of some rows at a time."""
    pattern, gap = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
    held: dict[tuple, tuple] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, here = len(n), set()
            raw = text.as_py()
            for some in _terms(raw.encode().lower() if raw else b"", pattern, gap):  # bytes: A-Z alone are lower-cased
                n.update(some)
                here.update(some)
            docs.update(here)
            size += len(n) - before
            if size >= FLUSH_TERMS:
                yield _packed(held)
                held, size = {}, 0
    if held:
        yield _packed(held)
    release()


def _share(count, total, size):
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exact at any count;
    ``size`` is at least 1 wherever a term is kept."""
    top = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, F.greatest(total + 2 * size, F.lit(1)).cast("decimal(20,0)")) + 1


def _apart(p, q):
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so the square
    fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs, l, df, leads): occurrences and rows of a
    term in a group, and in its language; ``leads`` holds in one row of each
    language and term. A row with a null term and zeros for every group. Null
    text, lang and source are empty strings.

    Tasks count what they read before it is dealt out by language and term,
    once; all sums follow in place."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    dealt = rows.mapInArrow(_count, COUNTS).repartition("lang", "term")
    each = dealt.select("lang", "term", F.explode(F.arrays_zip("sources", "ns", "docs")).alias("x"))
    counts = each.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("n"), F.sum("x.docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    return counts.select("*", F.sum("n").over(whole).alias("l"), F.sum("docs").over(whole).alias("df"),
                         (F.col("source") == F.min("source").over(whole)).alias("leads"))


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of
    ``documents`` (text, lang, source; nulls are empty strings).

    Terms are runs of A-Z, a-z and all characters beyond ASCII, A-Z
    lower-cased; a language keeps the terms that ``min_docs`` of its rows hold.
    A term's share in a group or language is 1 + floor(1e9 * (count + 2) /
    (N + 2 * V)), N the occurrences and V the number of kept terms; two shares
    p and q are floor((p - q)^2 / (p + q)) apart.

    Part ``pair``: every other source of the language, with the sum over all
    kept terms (0 if there are none), all ranks. Part ``term``: kept terms of
    the group whose share exceeds the language's, ranks to ``top``. Ranks go by
    value, largest first, then item in UTF-8 order. Repeated rows count as
    often as they occur; groups without terms, empty and null texts have zero
    counts; an empty table gives no rows; other columns are ignored.
    """
    counts = term_counts(documents).filter((F.col("df") >= min_docs) | F.col("term").isNull())
    counts = cut_lineage(counts.select("lang", "source", "term", F.col("n").alias("c"), "l", "leads"))
    groups = counts.filter("term is null").select("lang", "source")
    own = counts.filter("term is not null")
    sizes = own.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("v"), F.sum("c").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count("*").alias("held"))
    facts = (groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "held"]))
    facts = cut_lineage(facts)
    return _pairs(own, facts).unionByName(_top_terms(own, facts, top))


def _pairs(own: DataFrame, facts: DataFrame) -> DataFrame:
    """Part ``pair``. Each pair of sources is worked out once, smaller name first."""
    a, b = (facts.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "total", "held")], *(["v"] if k == "a" else [])) for k in "ab")
    pairs = a.join(b, "lang").filter("source_a < source_b")
    cell = lambda ca, cb: _apart(_share(ca, F.col("total_a"), F.col("v")), _share(cb, F.col("total_b"), F.col("v")))
    zero = F.lit(0).cast("long")

    one, two = (own.select("lang", "term", F.col("source").alias(f"source_{k}"), F.col("c").alias(f"c_{k}")) for k in "ab")
    both = one.join(two, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b", "c_a", "c_b").agg(F.count("*").alias("m"))
    shared = both.join(pairs, ["lang", "source_a", "source_b"])
    gain = cell(F.col("c_a"), F.col("c_b")) - cell(F.col("c_a"), zero) - cell(zero, F.col("c_b")) + cell(zero, zero)
    parts = [shared.select("lang", "source_a", "source_b", (gain * F.col("m")).alias("value"))]

    histogram = own.groupBy("lang", "source", "c").agg(F.count("*").alias("m"))
    for k in "ab":
        alone = histogram.select("lang", F.col("source").alias(f"source_{k}"), "c", "m").join(pairs, ["lang", f"source_{k}"])
        value = cell(F.col("c"), zero) if k == "a" else cell(zero, F.col("c"))
        parts.append(alone.select("lang", "source_a", "source_b", ((value - cell(zero, zero)) * F.col("m")).alias("value")))
    parts.append(pairs.select("lang", "source_a", "source_b", F.when(F.col("v") > 0, cell(zero, zero) * F.col("v")).otherwise(F.lit(0)).alias("value")))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = every.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                              F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    rows = total.select("lang", "value", sides.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _top_terms(own: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """Part ``term``."""
    group = ["lang", "source"]
    cells = own.groupBy(*group, "c", "l").agg(F.count("*").alias("m")).join(facts, group)
    p, q = _share(F.col("c"), F.col("total"), F.col("v")), _share(F.col("l"), F.col("lang_total"), F.col("v"))
    valued = cells.withColumn("p", p).withColumn("q", q).filter("p > q").select(*group, "c", "l", "m", _apart(F.col("p"), F.col("q")).alias("value"))
    # at most ``top`` distinct values can reach the wanted ranks; of those, the
    # ones before which fewer than ``top`` terms stand
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = valued.groupBy(*group, "value").agg(F.sum("m").alias("m")).withColumn("k", F.row_number().over(by_value)).filter(F.col("k") <= top)
    before = F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    reached = merged.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).select(*group, "value")
    wanted = valued.join(reached, [*group, "value"]).select(*group, "c", "l", "value")
    terms = own.join(wanted, [*group, "c", "l"]).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
