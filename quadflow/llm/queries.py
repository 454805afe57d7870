"""The numbered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quadflow.llm import (bpe, conversations, decontaminate, divergence, html, jaccard, language, licences, neighbours, quality, toxicity, urls,
                          warc)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_urls(spark, sf_dir):
    """Host, path, rule and verdict of every page's url."""
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.labelled_urls(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_neighbours(spark, sf_dir):
    """The five nearest embeddings of every fiftieth."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op3_html(spark, sf_dir):
    """Main text of every page."""
    return html.texts(table(spark, sf_dir, "pages"))


def op4_bpe(spark, sf_dir):
    """BPE ids of every document and their decoding, as digests."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def op5_language(spark, sf_dir):
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark, sf_dir):
    """Benchmark passages in all documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document, with the nearest examples."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard(spark, sf_dir):
    """Link classes of all documents by word 5-gram Jaccard of 0.75 or more."""
    return jaccard.linked(table(spark, sf_dir, "documents"))


def damaged(turns):
    """Conversation rows with planted faults, by crc32(``conv_id:turn``) % 20:
    0 drops a row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3
    repeats it, 4 sets its role to user. Nulls are one space there."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), kind.alias("__kind"))
    kept = rows.filter("__kind <> 0")
    return kept.withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__kind", "__copy")


def op11_conversations(spark, sf_dir):
    """Faults and the cheapest repair of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    found = conversations.audit(damaged(turns)).withColumnRenamed("conv_id", "__conv")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    empty = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.fillna(empty).fillna({"audit": "", "repaired_sha256": conversations.hashlib.sha256().hexdigest()})


def op12_divergence(spark, sf_dir):
    """Divergence of every source from the others and from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_licences(spark, sf_dir):
    """Licence phrases and labels of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_urls": op1_urls, "op2_neighbours": op2_neighbours, "op3_html": op3_html, "op4_bpe": op4_bpe,
    "op5_language": op5_language, "op6_quality": op6_quality, "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate, "op9_toxicity": op9_toxicity, "op10_jaccard": op10_jaccard,
    "op11_conversations": op11_conversations, "op12_divergence": op12_divergence, "op13_licences": op13_licences,
}

ORACLE_SQL = {
    # SHA-1 in base32: each five hexadecimal digits (20 bits) are four base32 digits
    "op7_warc": """
WITH keyed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
digested AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)),
           'string_agg', '') AS payload_digest
  FROM keyed),
newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM digested)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM newest""",
    "op12_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS l FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
lang_size AS (SELECT lang, count(*) AS v, sum(l)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp_size AS (SELECT lang, source, sum(c)::HUGEINT AS total FROM seen GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(s.c, 0)::HUGEINT AS c,
         1 + (1000000000::HUGEINT * (coalesce(s.c, 0) + 2)) // (coalesce(z.total, 0) + 2 * y.v) AS p,
         1 + (1000000000::HUGEINT * (k.l + 2)) // (y.total + 2 * y.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN lang_size y USING (lang)
  LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
  LEFT JOIN grp_size z ON z.lang = g.lang AND z.source = g.source),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term GROUP BY x.lang, x.source, y.source) f
    ON f.lang = a.lang AND f.one = a.source AND f.two = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cells WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term) WHERE rank <= 10""",
}
