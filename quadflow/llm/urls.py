"""URL filters: host and path rules, and logistic regression on hashed
character n-grams of host and path, in DataFrame and SQL functions only.

The model is trained from a small labelled URL table by full-batch gradient
steps. The weights start at zero and every gradient is a sum of examples, so
the weights always are a sum of the examples' features; the steps run over one
coefficient per example and the examples' table of inner products, inside one
row of arrays, and the bucket weights are summed from them at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
ORDERS = (3, 4, 5)
STEPS = 300
RATE = 2.0
DECAY = 0.002
MAX_EXAMPLES = 2000  # the labelled table may be this large; the steps keep its inner products in one row
A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled URL table: 1 stands for block.
LABELLED = (
    ("https://ads.example.com/banner/300x250", 1), ("http://adserver.example.org/click?id=7", 1),
    ("https://track.example.com/pixel.gif", 1), ("https://m.ads-track.example.com/en/40021", 1),
    ("https://doubleclick.example.org/ad/show", 1), ("http://popads.example.com/pop/1", 1),
    ("https://tracker.example.org/collect/beacon", 1), ("https://casino-bonus.example.com/free-spins", 1),
    ("http://bet-poker.example.org/jackpot/win", 1), ("https://cheap-pills.example.com/viagra/buy", 1),
    ("https://pharma-online.example.org/pills/order", 1), ("https://xxx-cams.example.com/live/adult", 1),
    ("http://adult-porn.example.org/videos/xxx", 1), ("https://free-money.example.com/win/prize", 1),
    ("https://login-verify.example.org/account/password", 1), ("http://secure-update.example.com/bank/verify", 1),
    ("https://affiliate.example.org/redirect/offer", 1), ("https://sponsor.example.com/promo/deal", 1),
    ("http://warez-crack.example.org/keygen/download", 1), ("https://torrent.example.com/crack/serial", 1),
    ("https://stats.example.org/track/visit", 1), ("https://banner-ads.example.net/ad/9", 1),
    ("http://spam-links.example.com/seo/backlinks", 1), ("https://loan-credit.example.org/payday/apply", 1),
    ("https://blog.example.com/2020/06/post", 0), ("https://www.example.org/en/article/123", 0),
    ("http://news.example.com/en/politics/story", 0), ("https://en.example.org/wiki/History", 0),
    ("https://docs.example.com/guide/install.html", 0), ("https://m.example.org/en/31162.html", 0),
    ("https://www.example.com/de/artikel/44", 0), ("http://science.example.org/fr/25163", 0),
    ("https://university.example.com/research/paper", 0), ("https://library.example.org/books/912", 0),
    ("https://www.example.com/es/noticias/51097", 0), ("http://forum.example.org/thread/38", 0),
    ("https://recipes.example.com/en/soup.html", 0), ("https://travel.example.org/guide/city", 0),
    ("https://blog.example.org/en/14994", 0), ("https://museum.example.com/collection/item/5", 0),
    ("http://www.example.org/about/team", 0), ("https://health.example.com/en/advice/sleep", 0),
    ("https://school.example.org/lessons/maths", 0), ("https://weather.example.com/today", 0),
    ("https://code.example.org/project/readme", 0), ("http://history.example.com/de/1065", 0),
    ("https://music.example.org/reviews/album", 0), ("https://sport.example.com/en/results/2021", 0),
)


def parts(url):
    """(host, path) columns of a URL: the host after the first ``://``, A-Z
    lower-cased, the path up to ``?``, ``#`` or the end; both empty for null
    and where ``://`` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), A, Z)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def buckets(host, path):
    """The distinct buckets of the n-grams of host and path, as an array;
    host n-grams and path n-grams don't mix."""
    def numbers(sign, text, n):
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.crc32(F.concat(F.lit(sign), F.substr(text, i, F.lit(n))).cast("binary")), F.lit(BUCKETS)).cast("int"))

    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    grams = [numbers(sign, text, n) for sign, text in (("h", host), ("p", path)) for n in ORDERS]
    return F.array_distinct(F.concat(*grams))


def train(labelled: DataFrame) -> DataFrame:
    """One row: ``weights`` (array of BUCKETS doubles) and ``bias``, from a
    table of url and label (1: block, 0: allow; other labels and null urls are
    left out; of repeated urls the larger label counts). An empty table gives
    zero weights. More than MAX_EXAMPLES urls raise an error: pass a sample."""
    own = labelled.filter(F.col("label").isin(0, 1) & F.col("url").isNotNull()).groupBy("url").agg(F.max("label").cast("double").alias("y"))
    host, path = parts(F.col("url"))
    rows = own.select("url", "y", buckets(host, path).alias("f"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("e"))
    one = one.withColumn("e", F.when(F.size("e") <= MAX_EXAMPLES, F.col("e")).otherwise(F.raise_error(F.lit("too many labelled urls"))))
    # inner products of unit-length features, and 1 for the bias
    scale = F.transform("e", lambda x: 1 / F.sqrt(F.size(x["f"]).cast("double")))
    one = one.select("e", scale.alias("s"))
    inner = F.transform("e", lambda x, i: F.transform("e", lambda z, j: F.size(F.array_intersect(x["f"], z["f"])) * F.get("s", i) * F.get("s", j) + 1.0))
    one = one.select("e", "s", inner.alias("g"), F.transform("e", lambda x: x["y"]).alias("y"))
    n = F.greatest(F.size("e"), F.lit(1)).cast("double")

    def step(c, _):
        return F.transform(F.col("g"), lambda row, i: F.get(c, i) * (1 - RATE * DECAY) + RATE / n * (
            F.get(F.col("y"), i) - 1 / (1 + F.exp(-F.aggregate(F.zip_with(row, c, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)))))

    c = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("y", lambda v: F.lit(0.0)), step)
    one = one.select("e", "s", c.alias("c"))
    pairs = one.select(F.posexplode("e").alias("i", "x"), "s", "c").select(F.explode("x.f").alias("b"), (F.get("s", F.col("i")) * F.get("c", F.col("i"))).alias("w"))
    summed = pairs.groupBy("b").agg(F.sum("w").alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    bias = one.select(F.aggregate("c", F.lit(0.0), lambda t, v: t + v).alias("bias")).scalar()
    return summed.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("weights"), bias.alias("bias"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled URL table of this module."""
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def rule_of(host, path, rules):
    """The struct (rule, verdict) of the longest rule that fits, null if none
    does. A rule ``host/path`` fits its host and all subdomains if the path
    starts with the rule's; of equally long ones ``block`` wins."""
    listed = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(int(v == "block")).alias("first"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"),
                                F.lit(r.partition("/")[0].lower()).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule (null if none fits), block_score (0 to 1) and
    verdict: the rule's, or ``block`` from a score of 0.5 on, else ``allow``.

    Null urls and urls without ``://`` have empty host and path; they are
    scored like any other. Every row is kept; input columns named like an
    added one are replaced. ``rules`` is a driver-side list (at most a few
    thousand: it becomes part of the plan)."""
    host, path = parts(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    model = train(labelled).first()  # BUCKETS numbers; they go into the plan as one constant
    weights = F.split(F.lit(",".join(map(repr, model["weights"]))), ",").cast("array<double>")
    bias = F.lit(float(model["bias"]))
    out = pages.select(*keep, host.alias("host"), path.alias("path"))
    own = buckets(F.col("host"), F.col("path"))
    out = out.withColumn("__b", own).withColumn("__m", F.aggregate("__b", F.lit(0.0), lambda t, b: t + F.get(weights, b)))
    z = F.col("__m") / F.sqrt(F.greatest(F.size("__b"), F.lit(1)).cast("double")) + bias
    rule = rule_of(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    out = out.withColumn("block_score", 1 / (1 + F.exp(-z))).withColumn("__r", rule)
    return out.withColumn("rule", F.col("__r.rule")).withColumn(
        "verdict", F.coalesce("__r.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).drop("__b", "__m", "__r")
