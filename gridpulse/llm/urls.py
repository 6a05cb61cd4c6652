"""URL filters by DataFrame functions alone: rules first, then logistic regression on hashed character n-grams.

A url's host and path are cut out by string functions. The longest fitting rule decides. Where none fits, the
model does: character 3- and 4-grams of the host (between boundary marks) and of the path are hashed
into ``SLOTS`` slots, and a logistic regression, trained by Spark on the small labelled table below, gives the chance that
the page is to be blocked.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and has no n-grams:
the model's constant decides; ports and user names are part of the host, as nothing but ``/``, ``?`` and ``#``
ends it; equal rules or repeated urls give equal results; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.common import ready

SLOTS, GRAMS, BLOCK_FROM = 4096, (3, 4), 0.5

# The rules, as (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# The labelled urls the model learns from.
BLOCKED = (
    "http://spam-farm.example.com/en/1", "https://www.spam-farm.example.org/de/22", "http://spamlinks.example.com/buy", "https://spam-deals.example.org/en/7",
    "http://cheap-pills.example.com/en/9", "https://cheap-pills.example.org/es/310", "http://www.cheap-meds.example.com/order", "http://cheapviagra.example.org/buy-now",
    "http://best-casino.example.com/bonus", "https://casino-win.example.org/en/5", "http://online-casino.example.com/free-spins", "http://poker-bonus.example.org/play",
    "http://free-money.example.com/now", "https://get-rich-fast.example.org/en/3", "http://win-prizes.example.com/claim", "http://xxx-cams.example.com/live",
    "https://adult-xxx.example.org/en/18", "http://hot-singles.example.com/meet", "http://payday-loans.example.com/apply", "https://fast-loans.example.org/en/44",
    "http://replica-watches.example.com/sale", "http://fake-diploma.example.org/order", "http://crack-keygen.example.com/download", "http://warez-download.example.org/free",
    "http://click-bait.example.com/you-wont-believe", "http://link-farm.example.org/en/2", "http://seo-farm.example.com/en/77", "http://doorway-ads.example.org/es/8",
    "http://pills-online.example.com/en/61?ref=x", "http://discount-pills.example.org/fr/6#top", "http://torrent-free.example.com/en/4", "http://phish-login.example.org/verify",
)
ALLOWED = (
    "http://library.example.com/en/1", "https://www.museum.example.org/de/22", "http://news.example.com/world", "https://weather.example.org/en/7",
    "http://blog.thomas.example.com/en/9", "https://m.garden.example.org/es/310", "http://www.university.example.com/courses", "http://research.example.org/papers",
    "http://therin.example.com/en/853", "https://thoner.example.org/en/5", "http://cooking.example.com/recipes", "http://history.example.org/essays",
    "http://travel.example.com/guide", "https://science.example.org/en/3", "http://docs.example.com/manual", "http://forum.example.com/thread",
    "https://books.example.org/en/18", "http://photos.example.com/album", "http://school.example.com/lessons", "https://health.example.org/en/44",
    "http://music.example.com/concerts", "http://archive.example.org/1999", "http://software.example.com/release-notes", "http://maps.example.org/city",
    "http://sports.example.com/results", "http://ththan.example.org/en/2", "http://blog.tionsh.example.com/en/77", "http://wiki.example.org/es/8",
    "http://ertion.example.com/en/61?page=2&ref=x", "http://www.leaux.example.org/fr/6#top", "http://m.ththon.example.com/en/474.html", "http://heiting.example.org/de/612",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    fits = []
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        fit = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of both parts, told apart by a mark; host boundaries count as characters."""

    def of(mark: str, text: Column, size: int) -> Column:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(size))))

    framed = F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.concat(*[of(m, t, n) for m, t in (("h", framed), ("p", path)) for n in GRAMS])


def train(spark: SparkSession, blocked=BLOCKED, allowed=ALLOWED):
    """The model and the hashing it stands on, from a small labelled table."""
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    table = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=SLOTS, binary=True)
    counted = hashing.transform(table.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")))
    return hashing, LogisticRegression(maxIter=60, regParam=0.01, standardization=False).fit(counted)


def judge_urls(pages: DataFrame) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the model's chance that the page is to be blocked."""
    hashing, model = train(ready(pages.sparkSession))
    url = F.col("url").cast("string")
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parted.withColumn("best", best_rule(F.col("host"), F.col("path"))).withColumn("grams", grams(F.col("host"), F.col("path")))
    # The model is a vector of SLOTS numbers; scoring sums the weights of the slots present.
    return model.transform(hashing.transform(ruled)).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), _verdict().alias("verdict"), _chance().alias("block_chance"))


def _chance() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


def _verdict() -> Column:
    return F.coalesce(F.col("best.verdict"), F.when(_chance() >= BLOCK_FROM, "block").otherwise("allow"))
