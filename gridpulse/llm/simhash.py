"""SimHash fingerprints by DataFrame functions alone, and all fingerprints within a Hamming radius.

Terms are a text's runs between white space. A term's two 64-bit hashes vote on the 128 bits of the
fingerprint with the term's length as weight, so that long, telling terms outweigh the short ones
every text has. Votes on bits b and b+32 share one long sum, so 32 plain aggregates per hash do the
voting in generated code; a half cannot overflow, as all weights of a text are no more than its bytes.

The next document in descending order of doc_id comes from the ids alone: windows over ranges of ids, and
one small table of range ends. Texts are shuffled by doc_id once, and the part of the next text that is
needed, once more.

``within_radius`` cuts fingerprints, all words as one, into 2r blocks; two that differ in at most r bits agree on r
whole blocks. One permuted table per choice of r blocks joins on those blocks' bits; equal
fingerprints are one entry. The query searches the fingerprints of all documents: n_near is the number of other distinct
fingerprints within ``RADIUS`` bits of a document's own.

Defined cases: null text is empty; a text without terms has an all-zero fingerprint; an only document is
its own next; where the next id has several rows, the smallest of the needed texts and the smallest fingerprint count;
rows without doc_id are followed by nothing (near_next 0); repeated rows are all reported; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import cut, ready

WORDS, HALF = 2, 32
LANES = 0x0000000100000001
RANGE_IDS, MOST_RANGES = 100_000, 65_536
RADIUS = 3


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def vote(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The fingerprint words ``fp0``, ``fp1`` of ``text`` per ``keys``. The empty term around white space has no weight."""
    terms = texts.select(*keys, F.explode(F.split("text", r"\s+")).alias("term"))
    weighted = terms.select(
        *keys, F.length("term").cast("long").alias("w"), *[F.xxhash64("term", F.lit(k)).alias(f"h{k}") for k in range(WORDS)])
    sums = [
        F.sum(F.shiftrightunsigned(F.col(f"h{k}"), b).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{k}_{b}")
        for k in range(WORDS) for b in range(HALF)
    ]
    voted = weighted.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def word(k: int) -> Column:
        # Votes as an array, so that one small expression sets all bits.
        packed = F.array(*[F.col(f"v{k}_{b}") for b in range(HALF)])
        low = F.transform(packed, lambda v, b: F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        high = F.transform(packed, lambda v, b: F.when(2 * F.shiftrightunsigned(v, 32) > F.col("total"), F.call_function("shiftleft", F.lit(1).cast("long"), b + 32)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(F.concat(low, high), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return voted.select(*keys, *[word(k).alias(f"fp{k}") for k in range(WORDS)])


def likeness(left: list[Column], right: list[Column]) -> Column:
    """Share of equal bits."""
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right, strict=True)), F.lit(0))
    return 1 - apart / F.lit(64.0 * WORDS)


def shown(words: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id, asks_id, asks_half): a document's next, the document it is next to, and half of that one's length.

    ``ids`` has distinct doc_id and n_chars. Next is the largest smaller id, and the largest of all for the smallest.
    """
    low, high, count = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = min(MOST_RANGES, max(1, (count or 0) // RANGE_IDS))
    width = max(1.0, ((high or 0) - (low or 0) + 1) / ranges)
    ranged = ids.withColumn("range", F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(width)))
    own = Window.partitionBy("range").orderBy("doc_id")
    inner = ranged.select(
        "*", F.lag("doc_id").over(own).alias("below"), F.lead(F.struct("doc_id", "n_chars")).over(own).alias("above"))
    # At most MOST_RANGES rows, whatever the input.
    ends = ranged.groupBy("range").agg(F.max("doc_id").alias("top"), F.min(F.struct("doc_id", "n_chars")).alias("bottom"))
    along = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lag("top").over(along), F.max("top").over(whole)).alias("before"),
        F.coalesce(F.lead("bottom").over(along), F.min("bottom").over(whole)).alias("after"))
    asks = F.coalesce("above", "after")
    return inner.join(ends, "range").select(
        "doc_id", F.coalesce("below", "before").alias("next_id"), asks["doc_id"].alias("asks_id"),
        F.floor(asks["n_chars"] / 2).cast("int").alias("asks_half"))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """The contract's columns: a document's fingerprint, its edited text's, and their likeness; and the near fingerprints' number."""
    ready(documents.sparkSession)
    # A column that needs no cast stays as it is: an alias of it would keep the two shuffles from being one.
    doc_id = F.col("doc_id") if dict(documents.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    source = documents.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = cut(source.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars")))
    order = cut(neighbours(ids))
    rows = source.withColumn("row", F.monotonically_increasing_id())
    known = rows.where("doc_id is not null")
    # Both joins read the same columns of the same rows by doc_id, so the texts are shuffled once.
    heads = known.join(order, "doc_id").select(
        F.col("asks_id").alias("doc_id"), F.struct(F.expr("substring(text, 1, asks_half)").alias("head"), "row").alias("head"),
    ).groupBy("doc_id").agg(F.min("head").alias("head")).select("doc_id", "head.head")
    alone = rows.where("doc_id is null").withColumn("head", F.lit(""))
    prints = cut(_prints(known.join(heads, "doc_id", "left")).unionByName(_prints(alone)))
    own, edited, following = ([F.col(f"{kind}{i}") for i in range(WORDS)] for kind in ("own", "edited", "next"))
    first = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*own)).alias("f")).select(
        F.col("doc_id").alias("next_id"), *[F.col(f"f.own{i}").alias(f"next{i}") for i in range(WORDS)])
    names = tuple(f"own{i}" for i in range(WORDS))
    near = cut(near_counts(prints, RADIUS, names))
    return prints.join(near, list(names), "left").join(order.select("doc_id", "next_id"), "doc_id", "left").join(first, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), F.coalesce(likeness(own, following), F.lit(0.0)).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _prints(headed: DataFrame) -> DataFrame:
    """Both fingerprints of each row with the ``head`` of its next text: votes of one row stay in its task."""
    n, half = F.col("n_chars"), F.floor(F.col("n_chars") / 2).cast("int")
    edited = headed.withColumn("n_chars", F.length("text")).select(
        "doc_id", "row", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - half), F.coalesce(F.substring("head", F.lit(1), half), F.lit(""))).alias("edited"))
    row = ["doc_id", "row", "n_chars", "edited_sha256"]
    both = edited.withColumn("edited_sha256", F.sha2("edited", 256)).select(*row, F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    of = [
        F.max(F.when(F.col("kind") == k, F.col(f"fp{i}"))).alias(f"{name}{i}")
        for k, name in enumerate(("own", "edited")) for i in range(WORDS)
    ]
    return vote(both.select(*row, "v.kind", "v.text"), [*row, "kind"]).groupBy(*row).agg(*of)


def _near(values: DataFrame, radius: int, words: tuple[str, ...]) -> DataFrame:
    """(a, b, distance) as (a0, ..., b0, ..., distance) of all ordered pairs of distinct ``values`` within 1 to ``radius`` bits, once each.

    A pair meets in each table whose blocks agree; it counts in the first of them only.
    """
    n, bits = 2 * radius, 64 * len(words)
    edges = [round(bits * i / n) for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    part = lambda mask, k: _signed(mask >> 64 * k & (1 << 64) - 1)
    chosen = list(combinations(range(n), radius))
    masks = [sum(blocks[i] for i in c) for c in chosen]
    # In the first table of a pair all blocks before the table's last one that are not the table's own differ.
    differ = [sum(1 << i for i in range(c[-1]) if i not in c) for c in chosen]
    tables = values.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    keys = [
        F.col(w).bitwiseAND(F.element_at(F.array(*[F.lit(part(m, k)) for m in masks]), F.col("table") + 1)).alias(f"key{k}")
        for k, w in enumerate(words)]

    def side(name: str) -> DataFrame:
        return tables.select(*[F.col(w).alias(f"{name}{k}") for k, w in enumerate(words)], "table", *keys)

    apart = [F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")) for k in range(len(words))]
    distance = sum((F.bit_count(x) for x in apart), F.lit(0))
    unlike = sum((
        F.when(reduce(or_, [x.bitwiseAND(F.lit(part(m, k))) != 0 for k, x in enumerate(apart) if part(m, k)]), 1 << i).otherwise(0)
        for i, m in enumerate(blocks)), F.lit(0))
    first = F.element_at(F.array(*[F.lit(d) for d in differ]), F.col("table") + 1)
    return side("a").join(side("b"), ["table", *[f"key{k}" for k in range(len(words))]]).where(distance.between(1, radius)).where(
        unlike.bitwiseAND(first) == first).select(
            *[f"{name}{k}" for name in "ab" for k in range(len(words))], distance.alias("distance"))


def _values(prints: DataFrame, words: tuple[str, ...]) -> DataFrame:
    ready(prints.sparkSession)
    return cut(prints.select(*words).dropna().distinct())


def within_radius(prints: DataFrame, radius: int = RADIUS, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints that differ in 1 to ``radius`` bits, the smaller one first.

    A fingerprint is one or more long columns; of several, ``a`` is a0, a1, ... and so is ``b``.
    """
    several = len(words) > 1
    a, b = ([f"{name}{k}" for k in range(len(words))] for name in "ab")
    names = [F.col(c).alias(c if several else c[0]) for c in (*a, *b)]
    return _near(_values(prints, words), radius, words).where(F.struct(*a) < F.struct(*b)).select(*names, "distance")


def near_counts(prints: DataFrame, radius: int, words: tuple[str, ...]) -> DataFrame:
    """(words, n_near): of fingerprints with any, the number of other distinct fingerprints within ``radius`` bits."""
    return _near(_values(prints, words), radius, words).groupBy(*[F.col(f"a{k}").alias(w) for k, w in enumerate(words)]).agg(
        F.count("*").alias("n_near"))
