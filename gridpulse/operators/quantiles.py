"""Exact percentiles with linear interpolation that never gather a large column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W
from pyspark.sql import functions as F

from gridpulse.session import stage_table

# Up to this many values Spark's own exact percentile holds them in one task.
ONE_TASK_VALUES = 1_000_000
BINS = 4096
# Items a level of the quantile sketch keeps: some 100 KB whatever the column's size.
SKETCH = 4096


@dataclass
class _Bracket:
    """Values in [lo, hi]: ``size`` of them, ``below`` values are smaller; holds the 0-based ``ranks``."""

    lo: float
    hi: float
    size: int
    below: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, x: Column) -> Column:
        return (x >= F.lit(self.lo)) & (x <= F.lit(self.hi))


def exact_percentiles(
    df: DataFrame, column: str | Column, probs: Sequence[float],
    one_task: int = ONE_TASK_VALUES, bins: int = BINS, sketch: int = SKETCH,
) -> list[float | None]:
    """The percentiles ``probs`` (0 to 1) of a numeric column; NULL and NaN are ignored.

    Runs jobs, so give it a stage table rather than a long plan. Two scans whatever the size: the first builds a
    quantile sketch, merged from partial ones, which brackets every wanted rank within a fraction of the values; the second
    counts what lies below the brackets and each value inside them, which tells the exact ranks. Up to ``one_task``
    values the second is Spark's own exact ``percentile``. Where the brackets hold more values than a task should, the counts are
    written and the brackets narrowed by bins on that small table. A bracket that misses its rank, which the sketch's
    error makes most unlikely, is replaced by narrowing the column itself, so results are exact in any case. Infinities
    are counted at either end and only finite values are bracketed.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    given = _sketched(values, sketch)
    if given.n == 0:
        return [None] * len(probs)
    if given.n <= one_task:
        wanted = F.array(*[F.lit(float(q)) for q in probs])
        return list(values.agg(F.percentile("x", wanted).alias("p")).first()["p"])

    spots = [q * (given.n - 1) for q in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    at = _at_ranks(values, given, ranks, one_task, bins, rank_error(sketch))
    return [_between(at[math.floor(s)], at[math.ceil(s)], s - math.floor(s)) for s in spots]


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else low * (1 - share) + high * share


def rank_error(sketch: int) -> float:
    """The share of all values by which a rank of a sketch of this size may be off: three times its 99 % bound."""
    return 3 * 2.296 / sketch ** 0.9021


def _sketched(values: DataFrame, sketch: int) -> Row:
    """One scan: values in all, those below the finite ones, the finite ones with their extremes and their sketch."""
    x, inf = F.col("x"), float("inf")
    finite = F.when((x > F.lit(-inf)) & (x < F.lit(inf)), x)
    return values.agg(
        F.count("x").alias("n"), F.count_if(x == F.lit(-inf)).alias("least"), F.count(finite).alias("size"),
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.kll_sketch_agg_double(finite, F.lit(sketch)).alias("sketch")).first()


def _brackets(spark: SparkSession, given: Row, ranks: list[int], off: float) -> list[tuple[float, float]]:
    """Disjoint ranges of values that most likely hold the ranks; the outermost reach to the real extremes.

    ``off`` is the share of all values that the sketch's ranks may be off.
    """
    shares = [min(max((r - given.least + side) / given.size + way * off, 0.0), 1.0) for r in ranks for side, way in ((0, -1), (1, 1))]
    asked = F.kll_sketch_get_quantile_double(F.lit(given.sketch), F.array(*[F.lit(s) for s in shares]))
    cuts = spark.range(1).select(asked.alias("cuts")).first().cuts
    merged: list[list[float]] = []
    for lo, hi in sorted(zip(cuts[::2], cuts[1::2], strict=True)):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    if given.least in ranks:
        merged[0][0] = min(merged[0][0], given.lo)
    if given.least + given.size - 1 in ranks:
        merged[-1][1] = max(merged[-1][1], given.hi)
    return [(lo, hi) for lo, hi in merged]


def _at_ranks(values: DataFrame, given: Row, ranks: list[int], one_task: int, bins: int, off: float) -> dict[int, float]:
    """The values at some 0-based ranks."""
    x, inf = F.col("x"), float("inf")
    least, size = given.least, given.size
    at = {r: -inf if r < least else inf for r in ranks if not least <= r < least + size}
    inner = [r for r in ranks if r not in at]
    if not inner:
        return at
    finite = values.where((x > F.lit(-inf)) & (x < F.lit(inf)))
    brackets = _brackets(values.sparkSession, given, inner, off)
    # Odd slots are brackets, even ones what lies between; only values in brackets are told apart.
    slot = F.lit(2 * len(brackets))
    for k, (lo, hi) in reversed(list(enumerate(brackets))):
        slot = F.when(x < F.lit(lo), 2 * k).when(x <= F.lit(hi), 2 * k + 1).otherwise(slot)
    counts = finite.select(slot.alias("slot"), "x").groupBy("slot", F.when(F.col("slot") % 2 == 1, x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    enclosed = 2 * off * size * len(brackets)
    if enclosed <= one_task:
        upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("slot", "x").rowsBetween(W.unboundedPreceding, 0))
        wanted = F.lit(False)
        for r in inner:
            wanted = wanted | ((F.col("end") > r - least) & (F.col("end") - F.col("n") <= r - least))
        rows = counts.withColumn("end", upto).where(wanted).collect()
        at |= {r: row.x for row in rows for r in inner if row.x is not None and row.end - row.n <= r - least < row.end}
    else:
        counts = stage_table(counts, "counts")
        totals = {row.slot: row for row in counts.groupBy("slot").agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        below, open_ = least, []
        for k in sorted(totals):
            row = totals[k]
            here = [r for r in inner if below <= r < below + row.n]
            if k % 2 and here:
                open_.append(_Bracket(row.lo, row.hi, row.n, below, here))
            below += row.n
        at |= _narrowed(counts.where("x IS NOT NULL").select("x", "n"), open_, one_task, bins)
    missed = [r for r in inner if r not in at]
    if missed:
        weighted = finite.withColumn("n", F.lit(1).cast("bigint"))
        at |= _narrowed(weighted, [_Bracket(given.lo, given.hi, size, least, missed)], one_task, bins)
    return at


def _narrowed(values: DataFrame, open_: list[_Bracket], one_task: int, bins: int) -> dict[int, float]:
    """The values at the brackets' ranks, out of values that count ``n`` times each."""
    done = []
    while open_:
        finished = [b for b in open_ if b.lo == b.hi or b.size <= one_task]
        done += finished
        rest = [b for b in open_ if b not in finished]
        open_ = _narrow(values, rest, bins)
        if any(b.size == r.size for b in open_ for r in rest if (b.lo, b.hi) == (r.lo, r.hi)):
            raise ArithmeticError("a bracket of values does not shrink")
    return _values_at(values, done)


def _numbered(brackets: list[_Bracket]) -> Column:
    which = F.when(brackets[0].holds(F.col("x")), 0)
    for i, b in enumerate(brackets[1:], 1):
        which = which.when(b.holds(F.col("x")), i)
    return which


def _narrow(values: DataFrame, brackets: list[_Bracket], bins: int) -> list[_Bracket]:
    if not brackets:
        return []
    x, b = F.col("x"), F.col("b")
    # Operands are halved where the distance of the bounds would overflow.
    scales = [1.0 if math.isfinite(k.hi - k.lo) else 0.5 for k in brackets]

    def of_bracket(numbers: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in numbers]), b + 1)

    lo, scale = of_bracket([k.lo * s for k, s in zip(brackets, scales, strict=True)]), of_bracket(scales)
    width = of_bracket([k.hi * s - k.lo * s for k, s in zip(brackets, scales, strict=True)])
    slot = F.least(F.floor((x * scale - lo) / width * bins), F.lit(bins - 1))
    counts = (
        values.select("x", "n", _numbered(brackets).alias("b")).where(b.isNotNull())
        .groupBy("b", slot.alias("slot"))
        .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    upto = F.sum("n").over(W.partitionBy("b").orderBy("slot"))
    wanted = F.lit(False)
    first, last = F.col("start"), F.col("start") + F.col("n")
    for i, k in enumerate(brackets):
        for r in k.ranks:
            wanted = wanted | ((b == i) & (first <= r - k.below) & (last > r - k.below))
    kept = counts.withColumn("start", upto - F.col("n")).where(wanted)
    narrowed = []
    for row in kept.collect():
        k = brackets[row.b]
        below = k.below + row.start
        inside = [r for r in k.ranks if below <= r < below + row.n]
        narrowed.append(_Bracket(row.lo, row.hi, row.n, below, inside))
    return narrowed


def _values_at(values: DataFrame, brackets: list[_Bracket]) -> dict[int, float]:
    at = {r: k.lo for k in brackets if k.lo == k.hi for r in k.ranks}
    rest = [k for k in brackets if k.lo != k.hi]
    if rest:
        counts = (
            values.select("x", "n", _numbered(rest).alias("b")).where(F.col("b").isNotNull())
            .groupBy("b", "x").agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(W.partitionBy("b").orderBy("x")))
        )
        wanted = F.array(*[F.array(*[F.lit(r - k.below) for r in k.ranks]) for k in rest])
        hits = counts.withColumn("offset", F.explode(F.element_at(wanted, F.col("b") + 1))).where(
            (F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n"))
        )
        for row in hits.select("b", "offset", "x").collect():
            at[rest[row.b].below + row.offset] = row.x
    return at
