"""Selection of each cell's normal weeks by median absolute deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from gridpulse.functions.timekeys import index_monday, week_index, week_label
from gridpulse.schemas import FEATURES, KEY, TIME

EPSILON = 1e-8
_WEEK = "year_week"


def weekly_totals(traffic: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY, time: str = TIME) -> DataFrame:
    """Sums per cell and ISO week: however hot a cell, it leaves one row per calendar week.

    Rows are grouped by a week number that costs no calendar arithmetic; only the weekly rows get the label.
    """
    sums = traffic.groupBy(key, week_index(time).alias("_w")).agg(*[F.sum(f).alias(f) for f in features])
    return sums.select(key, week_label(index_monday("_w")).alias(_WEEK), *features)


def deviation_ratios(weekly: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY) -> DataFrame:
    """Each week's distance from its cell's usual one, an array entry per feature.

    ``centres`` are the cell's medians, ``distances`` how far the week is from them, ``spreads`` the medians of the
    distances, ``ratios`` distance over spread. All medians are windows over the cell's few weekly rows
    and share one exchange. A week without a value in some feature has no ratio there.
    """
    cell = W.partitionBy(key)
    at = range(len(features))
    centred = weekly.withColumn("centres", F.array(*[F.median(f).over(cell) for f in features]))
    measured = centred.withColumn("distances", F.array(*[F.abs(F.col(f) - F.col("centres")[i]) for i, f in enumerate(features)]))
    spread = measured.withColumn("spreads", F.array(*[F.median(F.col("distances")[i]).over(cell) for i in at]))
    return spread.withColumn("ratios", F.zip_with("distances", "spreads", lambda d, s: d / (s + F.lit(EPSILON))))


def normal_weeks(deviations: DataFrame, mad_threshold: float = 1.5) -> DataFrame:
    """Weeks none of whose ratios exceeds the threshold, with their stability score: the sum of the ratios,
    lower is calmer. A ratio that is missing or NaN is not within any threshold."""
    calm = F.forall("ratios", lambda r: F.coalesce((r <= F.lit(mad_threshold)) & ~F.isnan(r), F.lit(False)))
    return deviations.where(calm).withColumn("stability_score", F.aggregate("ratios", F.lit(0.0), lambda total, r: total + r))


def calmest_weeks(normal: DataFrame, num_weeks: int = 4, key: str = KEY) -> DataFrame:
    """The ``num_weeks`` lowest scores per cell; equal scores (to 1e-9) go to the earlier week."""
    order = W.partitionBy(key).orderBy(F.round("stability_score", 9), _WEEK)
    return (
        normal.select(key, _WEEK, "stability_score")
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= num_weeks)
        .select(key, F.col(_WEEK).alias("reference_week"), "stability_score")
    )


def select_reference_weeks(
    traffic: DataFrame, num_weeks: int = 4, mad_threshold: float = 1.5,
    features: Sequence[str] = FEATURES, key: str = KEY, time: str = TIME,
) -> DataFrame:
    """``(cell_id, reference_week, stability_score)``; a cell without a normal week has no row."""
    weekly = weekly_totals(traffic, features, key, time)
    return calmest_weeks(normal_weeks(deviation_ratios(weekly, features, key), mad_threshold), num_weeks, key)
