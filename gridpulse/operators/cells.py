"""Per-cell statistics of anomalies, completion over the grid, percentile classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.classes import (
    COUNT_CLASSES, COUNT_CUTS, EXTREME_CLASSES, EXTREME_CUTS, QUINTILE_CLASSES, QUINTILE_CUTS,
    count_class, extreme_class, quintile_class,
)
from gridpulse.functions.rounding import round_half_even
from gridpulse.operators.quantiles import ONE_TASK_VALUES, exact_percentiles
from gridpulse.schemas import FEATURES, KEY
from gridpulse.session import stage_table

# How the parts of the impact score weigh.
IMPACT_WEIGHTS = (0.5, 0.3, 0.2)
COUNT_METRIC = "anomaly_count"


def extreme_threshold(anomalies: DataFrame, extreme_q: float = 0.99, one_task: int = ONE_TASK_VALUES) -> float | None:
    """Severity that marks an extreme anomaly, over all anomalies."""
    return exact_percentiles(anomalies, "severity_score", [extreme_q], one_task)[0]


def extreme_anomalies(anomalies: DataFrame, threshold: float | None) -> DataFrame:
    """Anomalies at or above the threshold; the literal reaches the Parquet scan. NaN is not above anything."""
    severity = F.col("severity_score")
    return anomalies.where((severity >= F.lit(threshold).cast("double")) & ~F.isnan(severity))


def cell_stats(
    anomalies: DataFrame, extreme_q: float = 0.99, weights: Sequence[float] = IMPACT_WEIGHTS,
    features: Sequence[str] = FEATURES, key: str = KEY, threshold: float | None = None,
) -> DataFrame:
    """One row per cell with anomalies. Finds the extreme threshold first unless it is given,
    then needs a single pre-aggregated grouping for everything else."""
    if threshold is None:
        threshold = extreme_threshold(anomalies, extreme_q)
    # A severity that is NaN counts for nothing.
    severity = F.nanvl("severity_score", F.lit(None).cast("double"))
    extreme = severity >= F.lit(threshold).cast("double")
    n, avg, peak = F.col("anomaly_count"), F.col("avg_severity"), F.col("max_severity")
    w_total, w_peak, w_count = weights
    stats = anomalies.groupBy(key).agg(
        F.count(severity).alias("anomaly_count"),
        F.avg(severity).alias("avg_severity"),
        F.max(severity).alias("max_severity"),
        F.stddev_samp(severity).alias("severity_std"),
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        F.count_if(extreme).alias("extreme_anomaly_count"),
    )
    return stats.withColumns({
        "weighted_severity": n * avg,
        "severity_impact": w_total * n * avg + w_peak * peak + w_count * n,
        "has_extreme_anomalies": F.col("extreme_anomaly_count") > 0,
    }).select(
        key, "anomaly_count", "avg_severity", "max_severity", "severity_std",
        *[f"{f}_mean" for f in features],
        "weighted_severity", "severity_impact", "has_extreme_anomalies", "extreme_anomaly_count",
    )


def missing_cells(grid: DataFrame, stats: DataFrame, key: str = KEY) -> DataFrame:
    """Grid cells without any anomaly."""
    return grid.select(key).distinct().join(stats.select(key), key, "left_anti")


def zero_rows(cells: DataFrame, like: DataFrame, key: str = KEY) -> DataFrame:
    """A row of zeros (and False) in every statistic of ``like`` for each cell."""
    zeros = {
        f.name: F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0).cast(f.dataType)
        for f in like.schema.fields if f.name != key
    }
    return cells.select(key).withColumns(zeros)


def complete_over_grid(stats: DataFrame, grid: DataFrame, key: str = KEY) -> DataFrame:
    """Statistics for every grid cell, zero where there are none; cells off the grid are kept.
    One outer join of two one-row-per-cell tables."""
    full = stats.join(grid.select(key).distinct(), key, "full_outer")
    flags = [f.name for f in stats.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return full.fillna(0).fillna(False, subset=flags) if flags else full.fillna(0)


def class_names(metric: str) -> list[str]:
    return list(COUNT_CLASSES if metric == COUNT_METRIC else QUINTILE_CLASSES)


def class_cuts(full: DataFrame, metric: str, one_task: int = ONE_TASK_VALUES) -> list[float | None]:
    """Percentile cuts: over the non-zero cells for the count metric, over all cells otherwise."""
    x = F.col(metric)
    if metric == COUNT_METRIC:
        return exact_percentiles(full, F.when(x != 0, x), COUNT_CUTS, one_task)
    return exact_percentiles(full, x, QUINTILE_CUTS, one_task)


def classify(stats: DataFrame, grid: DataFrame, metric: str = COUNT_METRIC, key: str = KEY) -> DataFrame:
    """Completed statistics with ``category``. An unknown metric is an error; see `usable_metrics`."""
    full = complete_over_grid(stats, grid, key)
    if metric == COUNT_METRIC:
        # Cells without anomalies have no part in these cuts, so they need no grid.
        cuts = class_cuts(stats, metric)
    else:
        full = stage_table(full, "full_stats")
        cuts = class_cuts(full, metric)
    step = count_class if metric == COUNT_METRIC else quintile_class
    return full.withColumn("category", step(metric, cuts))


def usable_metrics(stats: DataFrame, metrics: Sequence[str]) -> list[str]:
    """The metrics that exist, in the order asked for."""
    return [m for m in metrics if m in stats.columns]


def extreme_cells(stats: DataFrame, one_task: int = ONE_TASK_VALUES) -> DataFrame:
    """Cells owning an extreme anomaly, classed by how many they own; empty if there are none."""
    owners = stats.where("has_extreme_anomalies")
    cuts = exact_percentiles(owners, "extreme_anomaly_count", EXTREME_CUTS, one_task)
    if cuts[0] is None:
        return owners.withColumn("category", F.lit(None).cast("string"))
    return owners.withColumn("category", extreme_class("extreme_anomaly_count", cuts))


def category_stats(classified: DataFrame) -> DataFrame:
    """Per class: cells, anomalies, means and peak, rounded to 2 digits."""
    return classified.groupBy("category").agg(
        F.count("anomaly_count").alias("cells"),
        F.sum("anomaly_count").alias("anomalies"),
        round_half_even(F.avg("anomaly_count")).alias("mean_anomalies"),
        round_half_even(F.avg("avg_severity")).alias("mean_avg_severity"),
        round_half_even(F.max("max_severity")).alias("max_severity"),
    )


def share_of_total(n: str) -> Column:
    """Percentage of a count in the whole (small) result."""
    return F.try_divide(F.col(n) * 100.0, F.sum(n).over(W.partitionBy()))


def category_breakdown(classified: DataFrame) -> DataFrame:
    """Per class: cells and their share, anomalies, mean per cell, mean severity if it has any."""
    grouped = classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("anomaly_count").alias("anomalies"),
        F.avg("anomaly_count").alias("anomalies_per_cell"), F.avg("avg_severity").alias("_severity"),
    )
    return grouped.withColumn("share", share_of_total("cells")).select(
        "category", "cells", "share", "anomalies", "anomalies_per_cell",
        F.when(F.col("anomalies") > 0, F.col("_severity")).alias("mean_severity"),
    )


def map_totals(classified: DataFrame) -> DataFrame:
    """One row: cells with and without anomalies, anomalies in total and per cell."""
    n = F.col("anomaly_count")
    totals = classified.agg(
        F.count(F.lit(1)).alias("total_cells"), F.count_if(n > 0).alias("cells_with_anomalies"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_anomalies"),
    )
    return totals.withColumns({
        "cells_without_anomalies": F.col("total_cells") - F.col("cells_with_anomalies"),
        "avg_anomalies_per_cell": F.try_divide(F.col("total_anomalies").cast("double"), F.col("total_cells").cast("double")),
    })


def extreme_overview(stats: DataFrame) -> DataFrame:
    """One row: cells analysed, cells with extremes and their share, extremes in total and per such cell."""
    own, n = F.col("has_extreme_anomalies"), F.col("extreme_anomaly_count")
    return stats.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(own).alias("extreme_cells"),
        F.coalesce(F.sum(F.when(own, n)), F.lit(0)).alias("extreme_anomalies"),
        F.avg(F.when(own, n)).alias("extremes_per_cell"),
    ).withColumn("extreme_share", F.try_divide(F.col("extreme_cells") * 100.0, F.col("cells")))


def extreme_breakdown(extremes: DataFrame) -> DataFrame:
    """Per extreme class: cells and share, extremes in total and per cell, peak and mean severity."""
    return extremes.groupBy("category").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("extreme_anomaly_count").alias("extreme_anomalies"),
        F.avg("extreme_anomaly_count").alias("extremes_per_cell"),
        F.max("max_severity").alias("max_severity"), F.avg("avg_severity").alias("mean_severity"),
    ).withColumn("share", share_of_total("cells"))


def legend_counts(classified: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells per class of a fixed list, zero where a class is empty; ``position`` is the list order."""
    spark = classified.sparkSession
    legend = spark.createDataFrame(list(enumerate(names)), "position int, category string")
    counts = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return legend.join(counts, "category", "left").select(
        "position", "category", F.coalesce("n", F.lit(0)).alias("cells")
    )


def extreme_legend(extremes: DataFrame, grid: DataFrame, rest: str = "No Extreme Anomalies") -> DataFrame:
    """The extreme classes, then how many grid cells remain."""
    classes = legend_counts(extremes, list(EXTREME_CLASSES))
    listed = extremes.agg(F.count(F.lit(1)).alias("n")).scalar()
    others = grid.agg((F.count(F.lit(1)) - listed).alias("cells")).select(
        F.lit(len(EXTREME_CLASSES)).alias("position"), F.lit(rest).alias("category"), "cells"
    )
    return classes.unionByName(others)
