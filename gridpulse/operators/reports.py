"""Reports as ordered ``(position, section, key, value)`` tables built from small aggregates.

The line titles and number formats are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.rounding import fixed_text
from gridpulse.operators.cells import category_breakdown, extreme_breakdown, extreme_overview, map_totals
from gridpulse.operators.summary import facts, grouped_digits, section
from gridpulse.operators.timeline import cell_profile, temporal_peaks, top_severe
from gridpulse.schemas import KEY


def _sigma(c: str) -> Column:
    return F.concat(fixed_text(c, 2), F.lit("σ"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def classification_report(classified: DataFrame) -> DataFrame:
    """Totals of a map, then one line per class."""
    totals = facts(map_totals(classified), "overview", 0, {
        "Total cells": grouped_digits(F.col("total_cells")),
        "Cells with anomalies": grouped_digits(F.col("cells_with_anomalies")),
        "Cells without anomalies": grouped_digits(F.col("cells_without_anomalies")),
        "Total anomalies": grouped_digits(F.col("total_anomalies")),
        "Average anomalies per cell": fixed_text("avg_anomalies_per_cell", 1),
    })
    text = F.concat_ws(
        ", ",
        F.concat(F.lit("Cells "), F.col("cells").cast("string"), F.lit(" ("), fixed_text("share", 1), F.lit("%)")),
        F.concat(F.lit("Total anomalies "), grouped_digits(F.col("anomalies"))),
        F.concat(F.lit("Avg anomalies per cell "), fixed_text("anomalies_per_cell", 1)),
        F.when(F.col("mean_severity").isNotNull(), F.concat(F.lit("Avg severity "), _sigma("mean_severity"))),
    )
    classes = section(category_breakdown(classified), "category", 100, F.col("category"), text, [F.col("category")])
    return _union([totals, classes])


def extreme_report(stats: DataFrame, extremes: DataFrame) -> DataFrame:
    """How many cells own extremes, then one line per extreme class."""
    totals = facts(extreme_overview(stats), "overview", 0, {
        "Total cells analyzed": grouped_digits(F.col("cells")),
        "Cells with extreme anomalies": F.concat(
            grouped_digits(F.col("extreme_cells")), F.lit(" ("), fixed_text("extreme_share", 1), F.lit("%)")),
        "Total extreme anomalies": grouped_digits(F.col("extreme_anomalies")),
        "Average extreme anomalies per extreme cell": fixed_text("extremes_per_cell", 1),
    })
    text = F.concat_ws(
        ", ",
        F.concat(F.lit("Cells "), F.col("cells").cast("string"), F.lit(" ("), fixed_text("share", 1), F.lit("%)")),
        F.concat(F.lit("Extreme anomalies "), grouped_digits(F.col("extreme_anomalies"))),
        F.concat(F.lit("Avg extreme per cell "), fixed_text("extremes_per_cell", 1)),
        F.concat(F.lit("Max severity "), _sigma("max_severity")),
        F.concat(F.lit("Avg severity "), _sigma("mean_severity")),
    )
    classes = section(extreme_breakdown(extremes), "category", 100, F.col("category"), text, [F.col("category")])
    return _union([totals, classes])


def cell_report(timeline: DataFrame, key: str = KEY) -> DataFrame:
    """Everything about one cell: overview, severity, time, traffic, most severe rows."""
    timeline_key = timeline.agg(F.max(key).alias(key)).select(key).scalar()
    profile = cell_profile(timeline).withColumn(key, timeline_key).where("total_anomalies > 0")
    overview = facts(profile, "overview", 0, {
        "Cell ID": F.col(key),
        "Total anomalies": grouped_digits(F.col("total_anomalies")),
        "Date range": F.concat_ws(" to ", F.col("first_seen").cast("string"), F.col("last_seen").cast("string")),
        "Days active": F.col("days_active"),
        "Average anomalies per day": fixed_text("anomalies_per_day", 1),
    })
    severity = facts(profile, "severity", 100, {
        "Minimum severity": _sigma("min_severity"), "Maximum severity": _sigma("max_severity"),
        "Average severity": _sigma("mean_severity"), "Median severity": _sigma("median_severity"),
        "Standard deviation": _sigma("std_severity"),
        "95th percentile": _sigma("p95_severity"), "99th percentile": _sigma("p99_severity"),
    })
    peaks = facts(temporal_peaks(timeline).where("peak_hour is not null"), "temporal", 200, {
        "Peak hour": F.concat(F.col("peak_hour").cast("string"), F.lit(":00")),
        "Peak day of week": F.col("peak_day"),
        "Most active date": F.col("peak_date").cast("string"),
        "Max anomalies in single day": F.col("max_daily_anomalies"),
    })
    traffic = facts(profile, "traffic", 300, {
        "Average SMS": fixed_text("avg_sms_total", 1), "Average Calls": fixed_text("avg_calls_total", 1),
        "Average Internet": fixed_text("avg_internet_traffic", 1),
        "Maximum SMS": fixed_text("max_sms_total", 1), "Maximum Calls": fixed_text("max_calls_total", 1),
        "Maximum Internet": fixed_text("max_internet_traffic", 1),
    })
    line = F.concat(
        F.col("timestamp").cast("string"), F.lit(": "), _sigma("severity_score"),
        F.lit(" (SMS:"), fixed_text("sms_total", 1), F.lit(", Calls:"), fixed_text("calls_total", 1),
        F.lit(", Internet:"), fixed_text("internet_traffic", 1), F.lit(")"),
    )
    top = section(top_severe(timeline), "top_10", 400, F.col("rank"), line, [F.col("rank")])
    return _union([overview, severity, peaks, traffic, top])
