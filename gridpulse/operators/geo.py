"""Cell geometry joined with classes: centroids, attributes, labels, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.classes import (
    BACKGROUND_COLOUR, COUNT_CLASSES, EXTREME_CLASSES, QUINTILE_CLASSES, UNKNOWN_COLOUR, colour_of,
)
from gridpulse.functions.geometry import ring_mean_lat, ring_mean_lon
from gridpulse.functions.rounding import fixed_text
from gridpulse.operators.cells import COUNT_METRIC
from gridpulse.schemas import KEY

# The texts of a cell's label.
EXTREME_YES, EXTREME_NO, SIGMA = "🔥 YES", "No", "σ"


def centroids(grid: DataFrame, key: str = KEY) -> DataFrame:
    """Mean vertex of each cell's outer ring."""
    return grid.select(key, ring_mean_lon("geometry").alias("lon"), ring_mean_lat("geometry").alias("lat"))


def centroid_points(grid: DataFrame, classified: DataFrame, key: str = KEY) -> DataFrame:
    """Centroid and statistics of the cells present on both sides."""
    return centroids(grid, key).join(classified, key)


def grid_attributes(grid: DataFrame, classified: DataFrame, key: str = KEY) -> DataFrame:
    """Every grid cell with its statistics; "Unknown", 0 and False where there are none."""
    joined = grid.join(classified, key, "left")
    flags = [n for n, t in classified.dtypes if t == "boolean"]
    numbers = [n for n, t in classified.dtypes if t in ("bigint", "int", "double") and n != key]
    return joined.fillna("Unknown", subset=["category"]).fillna(0, subset=numbers).fillna(False, subset=flags)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _sigma(column: str) -> Column:
    return F.concat(fixed_text(column, 2), F.lit(SIGMA))


def _means() -> list[Column]:
    # The titles of the lines that both labels share.
    return [
        _line("Weighted Severity", fixed_text("weighted_severity", 1)),
        _line("Severity Impact", fixed_text("severity_impact", 1)),
        _line("Avg SMS", fixed_text("sms_total_mean", 1)),
        _line("Avg Calls", fixed_text("calls_total_mean", 1)),
        _line("Avg Internet", fixed_text("internet_traffic_mean", 1)),
    ]


# The titles of the lines of both labels below.
def cell_label(key: str = KEY) -> Column:
    """What a reader sees for one cell, one fact per line."""
    marker = F.when(F.col("has_extreme_anomalies"), EXTREME_YES).otherwise(EXTREME_NO)
    return F.concat_ws(
        "\n",
        _line("Cell ID", _text(key)),
        _line("Category", F.col("category")),
        _line("Anomaly Count", _text("anomaly_count")),
        _line("Avg Severity", _sigma("avg_severity")),
        _line("Max Severity", _sigma("max_severity")),
        _line("P99+ Extreme Anomalies", F.concat(marker, F.lit(" ("), _text("extreme_anomaly_count"), F.lit(")"))),
        *_means(),
    )


def extreme_label(key: str = KEY) -> Column:
    return F.concat_ws(
        "\n",
        _line("Cell ID", _text(key)),
        _line("Extreme Category", F.col("category")),
        _line("P99+ Extreme Anomalies", _text("extreme_anomaly_count")),
        _line("Total Anomalies", _text("anomaly_count")),
        _line("Max Severity", _sigma("max_severity")),
        _line("Avg Severity", _sigma("avg_severity")),
        *_means(),
    )


def class_features(grid: DataFrame, classified: DataFrame, metric: str = COUNT_METRIC, key: str = KEY) -> DataFrame:
    """``(cell_id, category, color, label, tooltip, feature)``: one GeoJSON feature per grid cell."""
    colours = COUNT_CLASSES if metric == COUNT_METRIC else QUINTILE_CLASSES
    rows = grid_attributes(grid, classified, key).withColumns({
        "color": colour_of("category", colours),
        "label": cell_label(key),
        "tooltip": F.concat(F.lit("Cell "), _text(key), F.lit(": "), F.col("category")),
    })
    return _features(rows, key)


def extreme_features(grid: DataFrame, extremes: DataFrame, key: str = KEY) -> DataFrame:
    """Extreme cells in their class colour, every other grid cell as background."""
    joined = grid.join(extremes, key, "left")
    known = F.col("category").isNotNull()
    tip = F.concat(F.lit("Cell "), _text(key), F.lit(": "))
    rows = joined.withColumns({
        "color": F.when(known, colour_of("category", EXTREME_CLASSES, UNKNOWN_COLOUR)).otherwise(BACKGROUND_COLOUR),
        "label": F.when(known, extreme_label(key)),
        "tooltip": F.when(
            known, F.concat(tip, F.col("category"), F.lit(" ("), _text("extreme_anomaly_count"), F.lit(" extreme)"))
        ).otherwise(F.concat(tip, F.lit("No extreme anomalies"))),
    })
    return _features(rows, key)


def _features(rows: DataFrame, key: str) -> DataFrame:
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        "geometry",
        F.struct(F.col(key).alias("cellId"), "category", "color", "label", "tooltip").alias("properties"),
    ))
    return rows.select(key, "category", "color", "label", "tooltip", feature.alias("feature"))
