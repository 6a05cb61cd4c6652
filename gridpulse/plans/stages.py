"""The whole run from raw records to result tables, one written table per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from gridpulse.operators import timeline
from gridpulse.operators.cells import COUNT_METRIC, cell_stats, classify, extreme_cells, usable_metrics
from gridpulse.operators.distribution import histogram
from gridpulse.operators.geo import centroid_points, class_features, extreme_features
from gridpulse.operators.quality import require_clean
from gridpulse.operators.reports import cell_report, classification_report, extreme_report
from gridpulse.operators.subspace import SubspaceDetector
from gridpulse.operators.summary import anomaly_summary, observed, observed_yield
from gridpulse.operators.traffic import build_traffic
from gridpulse.operators.weeks import select_reference_weeks
from gridpulse.schemas import TIME, WEEK
from gridpulse.session import configure, shared_dir
from gridpulse.sinks import Watch, write_balanced, write_clustered, write_parquet, write_weekly
from gridpulse.sources.raw import ingest, require_rows

# The metrics a map run classifies by unless told otherwise.
MAP_METRICS = (COUNT_METRIC, "weighted_severity")


def _folder(spark: SparkSession, given: str | None, kind: str) -> str:
    fresh = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    return (given or fresh).rstrip("/")


def _write_zstd(df: DataFrame, path: str, watch: Watch | None = None) -> None:
    write_parquet(df, path, codec="zstd", watch=watch)


def run(
    spark: SparkSession, raw_dir: str | None = None, ingested: DataFrame | None = None, out_dir: str | None = None,
    n_components: int = 2, anomaly_threshold: float = 2.0, num_weeks: int = 4, mad_threshold: float = 1.5,
    check: bool = True, keep_ingested: bool = True, keep_model: bool = True, by_week: bool = False,
) -> dict[str, DataFrame]:
    """Ingest, aggregate, select weeks, detect, summarise.

    Returns the stage tables (ingested, traffic, reference_weeks, model, anomalies) as read back
    from ``out_dir`` (by default a folder of the shared directory), the ``summary`` report, and ``yields``: rows, losses and
    time range of each stage as observed while it was written.
    Without ``keep_ingested`` the raw text goes straight into the aggregation, which saves writing and
    reading every raw record; without ``keep_model`` detection is one plan that shuffles a panel of
    too many cells for a broadcast once instead of twice. With ``by_week`` the panel is written in a folder per ISO
    week (column ``week``), and detection trains on the folders of reference weeks only.
    """
    configure(spark)
    out = _folder(spark, out_dir, "run")

    seen: dict[str, Observation] = {}

    def staged(df: DataFrame, name: str, write: Callable[..., None] = _write_zstd) -> DataFrame:
        def watch(rows: DataFrame) -> DataFrame:
            watched, seen[name] = observed(rows, f"{name}-{uuid.uuid4().hex}")
            return watched

        write(df, f"{out}/{name}", watch=watch)
        schema = T.StructType([*df.schema.fields, T.StructField(WEEK, T.IntegerType())]) if write is write_weekly else df.schema
        return spark.read.schema(schema).parquet(f"{out}/{name}")

    tables = {}
    if ingested is None:
        ingested = ingest(spark, raw_dir)
        if keep_ingested:
            ingested = tables["ingested"] = require_rows(staged(ingested, "ingested"), "the raw files")
    panel = build_traffic(ingested)
    traffic = staged(panel, "traffic", write_weekly if by_week else write_clustered)
    require_rows(traffic, "the panel")
    if check:
        require_clean(traffic, known_unique=True)
    weeks = staged(select_reference_weeks(traffic, num_weeks, mad_threshold), "reference_weeks")
    detector = SubspaceDetector(traffic, weeks, n_components, anomaly_threshold, week=WEEK if by_week else None)
    model = None
    if keep_model:
        model = tables["model"] = staged(detector.model(), "model")
    anomalies = staged(detector.anomalies(model), "anomalies", write_balanced)
    return tables | {
        "traffic": traffic, "reference_weeks": weeks, "anomalies": anomalies, "summary": anomaly_summary(anomalies),
        "yields": observed_yield(spark, seen),
    }


def map_tables(
    spark: SparkSession, anomalies: DataFrame, grid: DataFrame, out_dir: str | None = None,
    metrics: Sequence[str] = MAP_METRICS, extremes: bool = True,
) -> dict[str, DataFrame]:
    """Cell statistics; per metric the classes, their report, GeoJSON features and centroid points;
    the extreme cells with report and features.

    Tables that several others read (statistics, grid, classes) are written to ``out_dir`` first.
    A metric that is no column of the statistics is left out of the result.
    """
    configure(spark)
    out = _folder(spark, out_dir, "map")

    def staged(df: DataFrame, name: str) -> DataFrame:
        _write_zstd(df, f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    stats, grid = staged(cell_stats(anomalies), "cell_stats"), staged(grid, "grid")
    tables = {"cell_stats": stats}
    for metric in usable_metrics(stats, metrics):
        classified = staged(classify(stats, grid, metric), f"classified_{metric}")
        tables |= {
            f"classified_{metric}": classified,
            f"report_{metric}": classification_report(classified),
            f"features_{metric}": class_features(grid, classified, metric),
            f"points_{metric}": centroid_points(grid, classified),
        }
    if extremes:
        found = staged(extreme_cells(stats), "extreme_cells")
        tables |= {
            "extreme_cells": found, "report_extreme": extreme_report(stats, found),
            "features_extreme": extreme_features(grid, found),
        }
    return tables


def timeline_tables(anomalies: DataFrame, cell_id: int | None = None, out_dir: str | None = None) -> dict[str, DataFrame]:
    """Everything about one cell, by default the one with most anomalies, out of one written table."""
    spark = configure(anomalies.sparkSession)
    out = _folder(spark, out_dir, "cell")
    found = timeline.cell_rows(anomalies, cell_id)
    _write_zstd(found, f"{out}/cell_rows")
    rows = spark.read.schema(found.schema).parquet(f"{out}/cell_rows")
    return {
        "timeline": rows.orderBy(TIME), "report": cell_report(rows), "guides": timeline.severity_guides(rows),
        "daily": timeline.daily_stats(rows), "hourly": timeline.hourly_stats(rows), "weekday": timeline.weekday_stats(rows),
        "peak_hours": timeline.peak_hours(rows), "traffic": timeline.traffic_stack(rows),
        "severity": histogram(rows, "severity_score", density=True),
    }
