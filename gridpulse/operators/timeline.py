"""Drill-down into the anomalies of one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridpulse.functions.rounding import round_half_even
from gridpulse.functions.timekeys import (
    WEEKDAYS, calendar_date, hour_of_day, iso_week, weekday_index, weekday_name, weekday_short,
)
from gridpulse.operators.quantiles import ONE_TASK_VALUES, exact_percentiles
from gridpulse.schemas import FEATURES, KEY, TIME


def most_extreme_cell(anomalies: DataFrame, key: str = KEY) -> DataFrame:
    """The cell with most anomalies, the lowest id among equals: ``(cell_id, n)``, no row if empty."""
    counts = anomalies.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(1)


def cell_rows(
    anomalies: DataFrame, cell_id: int | None = None, key: str = KEY, time: str = TIME
) -> DataFrame:
    """One cell's anomalies with calendar columns, unordered; the most extreme cell by default.

    A given cell is a literal that prunes row groups; a cell without anomalies is an error.
    """
    if cell_id is None:
        wanted = most_extreme_cell(anomalies, key).select(key).scalar()
        rows = anomalies.where(F.col(key) == wanted)
    else:
        rows = anomalies.where(F.col(key) == F.lit(cell_id))
        if rows.isEmpty():
            raise ValueError(f"no anomalies in cell {cell_id}")
    return rows.withColumns({
        "hour": hour_of_day(time), "date": calendar_date(time),
        "day_of_week": weekday_name(time), "week": iso_week(time),
    })


def cell_timeline(
    anomalies: DataFrame, cell_id: int | None = None, key: str = KEY, time: str = TIME
) -> DataFrame:
    """`cell_rows` in time order, for a listing; the tables below need no order."""
    return cell_rows(anomalies, cell_id, key, time).orderBy(time)


def daily_stats(timeline: DataFrame) -> DataFrame:
    s = F.col("severity_score")
    return timeline.groupBy("date").agg(
        F.count(s).alias("n"),
        round_half_even(F.avg(s)).alias("mean_severity"), round_half_even(F.max(s)).alias("max_severity"),
    )


def hourly_stats(timeline: DataFrame) -> DataFrame:
    s = F.col("severity_score")
    return timeline.groupBy("hour").agg(F.count(s).alias("n"), round_half_even(F.avg(s)).alias("mean_severity"))


def weekday_stats(timeline: DataFrame) -> DataFrame:
    """All seven days; NULL where the cell has no anomaly on a weekday."""
    s = F.col("severity_score")
    found = timeline.groupBy("day_of_week").agg(F.count(s).alias("n"), round_half_even(F.avg(s)).alias("mean_severity"))
    week = timeline.sparkSession.createDataFrame(
        [(i, d, d[:3]) for i, d in enumerate(WEEKDAYS)], "position int, day_of_week string, label string"
    )
    return week.join(F.broadcast(found), "day_of_week", "left").select(
        "position", "day_of_week", "label", "n", "mean_severity"
    )


def peak_hours(timeline: DataFrame, limit: int = 3) -> DataFrame:
    """The hours with most anomalies, the earlier one among equals."""
    return hourly_stats(timeline).select("hour", "n").orderBy(F.desc("n"), "hour").limit(limit)


def temporal_peaks(timeline: DataFrame, time: str = TIME) -> DataFrame:
    """One row: modal hour, weekday and date and the most anomalies on a date; earliest among equals.

    All three come from one grouping to hours of dates, a small table.
    """
    hours = timeline.groupBy("date", "hour", "day_of_week", weekday_index(time).alias("d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = hours.groupingSets(
        [["hour"], ["day_of_week", "d"], ["date"]], "hour", "day_of_week", "d", "date"
    ).agg(F.sum("n").alias("n"))

    def peak(column: str, order: Column) -> Column:
        present = F.when(F.col(column).isNotNull(), F.struct("n", order))
        return F.max_by(column, present)

    return sums.agg(
        peak("hour", -F.col("hour")).alias("peak_hour"),
        peak("day_of_week", -F.col("d")).alias("peak_day"),
        peak("date", -F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("peak_date"),
        F.max(F.when(F.col("date").isNotNull(), F.col("n"))).alias("max_daily_anomalies"),
    )


def cell_profile(
    timeline: DataFrame, time: str = TIME, features: tuple[str, ...] = FEATURES, one_task: int = ONE_TASK_VALUES
) -> DataFrame:
    """One row: activity, severity profile with exact percentiles, and traffic means and maxima."""
    s = F.col("severity_score")
    median, p95, p99 = exact_percentiles(timeline, s, (0.5, 0.95, 0.99), one_task)
    row = timeline.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"),
        F.count_distinct("date").alias("days_active"),
        F.min(s).alias("min_severity"), F.max(s).alias("max_severity"),
        F.avg(s).alias("mean_severity"), F.stddev_samp(s).alias("std_severity"),
        *[F.avg(f).alias(f"avg_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features],
    )
    return row.withColumns({
        "anomalies_per_day": F.try_divide(F.col("total_anomalies").cast("double"), F.col("days_active").cast("double")),
        "median_severity": F.lit(median).cast("double"),
        "p95_severity": F.lit(p95).cast("double"),
        "p99_severity": F.lit(p99).cast("double"),
    })


def top_severe(timeline: DataFrame, limit: int = 10, time: str = TIME, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The most severe rows with their rank, the earlier one among equals."""
    top = timeline.select(time, "severity_score", *features).orderBy(F.desc("severity_score"), time).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("severity_score"), time)))


def traffic_stack(timeline: DataFrame, time: str = TIME) -> DataFrame:
    """Severity with the stacked traffic edges: SMS, then SMS plus calls."""
    return timeline.select(
        time, "severity_score", F.col("sms_total").alias("sms_edge"),
        (F.col("sms_total") + F.col("calls_total")).alias("calls_edge"),
    )


def severity_guides(timeline: DataFrame) -> DataFrame:
    """One row: the 95th percentile, mean and median lines of a severity chart."""
    p95, median = exact_percentiles(timeline, "severity_score", (0.95, 0.5))
    return timeline.agg(F.avg("severity_score").alias("mean")).select(
        F.lit(p95).cast("double").alias("p95"), "mean", F.lit(median).cast("double").alias("median")
    )


def short_days(timeline: DataFrame, time: str = TIME) -> DataFrame:
    """Rows per three-letter weekday."""
    return timeline.groupBy(weekday_short(time).alias("label")).agg(F.count(F.lit(1)).alias("n"))
