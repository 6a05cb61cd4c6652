"""Summary tables over all anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W
from pyspark.sql import functions as F

from gridpulse.functions.rounding import fixed_text, round_half_even
from gridpulse.functions.timekeys import calendar_date, hour_of_day, weekday_index, weekday_name
from gridpulse.operators.quantiles import ONE_TASK_VALUES, exact_percentiles
from gridpulse.schemas import KEY, TIME

DESCRIBE_ROWS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def with_calendar(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.withColumns({"hour": hour_of_day(time), "day_of_week": weekday_name(time)})


def describe(df: DataFrame, column: str, one_task: int = ONE_TASK_VALUES) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles as ``(position, statistic, value)``;
    NaN is left out, as NULL is; a column without values gives no rows."""
    quartiles = exact_percentiles(df, column, (0.25, 0.50, 0.75), one_task)
    x = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    row = df.agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"),
    )
    q25, q50, q75 = [F.lit(q).cast("double") for q in quartiles]
    values = F.array("n", "mean", "std", "lo", q25, q50, q75, "hi")
    names = F.array(*[F.lit(s) for s in DESCRIBE_ROWS])
    return row.where("n > 0").select(F.posexplode(F.arrays_zip(names.alias("statistic"), values.alias("value")))).select(
        F.col("pos").alias("position"), "col.statistic", "col.value"
    )


def value_counts(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows per value; order it with `ranked` where the largest come first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, *ties: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), *ties)


def top_cells(anomalies: DataFrame, limit: int = 5, key: str = KEY) -> DataFrame:
    """The cells with most anomalies, equal counts by id."""
    return ranked(value_counts(anomalies, key), key).limit(limit)


def most_severe(anomalies: DataFrame, limit: int = 5, key: str = KEY, time: str = TIME) -> DataFrame:
    return anomalies.orderBy(F.desc("severity_score"), key, time).limit(limit)


def by_weekday(anomalies: DataFrame, time: str = TIME) -> DataFrame:
    """Anomalies per weekday, most first, equal counts in week order."""
    counts = value_counts(anomalies, weekday_name(time).alias("day_of_week"), weekday_index(time).alias("_d"))
    return ranked(counts, "_d").drop("_d")


def by_hour(anomalies: DataFrame, time: str = TIME) -> DataFrame:
    return value_counts(anomalies, hour_of_day(time).alias("hour")).orderBy("hour")


def date_range(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.agg(calendar_date(F.min(time)).alias("first_date"), calendar_date(F.max(time)).alias("last_date"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(f"distinct_{column}"))


def reference_week_distribution(reference_weeks: DataFrame, key: str = KEY) -> DataFrame:
    """How many reference weeks cells have, described."""
    return describe(value_counts(reference_weeks, key), "n")


def stage_yield(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each stage table and the reduction against the stage before, in percent."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "rows")
        for i, (name, df) in enumerate(stages.items())
    ]
    before = F.lag("rows").over(W.orderBy("position"))
    return reduce(DataFrame.unionByName, counts).withColumn(
        "reduction_percent", 100.0 - F.try_divide(F.col("rows") * 100.0, before)
    )


def observed(df: DataFrame, name: str, time: str = TIME) -> tuple[DataFrame, Observation]:
    """Count rows and note the time range while they are written: ``observation.get`` after the action has
    ``rows``, ``first_time`` and ``last_time`` without a scan of its own.

    Observe behind the last shuffle: what lies before one may run more than once.
    """
    observation = Observation(name)
    when = F.col(time) if time in df.columns else F.lit(None).cast("timestamp")
    return df.observe(
        observation, F.count(F.lit(1)).alias("rows"), F.min(when).alias("first_time"), F.max(when).alias("last_time")), observation


def observed_yield(spark: SparkSession, stages: Mapping[str, Observation]) -> DataFrame:
    """`stage_yield` and the time range of stages out of what was observed while they were written; reads nothing."""
    rows, before = [], None
    for i, (name, observation) in enumerate(stages.items()):
        seen = observation.get
        lost = None if not before else 100.0 - seen["rows"] * 100.0 / before
        rows.append((i, name, seen["rows"], lost, seen["first_time"], seen["last_time"]))
        before = seen["rows"]
    return spark.createDataFrame(
        rows, "position int, stage string, rows bigint, reduction_percent double, first_time timestamp, last_time timestamp")


def section(df: DataFrame, name: str, base: int, key: Column, value: Column, order: Sequence[Column]) -> DataFrame:
    """Rows of a small table as report lines; ``base`` places the section in the report."""
    place = F.row_number().over(W.orderBy(*order))
    return df.select(
        (place + base).alias("position"), F.lit(name).alias("section"),
        key.cast("string").alias("key"), value.cast("string").alias("value"),
    )


def facts(row: DataFrame, name: str, base: int, values: Mapping[str, Column]) -> DataFrame:
    """The named values of a one-row table as report lines."""
    items = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return row.select(F.posexplode(items)).select(
        (F.col("pos") + 1 + base).alias("position"), F.lit(name).alias("section"), "col.key", "col.value"
    )


def grouped_digits(c: Column) -> Column:
    return F.format_string("%,d", c)


def anomaly_summary(anomalies: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """The whole summary as ``(position, section, key, value)``; empty input gives no rows."""
    overview = anomalies.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("cells"),
        calendar_date(F.min(time)).alias("first"), calendar_date(F.max(time)).alias("last"),
    ).where("n > 0")
    described = describe(anomalies, "severity_score")
    # 168 rows at most; both sections below sum them up again out of the same exchange.
    hours = value_counts(
        anomalies, weekday_name(time).alias("day"), weekday_index(time).alias("d"), hour_of_day(time).alias("hour")
    )
    days, day_hours = hours.groupBy("day", "d").agg(F.sum("n").alias("n")), hours.groupBy("hour").agg(F.sum("n").alias("n"))
    parts = [
        facts(overview, "overview", 0, {
            "Total Anomalies Detected": grouped_digits(F.col("n")),
            "Unique Cells with Anomalies": grouped_digits(F.col("cells")),
            "Date Range": F.concat_ws(" to ", F.col("first"), F.col("last")),
        }),
        section(described, "severity_score", 100, F.col("statistic"),
                fixed_text(round_half_even("value"), 2), [F.col("position")]),
        section(top_cells(anomalies, 5, key), "top_cells", 200, F.col(key), F.col("n"), [F.desc("n"), F.col(key)]),
        section(days, "day_of_week", 300, F.col("day"), F.col("n"), [F.desc("n"), F.col("d")]),
        section(day_hours, "hour", 400, F.col("hour"), F.col("n"), [F.col("hour")]),
    ]
    return reduce(DataFrame.unionByName, parts)
