"""Data-quality gates and checks. A check is a small table; a gate raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.schemas import CONTRACTS, FEATURES, KEY, TIME, VALUE_RANGES
from gridpulse.sources.raw import non_finite

FINDING = "check string, subject string, level string, n bigint"
ERROR, WARNING, INFO = "error", "warning", "info"
WEEK_LABEL = r"^\d{4}_W\d{2}$"
# Severities counted as severe and as extreme.
SEVERE_SIGMA, EXTREME_SIGMA = 10, 100


def duplicate_keys(df: DataFrame, keys: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def column_profile(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]] = VALUE_RANGES) -> DataFrame:
    """``(column, rows, nulls, non_finite, min_value, max_value, violations)`` of every column in one pass.

    ``non_finite`` counts NaN and infinities, which are no NULLs and fit no range. Extremes and violations are NULL for a column without a range."""
    profiles = []
    for c in df.columns:
        x = _scalar_key(df, c)
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        ranged = c in ranges
        none = F.lit(None).cast("double")
        profiles.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
            (F.count_if(non_finite(c)) if floating else F.lit(0).cast("bigint")).alias("non_finite"),
            (F.min(x).cast("double") if ranged else none).alias("min_value"),
            (F.max(x).cast("double") if ranged else none).alias("max_value"),
            (F.count_if(_outside(x, *ranges[c])) if ranged else F.lit(None).cast("bigint")).alias("violations"),
        ))
    return df.agg(F.array(*profiles).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def null_share() -> Column:
    return F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double"))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls, null_share)`` of every column in one pass."""
    return column_profile(df, {}).select("column", "nulls", null_share().alias("null_share"))


def require_clean(traffic: DataFrame, keys: Sequence[str] = (KEY, TIME), known_unique: bool = False) -> DataFrame:
    """The gate after aggregation: duplicate keys, NULLs, NaN and infinities are errors.

    In a panel read from files clustered on the keys, duplicates are looked for among neighbours; in any other the rows are
    shuffled. ``known_unique`` skips it for a panel that comes straight out of a grouping on the keys.
    """
    from gridpulse.operators.ordered import clustered_duplicates

    if not known_unique:
        duplicates = clustered_duplicates(traffic, keys).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if duplicates:
            raise ValueError(f"{duplicates} rows share a key")
    nulls, strange = column_profile(traffic, {}).agg(F.sum("nulls"), F.sum("non_finite")).first()
    if nulls:
        raise ValueError(f"{nulls} NULL values")
    if strange:
        raise ValueError(f"{strange} values are NaN or infinite")
    return traffic


def detect_contract(df: DataFrame) -> str | None:
    """The contract whose required columns are all present, the most demanding one first."""
    fitting = [n for n, c in CONTRACTS.items() if set(c.fieldNames()) <= set(df.columns)]
    return max(fitting, key=lambda n: len(CONTRACTS[n].fieldNames()), default=None)


def nearest_contract(df: DataFrame) -> str:
    """The contract most of whose columns are present; of equals the one that misses fewer, then by name."""

    def nearness(name: str) -> tuple[int, int, str]:
        wanted = set(CONTRACTS[name].fieldNames())
        present = len(wanted & set(df.columns))
        return -present, len(wanted) - present, name

    return min(CONTRACTS, key=nearness)


def _compatible(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(found, T.ArrayType):
        found = found.elementType
    families = [
        (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType),
        (T.TimestampType, T.TimestampNTZType), (T.StringType,), (T.BooleanType,),
    ]
    return any(isinstance(found, f) and isinstance(wanted, f) for f in families)


def schema_findings(df: DataFrame, contract: str) -> list[tuple[str, str, str, int]]:
    """Missing columns are errors, incompatible types warnings, extra columns notes. Reads no data."""
    wanted = {f.name: f.dataType for f in CONTRACTS[contract].fields}
    found = {f.name: f.dataType for f in df.schema.fields}
    out = [("missing_column", c, ERROR, 1) for c in wanted if c not in found]
    out += [("extra_column", c, INFO, 1) for c in found if c not in wanted]
    out += [("type_mismatch", c, WARNING, 1) for c in wanted if c in found and not _compatible(found[c], wanted[c])]
    return out


def schema_check(df: DataFrame, contract: str) -> DataFrame:
    return df.sparkSession.createDataFrame(schema_findings(df, contract), FINDING)


def _scalar_key(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.try_element_at(F.col(column), F.lit(1))
    return F.col(column)


def _outside(x: Column, low: float | None, high: float | None) -> Column:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (x < low)
    if high is not None:
        outside = outside | (x > high)
    return outside


def range_checks(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]] = VALUE_RANGES) -> DataFrame:
    """``(column, min_value, max_value, violations)`` of each column with a range, in one pass."""
    columns = [c for c in ranges if c in df.columns]
    return column_profile(df.select(*columns), ranges).select("column", "min_value", "max_value", "violations")


def negative_counts(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) < 0).alias("negatives")) for c in columns])
    return df.agg(items.alias("a")).select(F.explode("a").alias("c")).select("c.*")


def week_format(reference_weeks: DataFrame) -> DataFrame:
    """One row: labels in all and labels that are not ``YYYY_Www``."""
    fine = F.col("reference_week").rlike(WEEK_LABEL)
    return reference_weeks.agg(F.count(F.lit(1)).alias("labels"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("malformed"))


def unknown_cells(df: DataFrame, grid: DataFrame, key: str = KEY) -> DataFrame:
    """Cells of the data that are not on the grid; reduced to distinct ids before the join."""
    return df.select(_scalar_key(df, key).alias(key)).distinct().join(grid.select(key), key, "left_anti")


def grid_coverage(df: DataFrame, grid: DataFrame, key: str = KEY) -> DataFrame:
    """One row: grid cells, data cells, cells in both, and the covered share of the grid in percent."""
    ours = df.select(_scalar_key(df, key).alias(key)).distinct().withColumn("ours", F.lit(True))
    theirs = grid.select(key).distinct().withColumn("theirs", F.lit(True))
    row = ours.join(theirs, key, "full_outer").agg(
        F.count("theirs").alias("grid_cells"), F.count("ours").alias("data_cells"),
        F.count_if(F.col("ours") & F.col("theirs")).alias("covered_cells"),
    )
    return row.withColumn("coverage_percent", F.try_divide(F.col("covered_cells") * 100.0, F.col("grid_cells")))


def severity_bands(anomalies: DataFrame) -> DataFrame:
    """One row: anomalies, those above 10 and above 100 standard deviations."""
    s = F.col("severity_score")
    return anomalies.agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(s > SEVERE_SIGMA).alias("severe"),
        F.count_if(s > EXTREME_SIGMA).alias("extreme"),
    )


def stage_consistency(stages: Mapping[str, DataFrame], key: str = KEY, time: str = TIME) -> DataFrame:
    """Per stage: rows, cells and time range, and whether both fit the first stage: as many cells,
    no time outside its range."""
    rows = []
    for i, (name, df) in enumerate(stages.items()):
        when = F.col(time) if time in df.columns else F.lit(None).cast("timestamp")
        rows.append(df.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("cells"),
            F.min(when).alias("first_time"), F.max(when).alias("last_time"),
        ).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "rows", "cells", "first_time", "last_time"))
    # One row per stage: a window over them has the first stage's figures without reading it again.
    table = reduce(DataFrame.unionByName, rows)
    first = W.partitionBy(F.lit(0)).orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cells, start, end = [F.first(c).over(first) for c in ("cells", "first_time", "last_time")]
    return table.withColumns({
        "same_cells": F.col("cells") == cells,
        "time_within": F.coalesce((F.col("first_time") >= start) & (F.col("last_time") <= end), F.lit(True)),
    })


def reconcile_sums(ingested: DataFrame, traffic: DataFrame) -> DataFrame:
    """Nothing is lost in aggregation: ``(feature, before, after)`` totals, one pass over each table."""
    before = ingested.agg(*[
        F.coalesce(F.sum(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)) if b is not None else a), F.lit(0.0)).alias(f)
        for f, a, b in (
            ("sms_total", F.col("sms_in"), F.col("sms_out")), ("calls_total", F.col("call_in"), F.col("call_out")),
            ("internet_traffic", F.col("internet_traffic"), None))
    ])
    after = traffic.agg(*[F.coalesce(F.sum(f), F.lit(0.0)).alias(f) for f in FEATURES])

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias(name)) for f in FEATURES])
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    return long(before, "before").join(long(after, "after"), "feature")


def recheck(
    stored: DataFrame, again: DataFrame, column: str, keys: Sequence[str] = (KEY, TIME), tolerance: float = 1e-6,
) -> DataFrame:
    """One row: records in both tables, only stored, only computed again, and those that differ by more
    than ``tolerance`` of their size."""
    left = stored.select(*keys, F.col(column).alias("_stored"), F.lit(True).alias("_a"))
    right = again.select(*keys, F.col(column).alias("_again"), F.lit(True).alias("_b"))
    apart = F.abs(F.col("_stored") - F.col("_again")) > tolerance * F.greatest(F.lit(1.0), F.abs("_stored"))
    return left.join(right, list(keys), "full_outer").agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_stored"),
        F.count_if(F.col("_a").isNull()).alias("only_again"), F.count_if(apart).alias("different"))


def validate(
    df: DataFrame, contract: str = "auto", grid: DataFrame | None = None, null_warning: float = 0.0,
    null_error: float = 0.1, key: str = KEY,
) -> DataFrame:
    """All checks on one stage table as ``(check, subject, level, n)``; no rows above ``info`` means fit.

    Nulls warn above ``null_warning`` and fail above ``null_error`` (shares of the rows); values
    out of range warn; NaN, infinities and cells off the grid fail. A table that fits no contract is
    compared with the nearest one, so that a missing column is named, and the columns it has are checked all the same.
    """
    spark: SparkSession = df.sparkSession
    name = detect_contract(df) if contract == "auto" else contract
    if name is None:
        unknown = [("unknown_schema", ",".join(df.columns), ERROR, 1)]
        parts = [spark.createDataFrame(unknown + schema_findings(df, nearest_contract(df)), FINDING)]
    else:
        parts = [schema_check(df, name)]
    level = F.when(null_share() > null_error, ERROR).when(null_share() > null_warning, WARNING)
    found = F.filter(F.array(
        F.struct(F.lit("nulls").alias("check"), F.col("column").alias("subject"), level.alias("level"), F.col("nulls").alias("n")),
        F.struct(
            F.lit("range").alias("check"), F.col("column").alias("subject"),
            F.when(F.col("violations") > 0, WARNING).alias("level"), F.col("violations").alias("n"),
        ),
        F.struct(
            F.lit("non_finite").alias("check"), F.col("column").alias("subject"),
            F.when(F.col("non_finite") > 0, ERROR).alias("level"), F.col("non_finite").alias("n"),
        ),
    ), lambda f: f["level"].isNotNull())
    parts.append(column_profile(df).select(F.explode(found).alias("f")).select("f.*"))
    if "reference_week" in df.columns:
        parts.append(week_format(df).where("malformed > 0").select(
            F.lit("week_format").alias("check"), F.lit("reference_week").alias("subject"),
            F.lit(ERROR).alias("level"), F.col("malformed").alias("n")))
    if grid is not None and key in df.columns:
        parts.append(unknown_cells(df, grid, key).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
            F.lit("unknown_cells").alias("check"), F.lit(key).alias("subject"), F.lit(ERROR).alias("level"), "n"))
    return reduce(DataFrame.unionByName, parts)


def validate_stages(stages: Mapping[str, DataFrame], grid: DataFrame | None = None, **options) -> DataFrame:
    """`validate` for several tables at once, with the table's name in the column ``stage``.

    Cells of a panel for which a table of reference weeks beside it has none are a warning: they cannot be modelled.
    """
    parts = [
        validate(df, grid=grid, **options).select(F.lit(name).alias("stage"), "*") for name, df in stages.items()
    ]
    key = options.get("key", KEY)
    for panel in (df for df in stages.values() if detect_contract(df) == "preprocessed"):
        for name, weeks in stages.items():
            if "reference_week" in weeks.columns:
                bare = panel.select(_scalar_key(panel, key).alias(key)).distinct().join(
                    weeks.where("reference_week IS NOT NULL").select(_scalar_key(weeks, key).alias(key)).distinct(), key, "left_anti")
                parts.append(bare.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
                    F.lit(name).alias("stage"), F.lit("cells_without_weeks").alias("check"), F.lit(key).alias("subject"),
                    F.lit(WARNING).alias("level"), "n"))
    return reduce(DataFrame.unionByName, parts)
