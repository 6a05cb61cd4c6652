"""Per-cell orthogonal-subspace model: fit on reference weeks, score every record, flag anomalies.

The principal subspace of a cell's standardised training rows is that of their p×p second-moment
matrix, so fitting is two aggregations over the training rows and one small eigen-decomposition
per cell. No cell's rows ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridpulse.functions.subspace import (
    DOUBLE_EPSILON, ZERO_RESIDUAL, ZERO_SCALE, flat_model, principal_axes, raw_residual, snap,
)
from gridpulse.functions.timekeys import label_index, label_number, week_index, week_number, week_start
from gridpulse.operators.joins import PART_ROWS, BucketedPanel, Lookup
from gridpulse.schemas import FEATURES, KEY, TIME, WEEK

_ERRORS = ("mean_error", "std_error", "threshold")


def _width(features: Sequence[str]) -> int:
    """Values in a row of the flat model: map, means, error statistics."""
    return len(features) * (len(features) + 1) + len(_ERRORS) + 1


def _week_keys(reference_weeks: DataFrame, key: str) -> DataFrame:
    return reference_weeks.select(key, label_number("reference_week").alias("year_week")).distinct()


def listed_weeks(reference_weeks: DataFrame, column: str) -> DataFrame | None:
    """The distinct reference weeks as `week_index` values; None without any.

    A calendar of the years 1 to 9999 has 521,722 weeks, so the table always fits a broadcast. The comparison with the
    first and last label drops nothing; Spark prunes folders at run time only by a side that compares a column of its own.
    """
    label = F.col("reference_week")
    first, last = reference_weeks.agg(F.min(label), F.max(label)).first()
    if first is None:
        return None
    return reference_weeks.where(label.between(first, last)).select(label_index("reference_week").cast("int").alias(column)).distinct()


def in_listed_weeks(panel: DataFrame, weeks: DataFrame | None, column: str) -> DataFrame:
    """The panel's rows in these weeks. With ``column`` as the panel's folder column only their folders are read."""
    return panel.where("false") if weeks is None else panel.join(F.broadcast(weeks), column, "left_semi")


def mark_reference(
    traffic: DataFrame, reference_weeks: DataFrame, key: str = KEY, time: str = TIME, limit: int | None = None
) -> DataFrame:
    """All rows, with ``is_reference``: is the row's ISO week a reference week of its cell?"""
    marks = _week_keys(reference_weeks, key).withColumn("is_reference", F.lit(True))
    lookup = Lookup(traffic, key, reference_weeks.count(), limit=limit)
    marked = lookup.join(marks, "left", ["year_week"], lambda p: p.withColumn("year_week", week_number(time)))
    return marked.select(*traffic.columns, F.coalesce("is_reference", F.lit(False)).alias("is_reference"))


def training_rows(
    traffic: DataFrame, reference_weeks: DataFrame, key: str = KEY, time: str = TIME, limit: int | None = None,
    week: str | None = None,
) -> DataFrame:
    """Only the rows in a reference week of their cell; ``week`` names the folder column of a panel written by week."""
    given = in_listed_weeks(traffic, listed_weeks(reference_weeks, week), week) if week else traffic
    lookup = Lookup(given, key, reference_weeks.count(), limit=limit)
    kept = lookup.join(
        _week_keys(reference_weeks, key), "left_semi", ["year_week"],
        lambda p: p.withColumn("year_week", week_number(time)),
    )
    return kept.select(*traffic.columns)


def moment_aggregates(features: Sequence[str] = FEATURES) -> dict[str, Column]:
    """One-pass count, mean, population spread and co-moments, in numerically stable running form."""
    out = {"n_train": F.count(F.lit(1))}
    for i, f in enumerate(features):
        out[f"mean_{i}"], out[f"spread_{i}"] = F.avg(f), F.stddev_pop(f)
        for j in range(i):
            out[f"co_{j}_{i}"] = F.covar_pop(features[j], f)
    return out


def _scaled_sums(train: DataFrame, aggregates: dict[str, Column], features: Sequence[str], key: str) -> DataFrame:
    """The aggregates per cell, with the scale of each feature."""
    return _with_scales(train.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()]), features)


def _with_scales(sums: DataFrame, features: Sequence[str]) -> DataFrame:
    """The scale of a feature is its spread, or 1 where that is no more than the rounding error of n values of the
    feature's size."""
    scale = (
        "CASE WHEN spread_{i} <= greatest(n_train * abs(mean_{i}) * %r, %r) THEN 1.0D ELSE spread_{i} END"
        % (DOUBLE_EPSILON, ZERO_SCALE)
    )
    return sums.withColumns({f"scale_{i}": F.expr(scale.format(i=i)) for i in range(len(features))})


def scaler(train: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY) -> DataFrame:
    """Per cell mean and population standard deviation of each feature; the scale of a constant is 1."""
    wanted = {n: a for n, a in moment_aggregates(features).items() if not n.startswith("co_")}
    p = range(len(features))
    return _scaled_sums(train, wanted, features, key).select(
        key, "n_train", F.array(*[f"mean_{i}" for i in p]).alias("mean"), F.array(*[f"scale_{i}" for i in p]).alias("scale")
    )


def week_moments(traffic: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY, time: str = TIME) -> DataFrame:
    """``(cell_id, week, n_train, mean_i, spread_i, co_i_j)``: what a model's axes need of each cell and week.

    Some fifteen numbers a cell and week. The tables of several loads may simply be put together, also where a week is spread
    over them: `merged_moments` merges whatever rows there are. A new month or another choice of weeks then refits
    without reading the old panel.
    """
    finite = " AND ".join([f"`{key}` IS NOT NULL", f"`{time}` IS NOT NULL", *[f"abs(`{f}`) < double('Infinity')" for f in features]])
    return traffic.where(finite).groupBy(key, week_index(time).cast("int").alias(WEEK)).agg(
        *[a.alias(n) for n, a in moment_aggregates(features).items()])


def merged_moments(moments: DataFrame, reference_weeks: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY) -> DataFrame:
    """The moments of each cell's reference weeks taken together: pairwise merging, free of cancellation.

    Works on a few rows a cell. Means are merged first; then every week adds its own co-moments and those of the distance
    of its means from the cell's.
    """
    chosen = moments.join(
        reference_weeks.select(key, label_index("reference_week").cast("int").alias(WEEK)).distinct(), [key, WEEK], "left_semi")
    cell = W.partitionBy(key)
    total = F.sum("n_train").over(cell)
    held = chosen.withColumns({
        f"_mean_{i}": F.sum(F.col("n_train") * F.col(f"mean_{i}")).over(cell) / total for i in range(len(features))})
    out = {"n_train": F.sum("n_train")}
    for i in range(len(features)):
        out[f"mean_{i}"] = F.first(f"_mean_{i}")
        out[f"spread_{i}"] = F.sqrt(F.sum(F.expr(f"n_train * (spread_{i} * spread_{i} + pow(mean_{i} - _mean_{i}, 2))")) / F.sum("n_train"))
        for j in range(i):
            out[f"co_{j}_{i}"] = F.sum(F.expr(
                f"n_train * (co_{j}_{i} + (mean_{j} - _mean_{j}) * (mean_{i} - _mean_{i}))")) / F.sum("n_train")
    return held.groupBy(key).agg(*[a.alias(n) for n, a in out.items()])


def _moment(i: int, j: int, standardize: bool) -> Column:
    """Entry of the second-moment matrix of the rows as the model sees them."""
    i, j = min(i, j), max(i, j)
    co = f"co_{i}_{j}" if i != j else f"spread_{i} * spread_{i}"
    return F.expr(f"{co} / (scale_{i} * scale_{j})" if standardize else f"{co} + mean_{i} * mean_{j}")


def moment_matrix(
    train: DataFrame, standardize: bool = True, features: Sequence[str] = FEATURES, key: str = KEY
) -> DataFrame:
    """``(cell_id, mean, scale, moments)``, one row per cell with training rows; ``moments`` is flat."""
    return _moment_rows(_scaled_sums(train, moment_aggregates(features), features, key), standardize, features, key)


def _moment_rows(sums: DataFrame, standardize: bool, features: Sequence[str], key: str) -> DataFrame:
    p = range(len(features))
    mean, scale = [F.col(f"mean_{i}") for i in p], [F.col(f"scale_{i}") for i in p]
    if not standardize:
        mean, scale = [F.lit(0.0) for _ in p], [F.lit(1.0) for _ in p]
    return sums.select(
        key, F.array(*mean).alias("mean"), F.array(*scale).alias("scale"),
        F.array(*[_moment(i, j, standardize) for i in p for j in p]).alias("moments"),
    )


class SubspaceDetector:
    """Fit, score and flag one panel against its reference weeks as a single lazy plan.

    Building it counts the reference weeks. Everything joined to the panel has at most that many
    rows: few enough and it is broadcast, else the panel is shuffled once, salted on hot cells.
    ``week`` names the folder column of a panel written by `write_weekly`: training then reads the listed
    weeks' folders only, found at run time, and only scoring reads the rest. ``moments`` is a table of `week_moments`: the
    axes then come from it, and only the error statistics read training rows.
    """

    def __init__(
        self, traffic: DataFrame, reference_weeks: DataFrame, n_components: int = 2,
        anomaly_threshold: float = 2.0, standardize: bool = True, features: Sequence[str] = FEATURES,
        key: str = KEY, time: str = TIME, limit: int | None = None, part_rows: int = PART_ROWS, week: str | None = None,
        moments: DataFrame | None = None,
    ):
        if n_components < 1:
            raise ValueError("n_components must be at least 1")
        self.features, self.key, self.time, self.week = tuple(features), key, time, week
        self.moments, self.reference_weeks = moments, reference_weeks
        self.k, self.t, self.standardize = n_components, anomaly_threshold, standardize
        # The same columns and filter feed every pass, so a shuffled panel is one exchange for all of
        # them. A clean panel has no NULLs, NaN or infinities; a row with one could be neither trained on
        # nor scored, and `losses` counts it.
        self.given = traffic.select(key, time, *features, *([week] if week else []))
        panel = self.given.where(self._usable())
        index = label_index("reference_week")
        rows, first, last = reference_weeks.agg(F.count(F.lit(1)), F.min(index), F.max(index)).first()
        self.lookup = Lookup(panel, key, rows, _width(features), limit, part_rows)
        # A panel written by week is trained on from the folders of listed weeks alone, whatever their span.
        self.training = self.lookup if not week else Lookup(
            in_listed_weeks(panel, listed_weeks(reference_weeks, week), week), key, rows, _width(features), limit, part_rows)
        # One row per cell with the few weeks it may train on.
        self.weeks = reference_weeks.groupBy(key).agg(F.collect_set(index).alias("_weeks"))
        # From the first to the last of all those weeks: a range that prunes files. A shuffled panel is read once anyway.
        self.trained = None if first is None or week or not self.lookup.broadcast else (
            (F.col(time) >= F.lit(week_start(first)).cast("timestamp")) & (F.col(time) < F.lit(week_start(last + 1)).cast("timestamp")))

    def _usable(self) -> str:
        finite = [f"abs(`{f}`) < double('Infinity')" for f in self.features]
        return " AND ".join([f"`{self.key}` IS NOT NULL", f"`{self.time}` IS NOT NULL", *finite])

    def losses(self, model: DataFrame | None = None) -> DataFrame:
        """What detection leaves out, per cell: ``(cell, rows, rows_skipped, not_modelled)``.

        Skipped are rows with a NULL, NaN or infinite value. ``not_modelled`` tells why a cell has no model:
        no reference week, no usable row in its weeks, or values too large for their second moments.
        Cells without losses are not listed.
        """
        usable = F.coalesce(F.expr(self._usable()), F.lit(False))
        counts = self.given.groupBy(self.key).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~usable).alias("rows_skipped"))
        model = self.basis() if model is None else model
        fitted = model.select(self.key, F.lit(True).alias("_fitted"), F.col("rank").isNotNull().alias("_finite"))
        dated = self.weeks.select(self.key, F.lit(True).alias("_dated"))
        why = (
            F.when(F.col("_dated").isNull(), "no reference week").when(F.col("_fitted").isNull(), "no training row")
            .when(~F.col("_finite"), "moments overflow")
        )
        table = counts.join(dated, self.key, "left").join(fitted, self.key, "left")
        return table.select(self.key, "rows", "rows_skipped", why.alias("not_modelled")).where(
            "rows_skipped > 0 OR not_modelled IS NOT NULL")

    def _training(self, table: DataFrame) -> DataFrame:
        joined = self.training.join(table, panel=lambda p: p if self.trained is None else p.where(self.trained))
        return joined.where(F.array_contains("_weeks", F.col(self.week).cast("long") if self.week else week_index(self.time)))

    def basis(self) -> DataFrame:
        """Standardisation and axes per cell, before the error threshold is known."""
        p = len(self.features)
        if self.moments is None:
            moments = moment_matrix(self._training(self.weeks), self.standardize, self.features, self.key)
        else:
            merged = merged_moments(self.moments, self.reference_weeks, self.features, self.key)
            moments = _moment_rows(_with_scales(merged, self.features), self.standardize, self.features, self.key)
        axes = moments.withColumn("_axes", principal_axes(self.k, p)("moments"))
        # Applied to a row less the mean, so the scaling is part of the map.
        scaled = [F.col("_axes.outside")[i * p + j] / F.col("scale")[j] for i in range(p) for j in range(p)]
        return axes.select(
            self.key, "mean", "scale", "_axes.rank", "_axes.eigenvalues", "_axes.components",
            F.array(*scaled).alias("residual_map"),
        )

    def model(self) -> DataFrame:
        """One row per cell: scaler, rank, axes, residual map and the training-error threshold."""
        basis = self.basis()
        # The joins below are between tables of one row per cell.
        flat = basis.select(self.key, *flat_model(self.features)).join(self.weeks, self.key)
        residuals = self._training(flat).select(self.key, snap(raw_residual(self.features)).alias("_r"))
        errors = residuals.groupBy(self.key).agg(
            F.count("_r").alias("n_train"), F.avg("_r").alias("mean_error"), F.stddev_pop("_r").alias("_spread")
        )
        std_error = F.when(F.col("_spread") <= F.lit(ZERO_RESIDUAL), F.lit(0.0)).otherwise(F.col("_spread"))
        return (
            basis.join(errors, self.key)
            .withColumn("std_error", std_error)
            .withColumn("threshold", F.col("mean_error") + F.lit(self.t) * F.col("std_error"))
            .drop("_spread")
        )

    def scores(self, model: DataFrame | None = None) -> DataFrame:
        """Every row of every modelled cell with its ``anomaly_score`` and the cell's error statistics."""
        return _scored(self.lookup, self.model() if model is None else model, self.features, self.time)

    def anomalies(self, model: DataFrame | None = None) -> DataFrame:
        """Rows above their cell's threshold with the severity in standard deviations."""
        model = self.model() if model is None else model
        # Above the threshold after snapping is the same as above it and above round-off.
        # Without a spread every training row has the threshold's own error, give or take round-off.
        slack = F.when(F.col("std_error") == 0, F.lit(ZERO_RESIDUAL)).otherwise(F.lit(0.0))
        floor = F.greatest(F.col("threshold") + slack, F.lit(ZERO_RESIDUAL)).alias("_floor")
        table = model.select(self.key, *flat_model(self.features), "mean_error", "std_error", floor)
        score = raw_residual(self.features).alias("anomaly_score")
        rows = self.lookup.join(table).select(
            self.key, self.time, score, *self.features, "mean_error", "std_error", "_floor"
        ).where((F.col("anomaly_score") > F.col("_floor")) & (F.col("anomaly_score") < F.lit(float("inf"))))
        excess = F.col("anomaly_score") - F.col("mean_error")
        severity = F.when(F.col("std_error") != 0, excess / F.col("std_error")).otherwise(excess)
        return rows.select(self.key, self.time, "anomaly_score", *self.features, severity.alias("severity_score"))


def _scored(lookup: Lookup, model: DataFrame, features: Sequence[str], time: str) -> DataFrame:
    table = model.select(lookup.key, *flat_model(features), *_ERRORS)
    score = snap(raw_residual(features)).alias("anomaly_score")
    return lookup.join(table).select(lookup.key, time, score, *features, *_ERRORS)


def fit(traffic: DataFrame, reference_weeks: DataFrame, **options) -> DataFrame:
    """The model table; options as for `SubspaceDetector`."""
    return SubspaceDetector(traffic, reference_weeks, **options).model()


def score(
    traffic: DataFrame, model: DataFrame, features: Sequence[str] = FEATURES, key: str = KEY, time: str = TIME,
    limit: int | None = None,
) -> DataFrame:
    """Score any panel against a stored model table."""
    lookup = Lookup(traffic.select(key, time, *features), key, model.count(), _width(features), limit)
    return _scored(lookup, model, features, time)


def score_bucketed(panel: BucketedPanel, model: DataFrame, features: Sequence[str] = FEATURES, time: str = TIME) -> DataFrame:
    """`score` for a panel stored in buckets: no row of it is shuffled, however many models are applied."""
    return _scored(panel, model, features, time)


def detect(traffic: DataFrame, reference_weeks: DataFrame, **options) -> DataFrame:
    """The anomalies table; options as for `SubspaceDetector`."""
    return SubspaceDetector(traffic, reference_weeks, **options).anomalies()
