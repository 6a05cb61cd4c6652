"""The registered queries: every operator over the whole driver tables.

Doubles are rounded to six digits so that results compare across engines; dates are text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions import timekeys as tk
from gridpulse.functions.classes import COUNT_CLASSES
from gridpulse.functions.subspace import standardised
from gridpulse.operators import cells, distribution, geo, ordered, quality, reports, summary, timeline, traffic, weeks
from gridpulse.operators import subspace as sub
from gridpulse.operators.quantiles import exact_percentiles
from gridpulse.plans import panels as p
from gridpulse.schemas import ANOMALIES, FEATURES, KEY, TIME, WEEK
from gridpulse.sources import as_timestamp, finish_ingest, parse_fields, parse_grid, parse_lines, read_anomalies, read_grid, require_grid, unwrap_key
from gridpulse.sources import ingest_losses as ingest_loss_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen integers, show dates as text."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        shown.append(c.alias(name))
    return df.select(*shown)


# --- ingest -----------------------------------------------------------------------------------

@query
def ingest_parse(spark, sf):
    return comparable(finish_ingest(parse_lines(p.event_lines(spark, sf))))


@query
def ingest_fields(spark, sf):
    """The same records split and cast in generated code; imperfect ones take the library's way."""
    return comparable(finish_ingest(parse_fields(p.event_lines(spark, sf))))


@query
def traffic_agg(spark, sf):
    return comparable(traffic.sum_measures(p.events_ingested(spark, sf)))


@query
def merge_directions(spark, sf):
    return comparable(traffic.build_traffic(p.events_ingested(spark, sf)))


@query
def orders_traffic(spark, sf):
    return comparable(traffic.build_traffic(p.orders_ingested(spark, sf)))


@query
def all_null_sum(spark, sf):
    """How often a sum of 0 stands for NULLs only."""
    sums = traffic.sum_measures(p.events_ingested(spark, sf))
    filled = p.events_ingested(spark, sf).groupBy(KEY, TIME).agg(
        *[F.count(m).alias(f"n_{m}") for m in traffic.MEASURES]
    )
    both = sums.join(filled, [KEY, TIME])
    return both.agg(*[F.count_if((F.col(m) == 0) & (F.col(f"n_{m}") == 0)).alias(m) for m in traffic.MEASURES])


@query
def array_key_unwrap(spark, sf):
    arrays = p.events(spark, sf).select(F.array("user_id").alias(KEY), "value")
    return comparable(unwrap_key(arrays).groupBy(KEY).agg(F.count("value").alias("n"), F.sum("value").alias("total")))


@query
def timestamp_parse(spark, sf):
    text = p.events(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(TIME))
    return as_timestamp(text)


@query
def ingest_losses(spark, sf):
    """Records without a time or with one out of range, and values that are NaN or infinite."""
    lines = p.event_lines(spark, sf).withColumn("line", F.regexp_replace("line", "\tbad\t", "\tNaN\t"))
    return ingest_loss_counts(parse_lines(lines.withColumn("line", F.regexp_replace("line", "\tNULL\t", "\t-Infinity\t"))))


@query
def csv_table(spark, sf):
    """Events as CSV text with a header's column order, read under the anomaly contract."""
    row = F.concat_ws(",", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("1.5"), *["value"] * 3, F.lit(""))
    contract = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANOMALIES.fields)
    rows = p.events(spark, sf).select(F.from_csv(row, contract, {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("r"))
    return comparable(as_timestamp(unwrap_key(rows.select("r.*"))))


@query
def anomalies_from_csv(spark, sf):
    """Anomaly records out of CSV files, through the reader that takes any stage table."""
    return comparable(read_anomalies(spark, p.anomalies_csv(spark, sf)))


@query
def grid_parse(spark, sf):
    """The grid out of GeoJSON text, ids as numbers and as text, with the ring's corners."""
    return _rings(require_grid(parse_grid(p.grid_lines(spark, sf))))


@query
def grid_files(spark, sf):
    """The same grid out of GeoJSON files, each read in byte ranges."""
    return _rings(read_grid(spark, p.grid_files(spark, sf)))


def _rings(grid: DataFrame) -> DataFrame:
    ring = F.col("geometry.coordinates")[0]
    return comparable(grid.select(
        KEY, F.col("geometry.type").alias("geometry_type"), F.size(ring).cast("bigint").alias("corners"),
        ring[0][0].alias("west"), ring[0][1].alias("south"), ring[2][0].alias("east"), ring[2][1].alias("north")))


# --- quality ----------------------------------------------------------------------------------

@query
def nearest_contract_findings(spark, sf):
    """A traffic panel without one feature fits no contract: the missing column is named, the others are checked."""
    return quality.validate(p.events_traffic(spark, sf).drop("calls_total"))


@query
def schema_findings(spark, sf):
    """Order lines held against the traffic contract: what is missing, foreign or of another type, and what their values break."""
    lines = p.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_shipdate").cast("string").alias(TIME), F.col("l_quantity").alias(FEATURES[0]), "l_discount")
    found = quality.validate(lines, "preprocessed")
    return found.withColumn("rows", F.lit(lines.count()))


@query
def non_finite_profile(spark, sf):
    """NULLs, NaN and infinities of each column are told apart."""
    return quality.column_profile(p.imperfect_anomalies(spark, sf), {}).select("column", "rows", "nulls", "non_finite")


@query
def sum_reconciliation(spark, sf):
    """Each feature's total before and after aggregation."""
    return comparable(quality.reconcile_sums(p.events_ingested(spark, sf), p.events_traffic(spark, sf)), digits=4)


@query
def severity_recheck(spark, sf):
    """Stored severities against those computed again from a freshly fitted model."""
    detector = p.detector(spark, sf)
    return quality.recheck(p.anomalies(spark, sf), detector.anomalies(), "severity_score")


@query
def stability_recheck(spark, sf):
    """Stored stability scores against those computed again."""
    again = weeks.select_reference_weeks(p.events_traffic(spark, sf))
    return quality.recheck(p.events_weeks(spark, sf), again, "stability_score", ("cell_id", "reference_week"))


@query
def detection_losses(spark, sf):
    """Rows and cells that detection leaves out, on a panel some of whose values are NaN or infinite."""
    odd = F.when(F.col(KEY) % 5 == 1, F.lit(float("nan"))).when(F.col(KEY) % 5 == 2, F.lit(float("inf")))
    first = F.dayofmonth(TIME) == 1
    panel = p.events_traffic(spark, sf).withColumn("sms_total", F.when(first & odd.isNotNull(), odd).otherwise(F.col("sms_total")))
    found = sub.SubspaceDetector(panel, p.events_weeks(spark, sf)).losses()
    return found.withColumn("not_modelled", F.coalesce("not_modelled", F.lit("")))


@query
def dup_keys(spark, sf):
    return quality.duplicate_keys(p.events_ingested(spark, sf))


@query
def dup_keys_clustered(spark, sf):
    """The same out of files clustered on the keys: neighbours are compared, the rows are not shuffled."""
    return ordered.clustered_duplicates(p.events_clustered(spark, sf))


@query
def dup_keys_unordered(spark, sf):
    """Order lines as they lie in their file, which is in no order of the keys."""
    lines = p.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate")
    return ordered.clustered_duplicates(lines, ("l_suppkey", "l_shipdate"))


@query
def null_counts(spark, sf):
    return comparable(quality.null_counts(p.events_ingested(spark, sf)))


@query
def range_checks(spark, sf):
    return comparable(quality.range_checks(p.anomalies(spark, sf)))


@query
def negative_counts(spark, sf):
    return quality.negative_counts(p.table(spark, sf, "customer"), ["c_acctbal", "c_custkey"])


@query
def unknown_cells(spark, sf):
    return quality.unknown_cells(p.events_traffic(spark, sf), p.small_grid(spark, sf))


@query
def grid_coverage(spark, sf):
    return comparable(quality.grid_coverage(p.events_traffic(spark, sf), p.grid(spark, sf)))


@query
def stage_consistency(spark, sf):
    stages = {
        "ingested": p.events_ingested(spark, sf), "traffic": p.events_traffic(spark, sf),
        "reference_weeks": p.events_weeks(spark, sf), "anomalies": p.anomalies(spark, sf),
    }
    return comparable(quality.stage_consistency(stages))


@query
def severity_bands(spark, sf):
    return quality.severity_bands(p.anomalies(spark, sf))


@query
def week_format(spark, sf):
    return quality.week_format(p.events_weeks(spark, sf))


@query
def validate_traffic(spark, sf):
    """Every check on the traffic panel against the too-small grid."""
    return quality.validate(p.events_traffic(spark, sf), grid=p.small_grid(spark, sf))


@query
def validate_stages(spark, sf):
    """Traffic and reference weeks against the grid that covers them."""
    return quality.validate_stages(
        {"traffic": p.events_traffic(spark, sf), "reference_weeks": p.events_weeks(spark, sf)}, p.grid(spark, sf))


# --- weeks ------------------------------------------------------------------------------------

@query
def iso_week_keys(spark, sf):
    days = p.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("day")).distinct()
    return comparable(days.select(
        "day", tk.iso_year("day").alias("iso_year"), tk.iso_week("day").alias("iso_week"),
        tk.week_label("day").alias("label"), tk.week_number("day").alias("week_number"),
    ))


@query
def week_label_roundtrip(spark, sf):
    labels = p.table(spark, sf, "lineitem").select(tk.week_label("l_shipdate").alias("label")).distinct()
    return comparable(labels.select("label", tk.label_number("label").alias("week_number")))


@query
def weekly_totals(spark, sf):
    return comparable(weeks.weekly_totals(p.events_traffic(spark, sf)))


@query
def orders_weekly_totals(spark, sf):
    return comparable(weeks.weekly_totals(p.orders_traffic(spark, sf)))


def _entries(array: str, name: str):
    return [F.col(array)[i].alias(f"{f}_{name}") for i, f in enumerate(FEATURES)]


def _deviations(spark, sf):
    return weeks.deviation_ratios(weeks.weekly_totals(p.events_traffic(spark, sf)))


@query
def weekly_median(spark, sf):
    return comparable(_deviations(spark, sf).select(
        KEY, "year_week", *_entries("centres", "median"), *_entries("distances", "abs_dev")))


@query
def weekly_mad(spark, sf):
    return comparable(_deviations(spark, sf).select(KEY, *_entries("spreads", "mad")).distinct())


@query
def norm_dev(spark, sf):
    """All ratios; the very large ones of a zero MAD by their logarithm, so that digits compare."""
    shown = [F.when(x < 1e6, x).otherwise(F.log(x)).alias(f) for f, x in ((f"{f}_norm_dev", F.col("ratios")[i]) for i, f in enumerate(FEATURES))]
    return comparable(_deviations(spark, sf).select(KEY, "year_week", *shown))


@query
def normal_weeks(spark, sf):
    return comparable(weeks.normal_weeks(_deviations(spark, sf)).select(KEY, "year_week", "stability_score"))


@query
def reference_weeks(spark, sf):
    return comparable(weeks.select_reference_weeks(p.events_traffic(spark, sf)))


@query
def reference_weeks_strict(spark, sf):
    """Two weeks per cell at most, half the deviation allowed."""
    return comparable(weeks.select_reference_weeks(p.events_traffic(spark, sf), num_weeks=2, mad_threshold=0.75))


@query
def orders_reference_weeks(spark, sf):
    return comparable(weeks.select_reference_weeks(p.orders_traffic(spark, sf)))


@query
def reference_week_distribution(spark, sf):
    return comparable(summary.reference_week_distribution(p.events_weeks(spark, sf)))


def _flagged(anomalies):
    """A severity is a ratio to a spread that may be tiny: fewer digits of it are comparable."""
    return comparable(anomalies.withColumn("severity_score", F.round("severity_score", 3)))


# --- model ------------------------------------------------------------------------------------

@query
def mark_reference(spark, sf):
    marked = sub.mark_reference(p.events_traffic(spark, sf), p.events_weeks(spark, sf))
    return comparable(marked.select(KEY, TIME, "is_reference"))


@query
def training_rows(spark, sf):
    return comparable(sub.training_rows(p.events_traffic(spark, sf), p.events_weeks(spark, sf)))


def _train(spark, sf):
    return sub.training_rows(p.events_traffic(spark, sf), p.events_weeks(spark, sf))


@query
def scaler_fit(spark, sf):
    fitted = sub.scaler(_train(spark, sf))
    return comparable(fitted.select(
        KEY, "n_train", *[F.col("mean")[i].alias(f"{f}_mean") for i, f in enumerate(FEATURES)],
        *[F.col("scale")[i].alias(f"{f}_scale") for i, f in enumerate(FEATURES)]))


@query
def standardised_rows(spark, sf):
    fitted = sub.scaler(_train(spark, sf))
    rows = p.events_traffic(spark, sf).join(fitted, KEY)
    return comparable(rows.select(KEY, TIME, *[z.alias(f"z_{f}") for f, z in zip(FEATURES, standardised(FEATURES))]))


@query
def moment_matrix(spark, sf):
    m = sub.moment_matrix(_train(spark, sf))
    return comparable(m.select(KEY, *[F.col("moments")[3 * i + j].alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]))


@query
def osp_model(spark, sf):
    model = p.detector(spark, sf).model()
    return comparable(model.select(
        KEY, "n_train", "rank", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i + 1}") for i in range(3)],
        "mean_error", "std_error", "threshold"))


@query
def osp_model_merged(spark, sf):
    """The model whose axes come from stored weekly moments; two loads of them, cut in the middle of weeks."""
    panel = p.events_traffic(spark, sf)
    loads = [panel.where(F.dayofmonth(TIME) <= 10), panel.where(F.dayofmonth(TIME) > 10)]
    moments = p.staged(spark, sf, "moments", lambda: reduce(DataFrame.unionByName, map(sub.week_moments, loads)))
    model = p.detector(spark, sf, moments=moments).model()
    return comparable(model.select(
        KEY, "n_train", "rank", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i + 1}") for i in range(3)],
        "mean_error", "std_error", "threshold"))


@query
def osp_residual_map(spark, sf):
    """The map onto what the kept axes do not explain; unlike the axes it has no free sign."""
    model = p.detector(spark, sf, 1).model()
    pairs = [(i, j) for i in range(3) for j in range(3)]
    return comparable(model.select(KEY, *[F.col("residual_map")[3 * i + j].alias(f"r{i}{j}") for i, j in pairs]))


@query
def osp_scores(spark, sf):
    return comparable(p.detector(spark, sf).scores().select(KEY, TIME, "anomaly_score", "threshold"))


@query
def osp_anomalies_k1(spark, sf):
    return _flagged(p.detector(spark, sf, 1).anomalies())


@query
def osp_anomalies_k2(spark, sf):
    return _flagged(p.detector(spark, sf, 2).anomalies())


@query
def osp_anomalies_k3(spark, sf):
    """Full rank explains everything; only cells with too few or constant training rows can flag."""
    return _flagged(p.detector(spark, sf, 3).anomalies())


@query
def osp_anomalies_t3(spark, sf):
    return _flagged(p.detector(spark, sf, 2, anomaly_threshold=3.0).anomalies())


@query
def osp_anomalies_unscaled(spark, sf):
    return _flagged(p.detector(spark, sf, 1, standardize=False).anomalies())


@query
def osp_anomalies_salted(spark, sf):
    """The plan for more cells than a broadcast may hold, with hot cells, on the same data."""
    return _flagged(p.detector(spark, sf, 2, limit=0, part_rows=20).anomalies())


@query
def osp_anomalies_weekly(spark, sf):
    """The panel in a folder per week: training reads the folders of reference weeks, found at run time."""
    found = sub.SubspaceDetector(p.events_weekly(spark, sf), p.events_weeks(spark, sf), week=WEEK)
    return _flagged(found.anomalies())


@query
def orders_training_weekly(spark, sf):
    """Training rows of seven years of orders out of the listed weeks' folders."""
    return comparable(sub.training_rows(p.orders_weekly(spark, sf), p.orders_weeks(spark, sf), week=WEEK).drop(WEEK))


@query
def osp_score_stored_model(spark, sf):
    """A written model table applied to the panel."""
    model = p.staged(spark, sf, "model", lambda: p.detector(spark, sf).model())
    scored = sub.score(p.events_traffic(spark, sf), model)
    return comparable(scored.select(KEY, TIME, "anomaly_score", "threshold"))


@query
def osp_scores_bucketed(spark, sf):
    """The stored model applied to the panel where its buckets lie."""
    model = p.staged(spark, sf, "model", lambda: p.detector(spark, sf).model())
    scored = sub.score_bucketed(p.events_bucketed(spark, sf), model)
    return comparable(scored.select(KEY, TIME, "anomaly_score", "threshold"))


@query
def orders_osp_anomalies(spark, sf):
    """Supplier-days; severities reach from 2 to many thousands, so their logarithm is compared."""
    found = sub.detect(p.orders_traffic(spark, sf), p.orders_weeks(spark, sf), n_components=2)
    return comparable(found.withColumn("log_severity", F.round(F.log("severity_score"), 4)).drop("severity_score"))


@query
def cells_without_weeks(spark, sf):
    """Cells that cannot be modelled."""
    return p.events_traffic(spark, sf).select(KEY).distinct().join(
        p.events_weeks(spark, sf).select(KEY).distinct(), KEY, "left_anti")


# --- summary ----------------------------------------------------------------------------------

@query
def severity_describe(spark, sf):
    return comparable(summary.describe(p.anomalies(spark, sf), "severity_score"))


@query
def top_cells(spark, sf):
    return summary.top_cells(p.anomalies(spark, sf))


@query
def most_severe(spark, sf):
    return comparable(summary.most_severe(p.anomalies(spark, sf)).select(KEY, TIME, "severity_score"))


@query
def by_weekday(spark, sf):
    return summary.by_weekday(p.anomalies(spark, sf))


@query
def by_hour(spark, sf):
    return comparable(summary.by_hour(p.event_anomalies(spark, sf)))


@query
def date_range(spark, sf):
    return comparable(summary.date_range(p.anomalies(spark, sf)))


@query
def distinct_cells(spark, sf):
    return summary.distinct_count(p.anomalies(spark, sf), KEY)


@query
def stage_yield(spark, sf):
    stages = {
        "ingested": p.events_ingested(spark, sf), "traffic": p.events_traffic(spark, sf),
        "anomalies": p.anomalies(spark, sf),
    }
    return comparable(summary.stage_yield(stages))


@query
def anomaly_summary(spark, sf):
    report = summary.anomaly_summary(p.event_anomalies(spark, sf))
    return comparable(report)


# --- cells ------------------------------------------------------------------------------------

@query
def cell_stats(spark, sf):
    return comparable(cells.cell_stats(p.anomalies(spark, sf)))


@query
def event_cell_stats(spark, sf):
    return comparable(cells.cell_stats(p.event_anomalies(spark, sf)), 8)


@query
def extreme_flags(spark, sf):
    return comparable(p.stats(spark, sf).select(KEY, "has_extreme_anomalies", "extreme_anomaly_count"))


@query
def extreme_anomalies(spark, sf):
    found = p.anomalies(spark, sf)
    return comparable(cells.extreme_anomalies(found, cells.extreme_threshold(found)).select(KEY, TIME, "severity_score"))


@query
def infinite_percentiles(spark, sf):
    """Percentiles of values with infinities at both ends, by narrowing."""
    probs = (0.02, 0.25, 0.5, 0.75, 0.98)
    found = exact_percentiles(p.imperfect_anomalies(spark, sf), "severity_score", probs, one_task=100, bins=64)
    row = p.imperfect_anomalies(spark, sf).agg(F.count("severity_score").alias("n"))
    shown = [F.lit(v).cast("string") if abs(v) == float("inf") else F.round(F.lit(v), 6).cast("string") for v in found]
    return row.select("n", *[v.alias(f"p{round(q * 100)}") for q, v in zip(probs, shown)])


@query
def stats_without_nan(spark, sf):
    """Cell statistics where some severities are NaN: those count for nothing."""
    rows = p.imperfect_anomalies(spark, sf).where(~(F.abs("severity_score") == float("inf")))
    return comparable(cells.cell_stats(rows, threshold=100.0).select(
        KEY, "anomaly_count", "avg_severity", "max_severity", "extreme_anomaly_count"))


@query
def empty_anomalies(spark, sf):
    """The grid's statistics when no record is an anomaly: zeros in every cell and one class."""
    none = p.anomalies(spark, sf).where("severity_score < 0")
    return comparable(cells.classify(cells.cell_stats(none), p.grid(spark, sf)).select(KEY, "anomaly_count", "max_severity", "category"))


@query
def usable_metrics(spark, sf):
    """Class counts for each wanted metric that the statistics have; unknown ones are passed over."""
    stats, grid = p.stats(spark, sf), p.grid(spark, sf)
    wanted = cells.usable_metrics(stats, ["anomaly_count", "no_such_metric", "avg_severity"])
    parts = [cells.classify(stats, grid, m).groupBy("category").agg(F.count(F.lit(1)).alias("cells")).withColumn("metric", F.lit(m)) for m in wanted]
    return reduce(DataFrame.unionByName, parts)


@query
def severity_percentiles(spark, sf):
    """The bin-narrowing path of the exact percentiles, forced by a small one-task bound."""
    probs = (0.25, 0.5, 0.75, 0.9, 0.99)
    found = exact_percentiles(p.events(spark, sf), "value", probs, one_task=100, bins=64)
    row = p.events(spark, sf).agg(F.count("value").alias("n"))
    return comparable(row.select("n", *[F.lit(v).alias(f"p{round(q * 100)}") for q, v in zip(probs, found)]))


@query
def missing_cells(spark, sf):
    return cells.missing_cells(p.grid(spark, sf), p.stats(spark, sf))


@query
def zero_rows(spark, sf):
    stats = p.stats(spark, sf)
    missing = cells.missing_cells(p.grid(spark, sf), stats)
    return comparable(stats.unionByName(cells.zero_rows(missing, stats)).fillna(0))


@query
def zero_fill(spark, sf):
    return comparable(cells.complete_over_grid(p.stats(spark, sf), p.grid(spark, sf)))


@query
def classify_count(spark, sf):
    out = cells.classify(p.stats(spark, sf), p.grid(spark, sf))
    return out.select(KEY, "anomaly_count", "category")


@query
def classify_quintile(spark, sf):
    out = cells.classify(p.stats(spark, sf), p.grid(spark, sf), "avg_severity")
    return comparable(out.select(KEY, "avg_severity", "category"))


@query
def classify_impact(spark, sf):
    """Quintiles of the impact score over the cells that have one."""
    own = p.stats(spark, sf)
    return comparable(cells.classify(own, own, "severity_impact").select(KEY, "severity_impact", "category"))


def _classified(spark, sf):
    return p.staged(spark, sf, "classified", lambda: cells.classify(p.stats(spark, sf), p.grid(spark, sf)))


@query
def category_stats(spark, sf):
    return comparable(cells.category_stats(_classified(spark, sf)))


@query
def category_breakdown(spark, sf):
    return comparable(cells.category_breakdown(_classified(spark, sf)))


@query
def category_values(spark, sf):
    return _classified(spark, sf).select("category").distinct()


@query
def map_totals(spark, sf):
    return comparable(cells.map_totals(_classified(spark, sf)))


@query
def extreme_classes(spark, sf):
    return comparable(cells.extreme_cells(p.stats(spark, sf)).select(KEY, "extreme_anomaly_count", "category"))


@query
def extreme_overview(spark, sf):
    return comparable(cells.extreme_overview(p.stats(spark, sf)))


@query
def extreme_breakdown(spark, sf):
    return comparable(cells.extreme_breakdown(cells.extreme_cells(p.stats(spark, sf))))


@query
def classification_report(spark, sf):
    return comparable(reports.classification_report(_classified(spark, sf)))


@query
def extreme_report(spark, sf):
    stats = p.stats(spark, sf)
    return comparable(reports.extreme_report(stats, cells.extreme_cells(stats)))


# --- geo --------------------------------------------------------------------------------------

@query
def ring_centroids(spark, sf):
    return comparable(geo.centroids(p.grid(spark, sf)))


@query
def centroid_points(spark, sf):
    points = geo.centroid_points(p.grid(spark, sf), p.stats(spark, sf))
    return comparable(points.select(KEY, "lon", "lat", "anomaly_count", "avg_severity"))


@query
def geo_join(spark, sf):
    own = p.stats(spark, sf)
    joined = geo.grid_attributes(p.grid(spark, sf), cells.classify(own, own))
    return comparable(joined.drop("geometry"))


@query
def legend_counts(spark, sf):
    return comparable(cells.legend_counts(_classified(spark, sf), list(COUNT_CLASSES)))


@query
def extreme_legend(spark, sf):
    return comparable(cells.extreme_legend(cells.extreme_cells(p.stats(spark, sf)), p.grid(spark, sf)))


def _shown_features(df):
    return df.select(
        KEY, "category", "color", "label", "tooltip",
        F.get_json_object("feature", "$.type").alias("feature_type"),
        F.get_json_object("feature", "$.geometry.type").alias("geometry_type"),
        F.get_json_object("feature", "$.properties.cellId").cast("bigint").alias("feature_cell"),
    )


@query
def geo_features(spark, sf):
    return _shown_features(geo.class_features(p.grid(spark, sf), _classified(spark, sf)))


@query
def extreme_geo_features(spark, sf):
    return _shown_features(geo.extreme_features(p.grid(spark, sf), cells.extreme_cells(p.stats(spark, sf))))


# --- timeline ---------------------------------------------------------------------------------

@query
def most_extreme_cell(spark, sf):
    return timeline.most_extreme_cell(p.event_anomalies(spark, sf))


@query
def cell_timeline(spark, sf):
    return comparable(timeline.cell_timeline(p.event_anomalies(spark, sf)).drop(*FEATURES, "anomaly_score"))


def _timeline(spark, sf):
    return timeline.cell_rows(p.event_anomalies(spark, sf))


@query
def daily_stats(spark, sf):
    return comparable(timeline.daily_stats(_timeline(spark, sf)))


@query
def hourly_stats(spark, sf):
    return comparable(timeline.hourly_stats(_timeline(spark, sf)))


@query
def weekday_stats(spark, sf):
    return comparable(timeline.weekday_stats(timeline.cell_rows(p.anomalies(spark, sf))))


@query
def peak_hours(spark, sf):
    return comparable(timeline.peak_hours(_timeline(spark, sf)))


@query
def temporal_peaks(spark, sf):
    return comparable(timeline.temporal_peaks(_timeline(spark, sf)))


@query
def cell_profile(spark, sf):
    return comparable(timeline.cell_profile(_timeline(spark, sf)))


@query
def severity_guides(spark, sf):
    return comparable(timeline.severity_guides(_timeline(spark, sf)))


@query
def traffic_stack(spark, sf):
    return comparable(timeline.traffic_stack(timeline.cell_rows(p.anomalies(spark, sf))))


@query
def top10_severe(spark, sf):
    return comparable(timeline.top_severe(_timeline(spark, sf)))


@query
def short_days(spark, sf):
    return comparable(timeline.short_days(_timeline(spark, sf)))


@query
def cell_report(spark, sf):
    return comparable(reports.cell_report(timeline.cell_rows(p.anomalies(spark, sf))))


# --- distribution -----------------------------------------------------------------------------

@query
def hist_counts(spark, sf):
    return comparable(distribution.histogram(p.anomalies(spark, sf), "severity_score"))


@query
def hist_density(spark, sf):
    return comparable(distribution.histogram(p.events(spark, sf), "value", density=True))


@query
def kde_curve(spark, sf):
    return comparable(distribution.density_curve(p.events(spark, sf), "value"))
