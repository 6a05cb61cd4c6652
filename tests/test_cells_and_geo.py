import json

import pytest
from pyspark.sql import functions as F

from gridpulse.functions.classes import COUNT_CLASSES, QUINTILE_CLASSES, count_class
from gridpulse.operators import cells, geo, reports
from gridpulse.schemas import ANOMALIES, CELL_STATS

ANOMALY = ("cell_id bigint, timestamp timestamp, anomaly_score double, sms_total double, calls_total double, "
           "internet_traffic double, severity_score double")


def anomaly(cell, severity, i=0):
    return (cell, f"2013-11-01 {i % 24:02d}:00:00", 1.0, 2.0, 4.0, 6.0, float(severity))


@pytest.fixture
def anomalies(frame):
    rows = [anomaly(1, 2.5)] + [anomaly(2, s, i) for i, s in enumerate([3, 4, 5])] + [anomaly(3, 50), anomaly(3, 2, 1)]
    return frame(rows, ANOMALY)


@pytest.fixture
def grid(spark):
    square = "array(array(array(0D,0D), array(1D,0D), array(1D,1D), array(0D,1D), array(0D,0D)))"
    return spark.sql(f"SELECT id AS cell_id, struct('Polygon' AS type, {square} AS coordinates) AS geometry FROM range(1, 7)")


def by_cell(df):
    return {r.cell_id: r for r in df.collect()}


def test_cell_stats(anomalies):
    stats = cells.cell_stats(anomalies)
    assert stats.schema.simpleString() == CELL_STATS.simpleString()
    rows = by_cell(stats)
    assert rows[1].severity_std is None and rows[1].anomaly_count == 1
    assert (rows[2].avg_severity, rows[2].max_severity, rows[2].severity_std) == (4.0, 5.0, 1.0)
    assert rows[2].weighted_severity == 12.0
    assert rows[2].severity_impact == pytest.approx(0.5 * 12 + 0.3 * 5 + 0.2 * 3)
    assert [rows[c].has_extreme_anomalies for c in (1, 2, 3)] == [False, False, True]
    assert rows[3].extreme_anomaly_count == 1


def test_zero_fill_covers_every_metric_and_keeps_foreign_cells(anomalies, grid):
    stats = cells.cell_stats(anomalies.union(anomalies.limit(1).withColumn("cell_id", F.lit(99).cast("bigint"))))
    full = by_cell(cells.complete_over_grid(stats, grid))
    assert set(full) == {1, 2, 3, 4, 5, 6, 99}
    assert all(v is not None for r in full.values() for v in r)
    assert full[5].has_extreme_anomalies is False and full[5].weighted_severity == 0.0
    assert {r.cell_id for r in cells.missing_cells(grid, stats).collect()} == {4, 5, 6}
    appended = stats.unionByName(cells.zero_rows(cells.missing_cells(grid, stats), stats)).fillna(0)
    assert by_cell(appended) == full


def test_values_on_a_cut_take_the_lower_class(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5)], "x double")
    got = [r[0] for r in df.select(count_class("x", [1, 2, 3, 4])).collect()]
    assert got == list(COUNT_CLASSES)


def test_classes_partition_the_grid(anomalies, grid):
    stats = cells.cell_stats(anomalies)
    counted = by_cell(cells.classify(stats, grid))
    assert len(counted) == 6
    assert counted[1].category == "Low Activity" and counted[6].category == "No Anomalies"
    assert counted[2].category == "Extreme Activity"
    ranked = by_cell(cells.classify(stats, grid, "weighted_severity"))
    assert {r.category for r in ranked.values()} <= set(QUINTILE_CLASSES)
    assert ranked[6].category == "Very Low" and ranked[3].category == "Very High"


def test_no_anomalies_at_all(anomalies, grid):
    none = cells.cell_stats(anomalies.where("false"))
    assert none.count() == 0
    classified = cells.classify(none, grid)
    assert {r.category for r in classified.collect()} == {"No Anomalies"}
    assert cells.extreme_cells(none).count() == 0
    assert cells.extreme_cells(none).columns[-1] == "category"
    totals = cells.map_totals(classified).first()
    assert (totals.total_cells, totals.total_anomalies, totals.avg_anomalies_per_cell) == (6, 0, 0.0)


def test_unknown_metric_is_left_out(anomalies):
    assert cells.usable_metrics(cells.cell_stats(anomalies), ["no_such", "avg_severity"]) == ["avg_severity"]


def test_category_tables(anomalies, grid):
    classified = cells.classify(cells.cell_stats(anomalies), grid)
    breakdown = {r.category: r for r in cells.category_breakdown(classified).collect()}
    assert sum(r.share for r in breakdown.values()) == pytest.approx(100)
    assert breakdown["No Anomalies"].mean_severity is None and breakdown["No Anomalies"].cells == 3
    assert sum(r.anomalies for r in cells.category_stats(classified).collect()) == 6
    legend = {r.category: r.cells for r in cells.legend_counts(classified, list(COUNT_CLASSES)).collect()}
    assert list(legend) and sum(legend.values()) == 6 and legend["High Activity"] == 0


def test_extreme_tables(frame, grid):
    rows = [anomaly(1, 100, i) for i in range(4)] + [anomaly(2, 100), anomaly(3, 100), anomaly(3, 100, 1), anomaly(4, 2)]
    stats = cells.cell_stats(frame(rows, ANOMALY), extreme_q=0.5)
    extremes = by_cell(cells.extreme_cells(stats))
    assert {c: r.category for c, r in extremes.items()} == {1: "Critical Extreme", 2: "Low Extreme", 3: "Moderate Extreme"}
    overview = cells.extreme_overview(stats).first()
    assert (overview.cells, overview.extreme_cells, overview.extreme_anomalies, overview.extreme_share) == (4, 3, 7, 75.0)
    legend = {r.category: r.cells for r in cells.extreme_legend(cells.extreme_cells(stats), grid).collect()}
    assert legend["No Extreme Anomalies"] == 3 and legend["High Extreme"] == 0
    report = {r.key: r.value for r in reports.extreme_report(stats, cells.extreme_cells(stats)).collect()}
    assert report["Cells with extreme anomalies"] == "3 (75.0%)"


def test_threshold_reaches_the_scan(spark, anomalies, tmp_path):
    anomalies.write.parquet(str(tmp_path / "a"))
    stored = spark.read.schema(ANOMALIES).parquet(str(tmp_path / "a"))
    found = cells.extreme_anomalies(stored, cells.extreme_threshold(stored))
    assert "GreaterThanOrEqual(severity_score" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.severity_score for r in found.collect()] == [50.0]


def test_centroid_counts_the_closing_vertex_twice(grid):
    row = geo.centroids(grid).first()
    assert (row.lon, row.lat) == (0.4, 0.4)


def test_features(anomalies, grid):
    stats = cells.cell_stats(anomalies)
    classified = cells.classify(stats, grid)
    rows = by_cell(geo.class_features(grid, classified))
    feature = json.loads(rows[3].feature)
    assert feature["type"] == "Feature" and feature["properties"]["cellId"] == 3
    assert feature["geometry"]["coordinates"][0][2] == [1.0, 1.0]
    assert "P99+ Extreme Anomalies: 🔥 YES (1)" in rows[3].label and "Max Severity: 50.00σ" in rows[3].label
    assert rows[6].color == "#2E8B57" and rows[6].tooltip == "Cell 6: No Anomalies"
    unknown = by_cell(geo.class_features(grid, classified.where("cell_id < 3")))
    assert (unknown[6].category, unknown[6].color) == ("Unknown", "#CCCCCC")
    extreme = by_cell(geo.extreme_features(grid, cells.extreme_cells(stats)))
    assert extreme[1].color == "#E8E8E8" and extreme[1].tooltip == "Cell 1: No extreme anomalies"
    assert extreme[3].tooltip == "Cell 3: Low Extreme (1 extreme)"
    assert len(geo.centroid_points(grid, stats).collect()) == 3


def test_reports_as_lines(anomalies, grid, tmp_path, spark):
    from gridpulse import sinks

    report = reports.classification_report(cells.classify(cells.cell_stats(anomalies), grid))
    sinks.write_report(report, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[0] == "overview | Total cells: 6"
    assert any(line.startswith("category | No Anomalies: Cells 3 (50.0%)") for line in lines)
    sinks.write_features(geo.class_features(grid, cells.classify(cells.cell_stats(anomalies), grid)), str(tmp_path / "f"))
    assert all(json.loads(r.value)["type"] == "Feature" for r in spark.read.text(str(tmp_path / "f")).collect())
