"""Values and files that clean tables do not hold: infinities, NaN, overlong times, broken grids, existing targets."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridpulse import sinks, sources
from gridpulse.operators import cells, distribution, quality, subspace, summary
from gridpulse.operators.quantiles import exact_percentiles
from gridpulse.sources.raw import rejects

INF, NAN = float("inf"), float("nan")
PROBS = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)


def same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("values", [
    [INF, *range(1, 200)], [-INF] * 30 + [INF] * 30 + list(range(140)), [INF] * 200, [-INF] * 100 + [INF] * 100,
    [1.7e308, -1.7e308, *range(198)], [1.7e308] * 100 + [-1.7e308] * 100, [5e-324 * k for k in range(200)],
    [1e300 + k * 1e285 for k in range(200)], [NAN] * 50 + [0.0] * 150 + [INF],
])
def test_percentiles_end_on_every_input(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    assert same(exact_percentiles(df, "x", PROBS, one_task=20, bins=8), exact_percentiles(df, "x", PROBS))


def test_ingest_survives_overlong_times_and_odd_numbers(spark):
    lines = ["1\t1383260400000\t39\t1\t2\t3\t4\t5", "1\t13832604000000000\t39\t1\t1\t1\t1\t1", "1\t1383260400000000000\t39\t1\t1\t1\t1\t1",
             "1\t-9223372036854775808\t39\t1\t1\t1\t1\t1", "2\t1383260400000\t39\tNaN\tInf\t-Inf\t1\t", "3\tx\t39\t1\t1\t1\t1\t1"]
    raw = sources.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    rows = {r.cell_id: r for r in sources.finish_ingest(raw).collect()}
    assert set(rows) == {1, 2} and rows[1].sms_in == 1 and (rows[2].sms_in, rows[2].sms_out, rows[2].call_in, rows[2].call_out) == (None, None, None, 1)
    lost = sources.ingest_losses(raw).first()
    assert (lost.records, lost.no_time, lost.time_out_of_range, lost.sms_in_non_finite, lost.call_in_non_finite) == (6, 1, 3, 1, 1)


def test_times_out_of_range_are_rejects(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\t1383260400000\t39\t1\t2\t3\t4\t5\n1\t13832604000000000\t39\t1\t1\t1\t1\t1\n")
    kept = rejects(sources.read_raw(spark, str(tmp_path), keep_rejects=True)).collect()
    assert [r.timestamp_ms for r in kept] == [13832604000000000]


def square(cell, name="cellId"):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    return {"type": "Feature", "properties": {name: cell}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_grids_are_read_strictly(spark, tmp_path):
    def read(text):
        (tmp_path / "grid.json").write_text(text)
        return sorted(r.cell_id for r in sources.read_grid(spark, str(tmp_path / "grid.json")).collect())

    fine = {"features": [square(1), square("2"), square(3, "cell_id")]}
    assert read(json.dumps(fine)) == [1, 2, 3]
    multi = square(1) | {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}
    for broken in (json.dumps(fine)[:-30], "{}", '{"features": []}', json.dumps({"features": [square(None)]}), json.dumps({"features": [square("x")]}),
                   json.dumps({"features": [square(1), square("1")]}), json.dumps({"features": [square(1) | {"geometry": None}]}), json.dumps({"features": [multi]})):
        with pytest.raises(Exception):
            read(broken)


def test_the_gate_and_the_checks_count_non_finite_values(frame):
    df = frame([(1, "2013-11-01 00:00:00", 1.0, NAN, 2.0), (1, "2013-11-02 00:00:00", INF, 1.0, 2.0)],
               "cell_id bigint, timestamp timestamp, sms_total double, calls_total double, internet_traffic double")
    with pytest.raises(ValueError, match="NaN"):
        quality.require_clean(df)
    found = {(r.check, r.subject): (r.level, r.n) for r in quality.validate(df).collect()}
    assert found[("non_finite", "sms_total")] == ("error", 1) and found[("non_finite", "calls_total")] == ("error", 1)
    assert ("missing_column", "calls_total") in {(r.check, r.subject) for r in quality.validate(df.drop("calls_total")).collect()}


def anomaly_rows(spark, severities):
    rows = [(1, k, float(s)) for k, s in enumerate(severities)]
    df = spark.createDataFrame(rows, "cell_id bigint, k int, severity_score double")
    return df.select("cell_id", F.expr("timestamp '2013-11-01' + make_interval(0, 0, 0, 0, k)").alias("timestamp"), "severity_score",
                     *[F.lit(1.0).alias(f) for f in ("sms_total", "calls_total", "internet_traffic")])


def test_nan_severities_count_for_nothing(spark):
    df = anomaly_rows(spark, [*range(100), NAN])
    row = cells.cell_stats(df).first()
    assert row.anomaly_count == 100 and row.max_severity == 99 and row.avg_severity == pytest.approx(49.5) and row.extreme_anomaly_count == 1
    assert cells.extreme_anomalies(df, 98.0).count() == 2
    described = {r.statistic: r.value for r in summary.describe(df, "severity_score").collect()}
    assert described["count"] == 100 and described["mean"] == pytest.approx(49.5) and described["max"] == 99


def test_distributions_leave_non_finite_values_out(spark):
    odd, plain = (anomaly_rows(spark, [float(k % 17) for k in range(300)] + more) for more in ([NAN, INF, -INF], []))
    for fn in (distribution.histogram, distribution.density_curve):
        assert fn(odd, "severity_score").orderBy(F.col("bin" if fn is distribution.histogram else "point")).collect() == \
            fn(plain, "severity_score").orderBy(F.col("bin" if fn is distribution.histogram else "point")).collect()
    far = anomaly_rows(spark, [0.0] * 500 + [1e6])
    curve = distribution.density_curve(far, "severity_score").orderBy("point").collect()
    assert len(curve) == 200 and curve[100].density == 0 and curve[0].density > 0


def panel_of(spark, change):
    rows = [(c, d, float(10 + (d * 7 + c) % 5), float(20 + d % 3), float(30 + (d * d) % 4)) for c in (1, 2, 3, 4) for d in range(28)]
    df = spark.createDataFrame([change(*r) for r in rows], "cell_id bigint, d int, sms_total double, calls_total double, internet_traffic double")
    return df.select("cell_id", F.expr("timestamp '2013-11-04' + make_interval(0, 0, 0, d)").alias("timestamp"), "sms_total", "calls_total", "internet_traffic")


def test_detection_tells_what_it_leaves_out(spark):
    def change(c, d, s, k, i):
        s = NAN if c == 1 and d == 0 else 1e200 * (1 + d % 2) if c == 2 else s
        return c, d, s, k, None if c == 1 and d == 1 else i

    weeks = spark.createDataFrame([(c, "2013_W45", 0.0) for c in (1, 2, 4)] + [(4, "2013_W46", 0.0)], "cell_id bigint, reference_week string, stability_score double")
    detector = subspace.SubspaceDetector(panel_of(spark, change), weeks, 1)
    lost = {r.cell_id: (r.rows, r.rows_skipped, r.not_modelled) for r in detector.losses().collect()}
    assert lost == {1: (28, 2, None), 2: (28, 0, "moments overflow"), 3: (28, 0, "no reference week")}
    assert {r.cell_id for r in detector.scores().select("cell_id").distinct().collect()} >= {1, 4}
    assert not any(math.isnan(r.anomaly_score) for r in detector.anomalies().collect())


def test_equal_eigenvalues_keep_the_rank_asked_for(spark):
    """Balanced, uncorrelated features tie; a later outlier must still be found."""
    base = [(9.0, 9.0, 9.0), (11.0, 11.0, 9.0), (9.0, 11.0, 11.0), (11.0, 9.0, 11.0)]
    rows = [(1, d, *base[d % 4]) for d in range(8)] + [(1, 9, 10.0, 10.0, 500.0)]
    df = spark.createDataFrame(rows, "cell_id bigint, d int, sms_total double, calls_total double, internet_traffic double").select(
        "cell_id", F.expr("timestamp '2013-11-04' + make_interval(0, 0, 0, 0, d)").alias("timestamp"), "sms_total", "calls_total", "internet_traffic")
    df = df.withColumn("timestamp", F.when(F.col("internet_traffic") > 100, F.expr("timestamp '2013-11-12'")).otherwise(F.col("timestamp")))
    weeks = spark.createDataFrame([(1, "2013_W45", 0.0)], "cell_id bigint, reference_week string, stability_score double")
    for k in (1, 2):
        detector = subspace.SubspaceDetector(df, weeks, k)
        model = detector.model().first()
        assert model["rank"] == k
        found = detector.anomalies().collect()
        assert [r.internet_traffic for r in found] == [500.0]


def test_an_existing_target_is_an_error(spark, tmp_path):
    df = spark.range(3)
    sinks.write_parquet(df, str(tmp_path / "t"))
    with pytest.raises(AnalysisException):
        sinks.write_parquet(df, str(tmp_path / "t"))
    sinks.write_parquet(df, str(tmp_path / "t"), mode="overwrite")


def test_rechecks_count_differences(frame):
    a = frame([(1, "2013-11-01", 1.0), (2, "2013-11-01", 2.0), (3, "2013-11-01", None)], "cell_id bigint, timestamp timestamp, severity_score double")
    b = frame([(1, "2013-11-01", 1.0), (2, "2013-11-01", 2.1), (4, "2013-11-01", 1.0)], "cell_id bigint, timestamp timestamp, severity_score double")
    assert tuple(quality.recheck(a, b, "severity_score").first()) == (2, 1, 1, 1)
