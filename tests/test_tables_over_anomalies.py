import math

import numpy as np
import pandas as pd
import pytest

from gridpulse.operators import distribution, quality, reports, summary, timeline
from gridpulse.schemas import FEATURES

ANOMALY = ("cell_id bigint, timestamp timestamp, anomaly_score double, sms_total double, calls_total double, "
           "internet_traffic double, severity_score double")


@pytest.fixture(scope="module")
def known():
    rng = np.random.default_rng(11)
    n = 400
    return pd.DataFrame({
        "cell_id": rng.choice([5, 6, 7, 8], n, p=[0.4, 0.3, 0.2, 0.1]),
        "timestamp": pd.Timestamp("2013-11-01") + pd.to_timedelta(rng.permutation(40 * 24)[:n], unit="h"),
        "anomaly_score": rng.random(n), "sms_total": rng.random(n).round(2), "calls_total": rng.random(n).round(2),
        "internet_traffic": rng.random(n).round(2), "severity_score": (rng.pareto(1.5, n) + 2).round(4),
    })


@pytest.fixture(scope="module")
def anomalies(spark, known):
    return spark.createDataFrame(known).selectExpr("*").cache()


def test_describe(anomalies, known):
    found = {r.statistic: r.value for r in summary.describe(anomalies, "severity_score").collect()}
    for name, value in known.severity_score.describe().items():
        assert found[name] == pytest.approx(value)


def test_counts(anomalies, known):
    assert [r.cell_id for r in summary.top_cells(anomalies, 2).collect()] == list(known.cell_id.value_counts().index[:2])
    hours = {r.hour: r.n for r in summary.by_hour(anomalies).collect()}
    assert hours == known.groupby(known.timestamp.dt.hour).size().to_dict()
    days = {r.day_of_week: r.n for r in summary.by_weekday(anomalies).collect()}
    assert days == known.timestamp.dt.day_name().value_counts().to_dict()
    assert sum(days.values()) == sum(hours.values()) == len(known)
    assert summary.distinct_count(anomalies, "cell_id").first()[0] == 4
    top = [r.severity_score for r in summary.most_severe(anomalies).collect()]
    assert top == sorted(known.severity_score, reverse=True)[:5]


def test_summary_report(anomalies, known):
    rows = summary.anomaly_summary(anomalies).orderBy("position").collect()
    sections = [r.section for r in rows]
    assert sections == sorted(sections, key=["overview", "severity_score", "top_cells", "day_of_week", "hour"].index)
    assert rows[0].value == "400" and rows[2].value.startswith("2013-11-01 to 2013-12-")
    assert summary.anomaly_summary(anomalies.where("false")).count() == 0


def test_yield_and_observation(spark, anomalies):
    table = summary.stage_yield({"a": spark.range(200), "b": spark.range(50)}).orderBy("position").collect()
    assert [r.reduction_percent for r in table] == [None, 75.0]
    watched, observation = summary.observed(anomalies, "rows-written")
    watched.write.format("noop").mode("overwrite").save()
    assert observation.get["rows"] == 400


def test_timeline_of_the_busiest_cell(anomalies, known):
    own = known[known.cell_id == 5].sort_values("timestamp")
    rows = timeline.cell_timeline(anomalies).collect()
    assert [r.timestamp for r in rows] == list(own.timestamp)
    assert [r.week for r in rows] == list(own.timestamp.dt.isocalendar().week)
    assert timeline.cell_timeline(anomalies, 8).count() == (known.cell_id == 8).sum()
    with pytest.raises(ValueError):
        timeline.cell_timeline(anomalies, 12345)
    assert timeline.cell_timeline(anomalies.where("false")).count() == 0


def test_timeline_tables(anomalies, known):
    own = known[known.cell_id == 5].copy()
    own["date"] = own.timestamp.dt.date
    rows = timeline.cell_rows(anomalies, 5)
    daily = {r.date: (r.n, r.mean_severity, r.max_severity) for r in timeline.daily_stats(rows).collect()}
    expected = own.groupby("date").severity_score.agg(["count", "mean", "max"]).round(2)
    assert daily == {d: tuple(v) for d, v in expected.iterrows()}
    hours = own.timestamp.dt.hour.value_counts()
    top = timeline.peak_hours(rows).collect()
    assert [r.n for r in top] == sorted(hours, reverse=True)[:3]
    peaks = timeline.temporal_peaks(rows).first()
    assert hours[peaks.peak_hour] == hours.max()
    assert own.timestamp.dt.day_name().value_counts()[peaks.peak_day] == own.timestamp.dt.day_name().value_counts().max()
    assert peaks.max_daily_anomalies == own.date.value_counts().max() == own.date.value_counts()[peaks.peak_date]
    stack = timeline.traffic_stack(rows).toPandas()
    assert np.allclose(stack.calls_edge.sort_values(), (own.sms_total + own.calls_total).sort_values())


def test_weekday_stats_have_all_days(frame):
    rows = frame([(1, "2013-11-04 00:00:00", 0.0, 1.0, 1.0, 1.0, 3.0)], ANOMALY)
    week = timeline.weekday_stats(timeline.cell_rows(rows)).orderBy("position").collect()
    assert [r.label for r in week] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert week[0].n == 1 and week[1].n is None and week[1].mean_severity is None


def test_profile_and_report(anomalies, known):
    own = known[known.cell_id == 6]
    rows = timeline.cell_rows(anomalies, 6)
    profile = timeline.cell_profile(rows).first()
    refined = timeline.cell_profile(rows, one_task=5).first()
    for name, value in (("median_severity", own.severity_score.median()), ("p95_severity", own.severity_score.quantile(0.95)),
                        ("p99_severity", own.severity_score.quantile(0.99)), ("std_severity", own.severity_score.std())):
        assert profile[name] == pytest.approx(value) and refined[name] == pytest.approx(value)
    assert profile.days_active == own.timestamp.dt.date.nunique()
    top = timeline.top_severe(rows, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0].severity_score == own.severity_score.max()
    report = {(r.section, r.key): r.value for r in reports.cell_report(rows).collect()}
    assert report[("overview", "Cell ID")] == "6" and report[("overview", "Total anomalies")] == str(len(own))
    assert len([k for k in report if k[0] == "top_10"]) == 10
    guides = timeline.severity_guides(rows).first()
    assert guides.mean == pytest.approx(own.severity_score.mean())
    assert sum(r.n for r in timeline.short_days(rows).collect()) == len(own)
    assert set(FEATURES) <= set(rows.columns)


@pytest.mark.parametrize("bins", [7, 50])
def test_histogram_matches_numpy(anomalies, known, bins):
    rows = distribution.histogram(anomalies, "severity_score", bins, density=True).orderBy("bin").collect()
    counts, edges = np.histogram(known.severity_score, bins)
    density, _ = np.histogram(known.severity_score, bins, density=True)
    assert [r.n for r in rows] == list(counts)
    assert np.allclose([r.bin_start for r in rows], edges[:-1]) and np.allclose([r.density for r in rows], density)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v) / 10,) for v in range(11)], "x double")
    assert [r.n for r in distribution.histogram(df, "x", 10).orderBy("bin").collect()] == list(np.histogram(np.arange(11) / 10, 10)[0])
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.n for r in distribution.histogram(constant, "x", 4).orderBy("bin").collect()] == [0, 0, 2, 0]
    assert distribution.histogram(df.where("false"), "x").count() == 0


def test_density_curve_matches_the_direct_sum(anomalies, known):
    x = known.severity_score.to_numpy()
    bandwidth = x.std(ddof=1) * len(x) ** -0.2
    rows = distribution.density_curve(anomalies, "severity_score").orderBy("point").collect()
    at = np.linspace(x.min(), x.max(), 200)
    direct = np.exp(-0.5 * ((at[:, None] - x[None, :]) / bandwidth) ** 2).sum(axis=1) / (len(x) * bandwidth * math.sqrt(2 * math.pi))
    assert np.allclose([r.x for r in rows], at)
    assert np.abs(np.array([r.density for r in rows]) - direct).max() < 1e-3 * direct.max()
    assert distribution.density_curve(anomalies.where("false"), "severity_score").count() == 0


def test_gate(frame):
    ok = frame([(1, "2013-11-01 00:00:00", 1.0)], "cell_id bigint, timestamp timestamp, x double")
    assert quality.require_clean(ok) is ok
    with pytest.raises(ValueError, match="share a key"):
        quality.require_clean(ok.union(ok))
    with pytest.raises(ValueError, match="NULL"):
        quality.require_clean(frame([(1, "2013-11-01 00:00:00", None)], "cell_id bigint, timestamp timestamp, x double"))


def findings(df):
    return {(r.check, r.subject): (r.level, r.n) for r in df.collect()}


def test_validation(frame, spark):
    df = frame([(0, "2013-11-01 00:00:00", -1.0, 1.0, None), (7, "2013-11-01 00:00:00", 1.0, 1.0, 1.0)],
               "cell_id bigint, timestamp timestamp, sms_total double, calls_total double, internet_traffic double")
    found = findings(quality.validate(df, grid=spark.createDataFrame([(7,)], "cell_id bigint")))
    assert found == {
        ("nulls", "internet_traffic"): ("error", 1), ("range", "cell_id"): ("warning", 1),
        ("range", "sms_total"): ("warning", 1), ("unknown_cells", "cell_id"): ("error", 1),
    }
    assert findings(quality.validate(df, null_error=0.9))[("nulls", "internet_traffic")] == ("warning", 1)
    assert quality.detect_contract(df) == "preprocessed"
    assert findings(quality.validate(df.select("sms_total")))[("unknown_schema", "sms_total")][0] == "error"


def test_schema_findings(frame):
    df = frame([(1, "2013_W47", 3.0)], "cell_id bigint, reference_week string, extra double")
    assert quality.detect_contract(df) == "reference_weeks"
    assert findings(quality.validate(df)) == {("extra_column", "extra"): ("info", 1)}
    wrong = frame([(1, 201347, 3.0)], "cell_id bigint, reference_week bigint, extra double")
    assert ("type_mismatch", "reference_week", "warning", 1) in quality.schema_findings(wrong, "reference_weeks")
    assert ("missing_column", "timestamp", "error", 1) in quality.schema_findings(df, "preprocessed")
    narrow = df.selectExpr("array(cell_id) AS cell_id", "reference_week")
    assert quality.schema_findings(narrow, "reference_weeks") == []
    bad = frame([(1, "2013-47"), (1, "2013_W47"), (1, None)], "cell_id bigint, reference_week string")
    assert tuple(quality.week_format(bad).first()) == (3, 2)


def test_coverage_bands_and_consistency(frame, spark, anomalies):
    grid = spark.createDataFrame([(5,), (6,), (9,), (10,)], "cell_id bigint")
    row = quality.grid_coverage(anomalies, grid).first()
    assert (row.grid_cells, row.data_cells, row.covered_cells, row.coverage_percent) == (4, 4, 2, 50.0)
    arrays = anomalies.selectExpr("array(cell_id) AS cell_id")
    assert {r.cell_id for r in quality.unknown_cells(arrays, grid).collect()} == {7, 8}
    bands = quality.severity_bands(frame([(1, "2013-11-01 00:00:00", 0.0, 0.0, 0.0, 0.0, s) for s in (5.0, 50.0, 500.0)], ANOMALY)).first()
    assert tuple(bands) == (3, 2, 1)
    stages = quality.stage_consistency({"a": anomalies, "b": anomalies.where("cell_id > 5")}).orderBy("position").collect()
    assert [r.same_cells for r in stages] == [True, False]
