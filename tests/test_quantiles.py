import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridpulse.operators.quantiles import exact_percentiles

PROBS = (0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def check(spark, values, **options):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = exact_percentiles(df, "x", PROBS, **options)
    assert np.allclose(found, np.percentile(values, [q * 100 for q in PROBS]), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("options", [{}, {"one_task": 10, "bins": 8}, {"one_task": 1, "bins": 2}])
@pytest.mark.parametrize("kind", ["uniform", "tail", "ties", "outlier", "constant", "negative"])
def test_matches_numpy(spark, kind, options):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.random(503), "tail": rng.pareto(0.6, 400) + 2, "ties": rng.integers(0, 4, 300),
        "outlier": np.append(rng.random(200), 1e15), "constant": np.full(50, 3.5), "negative": rng.normal(0, 9, 301),
    }[kind]
    check(spark, values, **options)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, values):
    check(spark, values, one_task=3, bins=4)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_percentiles(df, "x", (0.5,)) == [None]
    mixed = spark.createDataFrame([(None,), (float("nan"),), (4.0,)], "x double")
    assert exact_percentiles(mixed, "x", (0.5,)) == [4.0]


def large(spark, n=200_000, parts=7):
    """Values with a heavy tail, ties, both infinities, NaN and NULL."""
    from pyspark.sql import functions as F

    k = F.col("id")
    x = (
        F.when(k % 1000 == 1, float("inf")).when(k % 1000 == 2, float("-inf")).when(k % 1000 == 3, float("nan"))
        .when(k % 1000 > 3, F.when(k % 5 == 0, 7.0).otherwise(F.pow(F.rand(3) + 1e-9, -1.5))))
    return spark.range(0, n, 1, parts).select(x.alias("x"))


@pytest.mark.parametrize("one_task, sketch", [(20_000, 4096), (500, 4096), (500, 16), (20_000, 8)])
def test_large_columns_by_sketch(spark, tmp_path, one_task, sketch):
    large(spark).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    held = np.array([r.x for r in df.collect() if r.x is not None and not np.isnan(r.x)])
    found = exact_percentiles(df, "x", PROBS, one_task=one_task, bins=64, sketch=sketch)
    ordered, spots = np.sort(held), [q * (len(held) - 1) for q in PROBS]
    want = [ordered[int(s)] if s == int(s) or ordered[int(s)] == ordered[int(s) + 1] else
            ordered[int(s)] * (1 - s % 1) + ordered[int(s) + 1] * (s % 1) for s in spots]
    assert [a == b or np.isclose(a, b, rtol=1e-12) for a, b in zip(found, want)] == [True] * len(PROBS)


def test_a_sketch_that_misses_is_put_right(spark, monkeypatch):
    from gridpulse.operators import quantiles

    monkeypatch.setattr(quantiles, "rank_error", lambda sketch: -0.01)  # brackets beside their ranks
    check(spark, np.random.default_rng(5).normal(0, 1, 900), one_task=100, bins=16, sketch=8)


@pytest.mark.parametrize("n, one_task", [(50_000, 20_000), (300_000, 20_000), (300_000, 500)])
def test_two_scans_whatever_the_size(spark, tmp_path, n, one_task):
    large(spark, n, parts=7).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    tasks = df.rdd.getNumPartitions()
    context = spark.sparkContext
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    group = f"scans-{n}-{one_task}"
    context.setJobGroup(group, "percentiles")
    try:
        # Many small ranges: only a scan of the column has so many tasks.
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.read.parquet(f"{tmp_path}/x")
        tasks = df.rdd.getNumPartitions()
        exact_percentiles(df, "x", PROBS, one_task=one_task, bins=64)
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
        assert tasks > 12 and sum(i.numTasks == tasks for i in infos) == 2, [(i.stageId, i.name[:90]) for i in infos if i.numTasks == tasks]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("outlier", [None, 1e3, 1e12])
def test_density_curve_keeps_its_bound_whatever_the_outliers(spark, outlier):
    from gridpulse.operators.distribution import density_curve

    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 0.5, 1000), [] if outlier is None else [outlier]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = density_curve(df, "x", points=50).orderBy("point").toPandas()
    bandwidth = values.std(ddof=1) * len(values) ** -0.2
    exact = np.array([np.exp(-0.5 * ((p - values) / bandwidth) ** 2).sum() for p in found.x]) / (len(values) * bandwidth * np.sqrt(2 * np.pi))
    peak = 1 / (bandwidth * np.sqrt(2 * np.pi))
    assert np.abs(found.density - exact).max() <= 1.3e-3 * peak
    assert found.x.iloc[0] == values.min() and np.isclose(found.x.iloc[-1], values.max())
