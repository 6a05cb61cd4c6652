"""Models whose axes come from stored weekly moments equal models fitted to the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.operators.subspace import SubspaceDetector, merged_moments, week_moments
from tests.plans import executed, scans

SCHEMA = "cell_id long, reference_week string, stability_score double"


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """Three cells over 12 weeks; one has means a million times its spread, one a constant feature."""
    rows = spark.range(12 * 7 * 6).select(F.col("id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cell_id")).select(
        F.col("cell_id").cast("long"), F.timestamp_seconds(F.lit(1388966400) + F.col("id") * 14400).alias("timestamp"),
        (F.rand(1) + F.when(F.col("cell_id") == 2, 1e6).otherwise(0)).alias("sms_total"),
        F.when(F.col("cell_id") == 3, 4.5).otherwise(F.rand(2) * 3).alias("calls_total"), (F.rand(3) * F.col("id") % 5).alias("internet_traffic"))
    path = str(tmp_path_factory.mktemp("moments") / "panel")
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def weeks(spark):
    return spark.createDataFrame([(c, f"2014_W{w:02}", 0.1) for c in (1, 2, 3) for w in (2, 5, 9, 11)] + [(9, "2014_W02", 0.1)], SCHEMA)


def close(left, right):
    columns = [c for c in left.columns if c != "components"]
    a, b = (df.select(columns).orderBy("cell_id").collect() for df in (left, right))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for c in columns:
            assert np.allclose(np.array(x[c], float), np.array(y[c], float), rtol=1e-9, atol=1e-9), (c, x[c], y[c])


@pytest.mark.parametrize("cut", [1, 3])
@pytest.mark.parametrize("standardize", [True, False])
def test_refit_equals_a_fresh_fit(panel, weeks, cut, standardize):
    """Loads cut anywhere, so that weeks lie in several of them."""
    part = F.pmod(F.unix_seconds("timestamp") / 14400, F.lit(cut)).cast("int")
    moments = week_moments(panel.where(part == 0))
    for k in range(1, cut):
        moments = moments.unionByName(week_moments(panel.where(part == k)))
    options = {"n_components": 1, "standardize": standardize}
    close(SubspaceDetector(panel, weeks, moments=moments, **options).model(), SubspaceDetector(panel, weeks, **options).model())


def test_other_weeks_need_no_panel(spark, panel, weeks, tmp_path):
    week_moments(panel).write.parquet(f"{tmp_path}/moments")
    moments = spark.read.parquet(f"{tmp_path}/moments")
    merged = merged_moments(moments, weeks.where("reference_week <> '2014_W05'"))
    plan = executed(merged)
    assert all("moments" in f for f in merged.inputFiles()) and sum(s["numOutputRows"] for s in scans(plan)) <= 36
    basis = SubspaceDetector(panel, weeks, n_components=1, moments=moments).basis()
    close(basis, SubspaceDetector(panel, weeks, n_components=1).basis())
    assert all("moments" in f for f in basis.inputFiles())


def test_rows_that_cannot_be_used_and_no_weeks(spark, panel, weeks):
    odd = panel.limit(50).withColumn("sms_total", F.lit(float("nan"))).unionByName(panel.limit(10).withColumn("calls_total", F.lit(None).cast("double")))
    close(SubspaceDetector(panel, weeks, n_components=1, moments=week_moments(panel.unionByName(odd))).model(),
          SubspaceDetector(panel, weeks, n_components=1).model())
    assert merged_moments(week_moments(panel), weeks.where("false")).isEmpty()
