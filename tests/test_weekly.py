"""Panels in a folder per week: what is read, and that results do not change."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridpulse.operators.subspace import SubspaceDetector, training_rows
from gridpulse.plans import panels, stages
from gridpulse.schemas import WEEK
from gridpulse.sinks import write_weekly
from tests.plans import executed, scans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """Two cells over 60 weeks; the reference weeks are the first and the last few of them, far apart."""
    path = str(tmp_path_factory.mktemp("weekly") / "panel")
    days = spark.range(60 * 7).select(F.col("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cell_id"))
    rows = days.select(
        F.col("cell_id").cast("long"), F.timestamp_seconds(F.lit(1388966400) + F.col("id") * 86400).alias("timestamp"),
        (F.sin("id") + 2 * F.col("cell_id")).alias("sms_total"), (F.cos(F.col("id") * 3) + 3).alias("calls_total"),
        (F.sin(F.col("id") * 7) * 2 + 5).alias("internet_traffic"))
    write_weekly(rows, path)
    return spark.read.parquet(path), rows, path


@pytest.fixture(scope="module")
def weeks(spark):
    rows = [(1, "2014_W02", 0.1), (1, "2014_W03", 0.2), (2, "2015_W08", 0.1), (2, "2014_W02", 0.3)]
    return spark.createDataFrame(rows, "cell_id long, reference_week string, stability_score double")


def test_one_folder_a_week(panel):
    stored, rows, path = panel
    assert stored.select(WEEK).distinct().count() == 60 and stored.count() == rows.count()


def test_training_reads_the_listed_weeks_only(panel, weeks):
    stored, rows, _ = panel
    found = training_rows(stored, weeks, week=WEEK)
    plan = executed(found)
    assert "dynamicpruning" in plan.toString().lower()
    assert [s["numPartitions"] for s in scans(plan) if WEEK in s["folders"]] == [3]
    want = training_rows(rows, weeks)
    assert sorted(found.drop(WEEK).collect()) == sorted(want.collect())


@pytest.mark.parametrize("limit", [None, 0])
def test_models_and_anomalies_do_not_change(panel, weeks, limit):
    stored, rows, _ = panel
    by_week, plain = SubspaceDetector(stored, weeks, limit=limit, week=WEEK), SubspaceDetector(rows, weeks)

    def rounded(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())

    columns = ("cell_id", "n_train", "mean_error", "std_error", "threshold")
    model = by_week.model()
    plan = executed(model)
    assert {s["numPartitions"] for s in scans(plan) if WEEK in s["folders"]} == {3}
    assert rounded(model.select(*columns)) == rounded(plain.model().select(*columns))
    assert rounded(by_week.anomalies()) == rounded(plain.anomalies())


def test_without_reference_weeks_nothing_is_read(panel, weeks):
    stored, _, _ = panel
    assert training_rows(stored, weeks.where("false"), week=WEEK).count() == 0
    assert SubspaceDetector(stored, weeks.where("false"), week=WEEK).anomalies().count() == 0


def test_a_run_by_week_equals_a_plain_run(spark):
    ingested = panels.events_ingested(spark, SF_DIR)
    plain, weekly = stages.run(spark, ingested=ingested), stages.run(spark, ingested=ingested, by_week=True)
    keys = ["cell_id", "timestamp"]
    assert weekly["anomalies"].columns == plain["anomalies"].columns
    assert sorted(weekly["anomalies"].select(keys).collect()) == sorted(plain["anomalies"].select(keys).collect())
    assert WEEK in weekly["traffic"].columns


def test_stage_tables_follow_the_input(spark, tmp_path):
    def numbers(n):
        return panels.staged(spark, str(tmp_path), "numbers", lambda: spark.read.parquet(f"{tmp_path}/in.parquet")).count()

    spark.range(3).write.parquet(f"{tmp_path}/in.parquet")
    assert numbers(3) == 3
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/in.parquet")
    assert numbers(5) == 5
