"""Panels stored in buckets: joined without shuffling them, hot cells split, results unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators.joins import BucketedPanel, write_bucketed
from gridpulse.operators.subspace import SubspaceDetector, score, score_bucketed
from gridpulse.plans import panels
from tests.plans import _children, executed, nodes

SF_DIR = "/root/testdata/sf0.001"


def shuffled_scans(plan, below=False):
    """How many file scans of at least a panel's columns lie below an exchange."""
    found = 0
    below = below or "ShuffleExchange" in plan.getClass().getSimpleName()
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        return int(below and plan.relation().bucketSpec().isDefined())
    for child in _children(plan):
        found += shuffled_scans(child, below)
    return found


def test_scoring_shuffles_no_panel_row(spark, tmp_path):
    panel = panels.events_traffic(spark, SF_DIR)
    hot = F.when(F.col("cell_id") % 3 == 0, F.lit(5)).otherwise(F.col("cell_id")).alias("cell_id")  # a third of all rows in one cell
    panel = panel.select(hot, "timestamp", "sms_total", "calls_total", "internet_traffic")
    write_bucketed(panel, "bucketed_test", str(tmp_path / "b"), 4, part_rows=30)
    model = SubspaceDetector(panel, panels.events_weeks(spark, SF_DIR), n_components=1).model()
    model.write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = BucketedPanel(spark, "bucketed_test", str(tmp_path / "b"))
        found = score_bucketed(stored, model)
        plan = executed(found)
        assert "SortMergeJoin" in plan.toString() and shuffled_scans(plan) == 0
        assert [n for n in nodes(plan) if n.getClass().getSimpleName() == "FileSourceScanExec" and n.relation().bucketSpec().isDefined()]
        want = score(panel, model)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() > 100
        assert stored.panel.where("cell_id = 5").select("_salt").distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("DROP TABLE IF EXISTS bucketed_test")
