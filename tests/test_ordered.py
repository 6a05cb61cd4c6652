"""Duplicate keys found among neighbours: equal to grouping, no shuffle of rows, and a fallback where the order does not hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import quality
from gridpulse.operators.ordered import clustered_duplicates, in_order, key_runs
from gridpulse.session import stage_table
from gridpulse.sinks import write_clustered
from tests.plans import executed, nodes

SCHEMA = "cell_id long, timestamp timestamp, x double"


def rows_of(rng, n, cells, times):
    return [(rng.choice([None, *range(cells)]), rng.choice([None, *range(times)]), rng.random()) for _ in range(n)]


def panel(spark, rows):
    df = spark.createDataFrame(rows, "cell_id long, t long, x double")
    return df.select("cell_id", F.timestamp_seconds(F.col("t") * 600).alias("timestamp"), "x")


def same(spark, df):
    assert sorted(clustered_duplicates(df).collect(), key=str) == sorted(quality.duplicate_keys(df).collect(), key=str)


@pytest.mark.parametrize("n, cells, times", [(3000, 40, 200), (500, 3, 4), (1, 1, 1), (200, 1, 1), (2000, 500, 5000)])
def test_equals_grouping(spark, tmp_path, n, cells, times):
    write_clustered(panel(spark, rows_of(random.Random(n + cells), n, cells, times)), f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    same(spark, stored)
    assert in_order(stage_table(key_runs(stored), "runs"))


def test_many_small_batches_and_ranges(spark, tmp_path):
    rows = panel(spark, rows_of(random.Random(5), 6000, 30, 100)).repartition(1).sortWithinPartitions("cell_id", "timestamp")
    rows.write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        same(spark, stored)
        assert in_order(stage_table(key_runs(stored), "runs"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_panel_rows_are_not_shuffled(spark, tmp_path):
    write_clustered(panel(spark, rows_of(random.Random(1), 3000, 40, 2000)), f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert not [n for n in nodes(executed(key_runs(stored))) if "Exchange" in n.nodeName()]
    runs = stage_table(key_runs(stored), "runs")
    repeats = quality.duplicate_keys(stored).count()
    assert runs.count() <= repeats + 2 * len(stored.inputFiles()) + 2
    found = clustered_duplicates(stored)
    assert all("run-" not in f and f"{tmp_path}" not in f for f in found.inputFiles())  # reads the runs, not the panel


@pytest.mark.parametrize("order", ["cell_id DESC", "x"])
def test_unordered_files_are_grouped(spark, tmp_path, order):
    panel(spark, rows_of(random.Random(2), 400, 5, 20)).repartition(1).orderBy(F.expr(order.split()[0]).desc()).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert not in_order(stage_table(key_runs(stored), "runs"))
    same(spark, stored)


def test_overlapping_files_and_other_plans_are_grouped(spark, tmp_path):
    for k in range(2):
        write_clustered(panel(spark, rows_of(random.Random(7), 200, 5, 20)), f"{tmp_path}/t{k}")
    stored = spark.read.parquet(f"{tmp_path}/t0", f"{tmp_path}/t1")
    assert not in_order(stage_table(key_runs(stored), "runs"))
    same(spark, stored)
    same(spark, panel(spark, rows_of(random.Random(7), 200, 5, 20)))  # no file scan
    texts = stored.select(F.col("cell_id").cast("string").alias("cell_id"), "timestamp", "x")
    same(spark, texts)


def test_no_rows_and_the_gate(spark, tmp_path):
    write_clustered(panel(spark, []), f"{tmp_path}/e")
    same(spark, spark.read.parquet(f"{tmp_path}/e"))
    write_clustered(panel(spark, [(1, 1, 0.5), (1, 1, 0.5), (2, 1, 0.1)]), f"{tmp_path}/d")
    with pytest.raises(ValueError, match="2 rows share a key"):
        quality.require_clean(spark.read.parquet(f"{tmp_path}/d"))
