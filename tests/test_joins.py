import pytest
from pyspark.sql import functions as F

from gridpulse.operators.joins import HOT_PARTS, Lookup, broadcast_rows, hot_keys


@pytest.fixture
def skewed(spark):
    """Cell 7 holds a third of the rows; some rows have no cell."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 2000).cast("bigint").alias("cell_id"),
        "id", (F.col("id") % 4).alias("week"),
    )


def test_hot_keys_are_few_and_sized_by_their_rows(spark, skewed, monkeypatch):
    assert {r.cell_id: r[1] for r in hot_keys(skewed, "cell_id", 500).collect()} == {7: 5}
    assert hot_keys(skewed, "cell_id").count() == 0
    every = hot_keys(skewed, "cell_id", 1)
    assert every.count() < HOT_PARTS
    # With few parts allowed only keys above their share are split, however small a part may be.
    monkeypatch.setattr("gridpulse.operators.joins.HOT_PARTS", 10)
    assert {r.cell_id: r[1] for r in hot_keys(skewed, "cell_id", 1).collect()} == {7: 4}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [[], ["week"]])
def test_salted_join_equals_plain_join(spark, skewed, how, on):
    table = spark.range(0, 2000, 3).select(F.col("id").alias("cell_id"), (F.col("id") % 4).alias("week"), F.lit(1).alias("hit"))
    table = table.union(spark.sql("SELECT 7L, w.id, 1 FROM range(4) w WHERE w.id <> 7 % 4"))
    if not on:
        table = table.select("cell_id", "hit").distinct()
    salted = Lookup(skewed, "cell_id", rows=10**9, part_rows=2).join(table, how, on)
    plain = skewed.join(table, ["cell_id", *on], how)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_wide_tables_are_broadcast_up_to_fewer_rows():
    assert broadcast_rows(16) == 209_715 and broadcast_rows(1000) < 5000


def test_hot_rows_spread_over_partitions(spark, skewed):
    panel = Lookup(skewed, "cell_id", rows=10**9, part_rows=6).panel
    salts = panel.where("cell_id = 7").groupBy("_salt").count()
    assert salts.count() > 300
    assert salts.agg(F.max("count")).first()[0] < 40
    assert panel.where("cell_id <> 7 AND _salt <> 0").count() == 0


def test_small_tables_are_broadcast_and_large_ones_are_not(spark, skewed):
    table = spark.range(10).select(F.col("id").alias("cell_id"))
    plan = Lookup(skewed, "cell_id", rows=10).join(table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Lookup(skewed, "cell_id", rows=10**9).join(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan
