"""What reads of one cell and of one week skip in files clustered one way or the other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridpulse.sinks import write_clustered, write_curved
from tests.plans import executed, scans

CELLS, DAYS = 200, 350


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clustered")
    rows = spark.range(CELLS * DAYS * 4).select(
        F.when(F.col("id") == 7, F.lit(1 << 40)).otherwise(F.pmod(F.xxhash64("id"), F.lit(CELLS))).alias("cell_id"),
        F.timestamp_seconds(F.lit(1388966400) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(DAYS * 86400))).alias("timestamp"), F.rand(1).alias("x"))
    rows.write.parquet(str(folder / "rows"))
    rows = spark.read.parquet(str(folder / "rows"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_clustered(rows, str(folder / "sorted"))
        write_curved(rows, str(folder / "curved"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        hadoop.unset("parquet.block.size")
    return {k: spark.read.parquet(str(folder / k)) for k in ("rows", "sorted", "curved")}


def rows_read(df):
    return sum(s["numOutputRows"] for s in scans(executed(df)))


def test_the_same_rows(stored):
    assert stored["curved"].columns == stored["rows"].columns
    assert stored["curved"].exceptAll(stored["rows"]).isEmpty() and stored["curved"].count() == stored["rows"].count()


def test_one_cell_and_one_week_skip_most_rows(stored):
    total = stored["rows"].count()
    cell = F.col("cell_id") == 77
    week = F.col("timestamp").between(F.lit("2014-06-02").cast("timestamp"), F.lit("2014-06-08 23:59:59").cast("timestamp"))
    curved, plain = stored["curved"], stored["sorted"]
    assert rows_read(plain.where(cell)) < 0.05 * total and rows_read(plain.where(week)) > 0.5 * total
    assert rows_read(curved.where(cell)) < 0.25 * total and rows_read(curved.where(week)) < 0.25 * total
    assert curved.where(cell & week).exceptAll(stored["rows"].where(cell & week)).isEmpty()


def test_row_groups_tell_keys_they_lack(spark, tmp_path):
    """By a Bloom filter where there are too many keys for a dictionary; times have statistics."""
    rows = spark.range(2_000_000).select(
        F.xxhash64("id").alias("cell_id"), F.timestamp_seconds(F.lit(1388966400) + F.col("id") % 86400).alias("timestamp"), (F.col("id") % 9).alias("x"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    write_curved(rows, str(tmp_path / "t"))
    spark.conf.set("spark.sql.shuffle.partitions", held)
    jvm = spark._jvm
    path = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        jvm.org.apache.hadoop.fs.Path(spark.read.parquet(str(tmp_path / "t")).inputFiles()[0]), spark._jsparkSession.sessionState().newHadoopConf())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(path)
    columns = {c.getPath().toDotString(): c for c in reader.getFooter().getBlocks().get(0).getColumns()}
    reader.close()
    assert columns["cell_id"].getBloomFilterOffset() > 0 > columns["x"].getBloomFilterOffset()
    assert columns["timestamp"].getStatistics().hasNonNullValue()


def test_empty_tables_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(None, None, 1.0), (1, None, 2.0), (None, None, 3.0)], "cell_id long, timestamp timestamp, x double")
    for k, df in enumerate((rows, rows.limit(0), rows.union(rows.selectExpr("5L", "timestamp'2014-01-01'", "x")))):
        write_curved(df, f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == df.count()
