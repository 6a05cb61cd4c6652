import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridpulse import schemas, sinks, sources
from gridpulse.sources.raw import rejects

LINES = [
    "1\t1383260400000\t39\t0.1\tbad\tNULL\t\t1",
    "2\tx\t39\t1\t1\t1\t1\t1",
    "3\t1383260400000\t39\t0.5",
    "4\t1383260400000\t39\t1\t2\t3\t4\t5\tsurplus\tmore",
    "\t1383260400000\t39\t1\tnull\t1\t1\t1",
]


@pytest.fixture
def raw_dir(tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES[:3]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(LINES[3:]) + "\n")
    (tmp_path / "ignored.csv").write_text("9\t1383260400000\t39\t1\t1\t1\t1\t1\n")
    return str(tmp_path)


def test_lenient_parsing(spark, raw_dir):
    rows = {r.cell_id: r for r in sources.ingest(spark, raw_dir).collect()}
    assert set(rows) == {1, 3, 4, None}
    assert (rows[1].sms_in, rows[1].sms_out, rows[1].call_in, rows[1].call_out, rows[1].internet_traffic) == (
        0.1, None, None, None, 1.0)
    assert rows[3].sms_in == 0.5 and rows[3].internet_traffic is None
    assert rows[4].internet_traffic == 5.0
    assert rows[None].sms_out is None and rows[None].call_in == 1.0
    assert rows[1].timestamp.isoformat() == "2013-10-31T23:00:00"


def test_ingest_schema_and_parsing_of_a_text_column(spark, raw_dir):
    assert sources.ingest(spark, raw_dir).schema == schemas.INGESTED
    lines = spark.read.text(f"{raw_dir}/*.txt").withColumnRenamed("value", "line")
    parsed = sources.finish_ingest(sources.parse_lines(lines))
    assert sorted(map(str, parsed.collect())) == sorted(map(str, sources.ingest(spark, raw_dir).collect()))


def test_rejected_lines_are_kept(spark, raw_dir):
    good = f"{raw_dir}/c.txt"
    with open(good, "w") as f:
        f.write("8\t1383260400000\t39\t1\t1\t1\t1\t1\n")
    lines = [r._rejected for r in rejects(sources.read_raw(spark, raw_dir, keep_rejects=True)).collect()]
    assert sorted(lines) == sorted(LINES)


def test_missing_files_and_empty_input_fail(spark, tmp_path):
    with pytest.raises(AnalysisException):
        sources.ingest(spark, str(tmp_path))
    (tmp_path / "only.txt").write_text("1\tx\t39\t1\t1\t1\t1\t1\n")
    with pytest.raises(ValueError):
        sources.require_rows(sources.ingest(spark, str(tmp_path)))


def test_key_repair_and_timestamp_repair(spark, frame, tmp_path):
    arrays = spark.createDataFrame([([7],), ([],), (None,)], "cell_id array<bigint>")
    assert [r.cell_id for r in sources.unwrap_key(arrays).collect()] == [7, None, None]
    plain = frame([(7,)], "cell_id bigint")
    assert sources.unwrap_key(plain) is plain
    path = str(tmp_path / "anomalies.csv")
    sinks.write_table(frame([(1, "2013-11-01 10:00:00", 2.5)], "cell_id bigint, timestamp timestamp, severity_score double"), path)
    back = sources.read_anomalies(spark, path)
    assert dict(back.dtypes)["timestamp"] == "timestamp"
    assert back.first().timestamp.isoformat() == "2013-11-01T10:00:00"
    text = frame([("2013-11-01 10:00:00",)], "timestamp string")
    assert sources.as_timestamp(text).first()[0].hour == 10


@pytest.mark.parametrize("name", ["cellId", "cell_id"])
def test_grid_file(spark, tmp_path, name):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {name: i}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        for i in (1, 2)]}
    (tmp_path / "grid.geojson").write_text(json.dumps(collection, indent=1))
    rows = sources.read_grid(spark, str(tmp_path / "grid.geojson")).orderBy("cell_id").collect()
    assert [r.cell_id for r in rows] == [1, 2]
    assert rows[0].geometry.coordinates[0][2] == [1.0, 1.0]


def test_clustered_table_prunes_by_cell(spark, tmp_path):
    df = spark.range(20000).select(
        (F.col("id") % 50).alias("cell_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"))
    path = str(tmp_path / "traffic")
    sinks.write_clustered(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 20000
    spans = back.groupBy(F.input_file_name()).agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))
    plan = back.where("cell_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cell_id,7)" in plan


def test_balanced_table_runs_its_input_once(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 7).alias("cell_id"), "id")
    sinks.write_balanced(df, str(tmp_path / "a"))
    assert sorted(spark.read.parquet(str(tmp_path / "a")).collect()) == sorted(df.collect())
    assert "REBALANCE" in df.hint("rebalance", "cell_id")._jdf.queryExecution().executedPlan().toString()


def test_format_by_extension_and_preview(spark, frame, tmp_path):
    df = frame([(i, i * 0.5) for i in range(9)], "cell_id bigint, x double")
    for name in ("t.csv", "t.parquet"):
        sinks.write_table(df, str(tmp_path / name))
        back = sources.read_table(spark, str(tmp_path / name), df.schema)
        assert sorted(back.collect()) == sorted(df.collect())
    assert sinks.preview(df).count() == 5
