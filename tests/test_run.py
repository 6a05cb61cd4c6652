"""The staged run end to end, and every registered query against its SQL counterpart."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridpulse.operators import summary
from gridpulse.plans import panels, stages
from gridpulse.plans.catalog import QUERIES
from gridpulse.plans.oracle import ORACLE
from gridpulse.session import shared_dir
from tools.compare import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, _, verdict = compare(spark, SF_DIR, name, QUERIES[name], ORACLE[name], con)
    assert verdict == "ok"


def test_entry(spark):
    assert [r.n for r in entry.entry(spark).collect()] == [14, 11, 8, 8, 8]


def test_run_from_raw_files(spark, tmp_path):
    lines = panels.events(spark, SF_DIR).select(F.concat_ws(
        "\t", "user_id", F.unix_millis(F.date_trunc("day", "ts")).cast("string"), F.lit("39"),
        *[F.when(F.col("event_type") == e, F.col("value").cast("string")).otherwise("") for e in panels.EVENT_MEASURES]))
    lines.write.text(str(tmp_path / "raw"))
    out = str(tmp_path / "out")
    tables = stages.run(spark, str(tmp_path / "raw"), out_dir=out)
    assert tables["traffic"].count() == 397
    assert tables["reference_weeks"].count() == 28
    assert tables["anomalies"].count() == 89
    assert sorted(os.listdir(out)) == ["anomalies", "ingested", "model", "reference_weeks", "traffic"]
    assert tables["summary"].where("key = 'Total Anomalies Detected'").first().value == "89"
    written = {n: tables[n] for n in ("ingested", "traffic", "reference_weeks", "model", "anomalies")}
    counted = summary.stage_yield(written).collect()
    seen = tables["yields"].orderBy("position").collect()
    assert [(r.stage, r.rows, r.reduction_percent) for r in seen] == [(r.stage, r.rows, r.reduction_percent) for r in counted]
    span = tables["traffic"].agg(F.min("timestamp"), F.max("timestamp")).first()
    assert (seen[1].first_time, seen[1].last_time) == tuple(span) and seen[3].first_time is None
    assert stages.run(spark, ingested=tables["ingested"], n_components=1)["anomalies"].count() == 84
    short = stages.run(spark, str(tmp_path / "raw"), keep_ingested=False, keep_model=False)
    assert sorted(short) == ["anomalies", "reference_weeks", "summary", "traffic", "yields"] and short["anomalies"].count() == 89
    maps = stages.map_tables(spark, tables["anomalies"], panels.grid(spark, SF_DIR), metrics=("anomaly_count", "nothing"))
    assert sorted(maps) == [
        "cell_stats", "classified_anomaly_count", "extreme_cells", "features_anomaly_count", "features_extreme",
        "points_anomaly_count", "report_anomaly_count", "report_extreme"]
    assert maps["features_extreme"].count() == maps["features_anomaly_count"].count() == 150
    assert maps["classified_anomaly_count"].count() == 150
    cell = stages.timeline_tables(tables["anomalies"])
    assert cell["timeline"].count() == 14 and cell["weekday"].count() == 7
    assert cell["severity"].agg(F.sum("n")).first()[0] == 14
    assert cell["report"].where("key = 'Cell ID'").first().value == "2"


def test_staged_tables_live_in_the_shared_folder(spark):
    table = panels.events_traffic(spark, SF_DIR)
    assert all(shared_dir(spark).removeprefix("file:") in f for f in table.inputFiles())
