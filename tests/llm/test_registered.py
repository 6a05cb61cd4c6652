"""The registered corpus queries: against their SQL, their columns, and what their plans hold."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridpulse.llm.queries import ORACLE, QUERIES
from tools.compare import compare

SF_DIR = "/root/testdata/sf0.001"
# The columns and types of each contract.
COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4": "page_id bigint, host string, path string, rule string, verdict string",
    "op5": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6": "doc_id bigint, n_licenses bigint, licenses string",
    "op7": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10": "doc_id bigint, class_id bigint, copy_of bigint, n_links bigint",
    "op11": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_one_query_each_and_the_pipeline():
    names = [q for q in entry.queries() if q == "pipeline" or q.startswith("op")]
    assert sorted({q.split("_")[0] for q in QUERIES}) == sorted(COLUMNS) and set(names) >= {*QUERIES, "pipeline"}
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns_follow_the_contract(spark, name):
    found = dict(QUERIES[name](spark, SF_DIR).dtypes)
    for column in COLUMNS[name.split("_")[0]].split(", "):
        key, kind = column.split(" ")
        assert found[key] == kind


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare(spark, SF_DIR, name, QUERIES[name], ORACLE[name], con)[2] == "ok"


@pytest.mark.parametrize("name", ["op4_url_filter", "op6_license_scan", "op7_simhash", "op12_centroids"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
