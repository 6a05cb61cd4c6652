"""The physical plans of the operators: what reaches the scan, what is shuffled, what never appears."""

import re

import pytest

from gridpulse.operators import summary, timeline
from gridpulse.plans import panels
from gridpulse.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df)) for c in m.split(",")}


def test_only_needed_columns_are_read(spark):
    found = panels.anomalies(spark, SF_DIR)
    assert read_columns(summary.top_cells(found)) == {"cell_id"}
    assert read_columns(summary.by_hour(found)) == {"timestamp"}
    assert read_columns(summary.most_severe(found).select("severity_score")) == {"cell_id", "timestamp", "severity_score"}


def test_one_cell_is_pushed_to_the_scan(spark):
    rows = timeline.cell_rows(panels.anomalies(spark, SF_DIR), 2)
    assert "EqualTo(cell_id,2)" in plan_of(rows)
    assert "Sort" not in plan_of(timeline.hourly_stats(rows))


def test_top_n_needs_no_global_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(summary.top_cells(panels.anomalies(spark, SF_DIR)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_anywhere(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "FlatMapGroups" not in plan
