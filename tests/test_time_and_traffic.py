from pyspark.sql import functions as F

from gridpulse.functions import timekeys as tk
from gridpulse.functions.rounding import fixed_text, round_half_even
from gridpulse.operators.traffic import build_traffic, merge_directions, sum_measures

INGESTED = ("timestamp timestamp, cell_id bigint, sms_in double, sms_out double, call_in double, "
            "call_out double, internet_traffic double")


def test_iso_years_at_the_borders(frame):
    df = frame([("2013-12-31 10:00:00",), ("2016-01-01 00:00:00",), ("2013-11-18 00:00:00",)], "t timestamp")
    rows = df.select(tk.week_label("t"), tk.week_number("t"), tk.weekday_name("t"), tk.weekday_short("t")).collect()
    assert [tuple(r) for r in rows] == [
        ("2014_W01", 201401, "Tuesday", "Tue"), ("2015_W53", 201553, "Friday", "Fri"), ("2013_W47", 201347, "Monday", "Mon")]


def test_week_index_is_the_iso_week(spark):
    hours = spark.sql("SELECT timestamp '1968-12-20 05:00:00' + make_interval(0, 0, 0, id, id % 24) AS t FROM range(20000)")
    wrong = hours.where(tk.week_label("t") != tk.week_label(tk.index_monday(tk.week_index("t"))))
    assert wrong.count() == 0
    assert hours.where(tk.weekday_name(tk.index_monday(tk.week_index("t"))) != "Monday").count() == 0


def test_labels_round_trip_and_bad_labels_are_null(frame):
    df = frame([("2013_W47",), ("soon",)], "label string")
    assert [r[0] for r in df.select(tk.label_number("label")).collect()] == [201347, None]


def test_half_even_rounding(frame):
    df = frame([(0.125,), (12.35,), (1.115,), (2.5,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x")).collect()] == [0.12, 12.35, 1.12, 2.5, -0.12]
    assert [r[0] for r in df.select(fixed_text("x", 1)).collect()] == ["0.1", "12.4", "1.1", "2.5", "-0.1"]


def test_sums_fold_countries_and_nulls_are_zero(frame):
    t = "2013-11-01 00:00:00"
    df = frame([(t, 1, 1.0, None, 2.0, 3.0, None), (t, 1, 4.0, None, None, 1.0, None), (t, None, 1.0, 1.0, 1.0, 1.0, 1.0)], INGESTED)
    rows = {r.cell_id: r for r in sum_measures(df).collect()}
    assert (rows[1].sms_in, rows[1].sms_out, rows[1].internet_traffic) == (5.0, 0.0, 0.0)
    traffic = {r.cell_id: r for r in build_traffic(df).collect()}
    assert (traffic[1].sms_total, traffic[1].calls_total, traffic[1].internet_traffic) == (5.0, 6.0, 0.0)
    assert None in traffic


def test_other_merges(frame):
    df = frame([(1, 2.0, 3.0, 4.0)], "cell_id bigint, a double, b double, c double")
    assert merge_directions(df, {"all": ("a", "b", "c")}).collect()[0].asDict() == {"cell_id": 1, "all": 9.0}


def test_aggregation_combines_before_the_shuffle(frame):
    df = build_traffic(frame([("2013-11-01 00:00:00", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], INGESTED))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_day_keys(frame):
    df = frame([("2013-11-02 23:59:59",)], "t timestamp")
    row = df.select(tk.hour_of_day("t"), tk.calendar_date("t").cast("string"), tk.weekday_index("t"), F.lit(1)).first()
    assert tuple(row) == (23, "2013-11-02", 5, 1)
