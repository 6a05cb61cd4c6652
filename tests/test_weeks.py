from gridpulse.operators import weeks

TRAFFIC = "cell_id bigint, timestamp timestamp, sms_total double, calls_total double, internet_traffic double"
MONDAYS = ["2013-11-04 00:00:00", "2013-11-11 00:00:00", "2013-11-18 00:00:00", "2013-11-25 00:00:00", "2013-12-02 00:00:00"]


def panel(frame, values, cell=1):
    return frame([(cell, t, float(v), float(v), float(v)) for t, v in zip(MONDAYS, values)], TRAFFIC)


def chosen(df):
    return [(r.reference_week, round(r.stability_score, 6)) for r in df.orderBy("stability_score", "reference_week").collect()]


def test_zero_mad_excludes_any_deviation(frame):
    picked = chosen(weeks.select_reference_weeks(panel(frame, [5, 5, 5, 9])))
    assert picked == [("2013_W45", 0.0), ("2013_W46", 0.0), ("2013_W47", 0.0)]


def test_single_week_is_normal(frame):
    assert chosen(weeks.select_reference_weeks(panel(frame, [5]))) == [("2013_W45", 0.0)]


def test_ties_go_to_the_earlier_week(frame):
    # Deviations 1, 1, 0, 1, 1 around the median: one place for four equal scores.
    picked = chosen(weeks.select_reference_weeks(panel(frame, [4, 6, 5, 4, 6]), num_weeks=2))
    assert [w for w, _ in picked] == ["2013_W47", "2013_W45"]


def test_threshold_and_limit(frame):
    df = panel(frame, [10, 11, 12, 13, 20])
    assert [w for w, _ in chosen(weeks.select_reference_weeks(df, num_weeks=9))] == ["2013_W47", "2013_W46", "2013_W48"]
    assert len(chosen(weeks.select_reference_weeks(df, num_weeks=9, mad_threshold=2.0))) == 4
    assert len(chosen(weeks.select_reference_weeks(df, num_weeks=1))) == 1


def test_every_feature_must_be_normal(frame):
    rows = [(1, t, 5.0, 5.0, 9.0 if i == 3 else 5.0) for i, t in enumerate(MONDAYS[:4])]
    picked = chosen(weeks.select_reference_weeks(frame(rows, TRAFFIC)))
    assert "2013_W48" not in [w for w, _ in picked]


def test_order_and_partitioning_do_not_matter(frame):
    df = panel(frame, [10, 11, 12, 13, 20]).union(panel(frame, [1, 2, 2, 3, 9], cell=2))
    a = weeks.select_reference_weeks(df)
    b = weeks.select_reference_weeks(df.repartition(5).orderBy("sms_total"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_medians_share_one_exchange_and_top_n_is_pruned_early(frame):
    plan = weeks.select_reference_weeks(panel(frame, [1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "WindowGroupLimit" in plan
