import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.functions import timekeys
from gridpulse.operators import subspace, weeks
from gridpulse.schemas import ANOMALIES
from gridpulse.session import stage_table

TRAFFIC = "cell_id bigint, timestamp timestamp, sms_total double, calls_total double, internet_traffic double"
REFS = "cell_id bigint, reference_week string, stability_score double"
DAYS = [f"2013-11-{d:02d} 12:00:00" for d in range(4, 25)]


def brute_force(rows, trained, k, t, standardize=True):
    """Direct singular value decomposition of one cell's training rows."""
    train = rows[trained]
    mean, scale = train.mean(axis=0), train.std(axis=0)
    scale = np.where(scale <= 1e-12, 1.0, scale)
    if not standardize:
        mean, scale = np.zeros_like(mean), np.ones_like(scale)
    z = (train - mean) / scale
    _, s, vt = np.linalg.svd(z, full_matrices=True)
    eigen = np.append(s, np.zeros(rows.shape[1] - len(s))) ** 2 / len(train)
    kept = vt[: min(k, int((eigen > 1e-9).sum()))]

    def errors(x):
        x = (x - mean) / scale
        e = np.linalg.norm(x - x @ kept.T @ kept, axis=1)
        return np.where(e <= 1e-6, 0.0, e)

    fit = errors(train)
    mu, sd = fit.mean(), fit.std()
    sd = 0.0 if sd <= 1e-6 else sd
    score = errors(rows)
    severity = (score - mu) / sd if sd else score - mu
    return score, severity, score > mu + t * sd


def random_panel(cells, rng):
    rows = {}
    for c in range(cells):
        base = rng.gamma(2.0, 20.0, (len(DAYS), 3)).round(2)
        base[:, 1] = (base[:, 0] * 0.7 + rng.random(len(DAYS)) * 5).round(2)
        if c % 4 == 0:
            base[:, 2] = 3.0
        rows[c] = base
    return rows


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    data = random_panel(12, rng)
    flat = [(c, d, *map(float, v)) for c, m in data.items() for d, v in zip(DAYS, m)]
    loose = TRAFFIC.replace("timestamp timestamp", "timestamp string")
    traffic = spark.createDataFrame(flat, loose).withColumn("timestamp", F.to_timestamp("timestamp")).cache()
    refs = spark.createDataFrame(
        [(c, w, 0.0) for c in range(12) for w in (["2013_W45", "2013_W47"] if c % 3 else ["2013_W46"])], REFS).cache()
    trained = {c: np.array([(7 <= i < 14) == (c % 3 == 0) for i in range(21)]) for c in range(12)}
    return data, traffic, refs, trained


@pytest.mark.parametrize("k,t,standardize", [(1, 2.0, True), (2, 2.0, True), (3, 2.0, True), (2, 1.0, True), (1, 2.0, False)])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_matches_direct_decomposition(panel, k, t, standardize, limit):
    data, traffic, refs, trained = panel
    detector = subspace.SubspaceDetector(traffic, refs, k, t, standardize, limit=limit, part_rows=5)
    scores = {(r.cell_id, str(r.timestamp)): r.anomaly_score for r in detector.scores().collect()}
    found = {(r.cell_id, str(r.timestamp)): r.severity_score for r in detector.anomalies().collect()}
    expected = {}
    for c, rows in data.items():
        score, severity, flag = brute_force(rows, trained[c], k, t, standardize)
        for d, s, v, f in zip(DAYS, score, severity, flag):
            assert scores[(c, d)] == pytest.approx(s, abs=1e-9)
            if f:
                expected[(c, d)] = v
    assert found.keys() == expected.keys()
    for key, v in expected.items():
        assert found[key] == pytest.approx(v, rel=1e-6)
    if t > 0:
        assert all(v >= 0 for v in found.values())


def test_schema_and_unique_keys(panel):
    _, traffic, refs, _ = panel
    found = subspace.detect(traffic, refs)
    assert found.schema.simpleString() == ANOMALIES.simpleString()
    assert found.count() == found.select("cell_id", "timestamp").distinct().count()


def test_partitioning_does_not_matter(panel):
    _, traffic, refs, _ = panel
    a = subspace.detect(traffic, refs)
    b = subspace.detect(traffic.orderBy(F.desc("internet_traffic")).repartition(5), refs)

    def key(df):
        return sorted((r.cell_id, r.timestamp, round(r.severity_score, 6)) for r in df.collect())
    assert key(a) == key(b)


def test_severity_exceeds_the_threshold_where_there_is_a_spread(panel):
    _, traffic, refs, _ = panel
    detector = subspace.SubspaceDetector(traffic, refs, 1, anomaly_threshold=1.5)
    spread = detector.model().where("std_error > 0").select("cell_id", "threshold", "mean_error", "std_error")
    rows = detector.anomalies().join(spread, "cell_id").collect()
    assert rows and all(r.severity_score > 1.5 and r.anomaly_score > r.threshold >= r.mean_error for r in rows)


def test_mark_and_training_rows(panel):
    _, traffic, refs, trained = panel
    for limit in (100_000, 0):
        marked = subspace.mark_reference(traffic, refs, limit=limit)
        assert marked.count() == traffic.count()
        n = {r.cell_id: r.n for r in marked.where("is_reference").groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
        assert n == {c: int(m.sum()) for c, m in trained.items()}
        assert subspace.training_rows(traffic, refs, limit=limit).count() == sum(n.values())


def test_stored_model_gives_the_same_scores(panel):
    _, traffic, refs, _ = panel
    detector = subspace.SubspaceDetector(traffic, refs)
    model = detector.model().cache()
    for limit in (100_000, 0):
        direct = {(r.cell_id, r.timestamp): round(r.anomaly_score, 9) for r in detector.scores().collect()}
        stored = {(r.cell_id, r.timestamp): round(r.anomaly_score, 9) for r in subspace.score(traffic, model, limit=limit).collect()}
        assert direct == stored
    row = model.first()
    assert len(row.components) == row["rank"] and len(row.residual_map) == 9
    model.unpersist()


def one_cell(frame, train, test):
    rows = [(1, f"2013-11-{4 + i:02d} 00:00:00", *map(float, v)) for i, v in enumerate(train)]
    rows += [(1, f"2013-11-{11 + i:02d} 00:00:00", *map(float, v)) for i, v in enumerate(test)]
    return frame(rows, TRAFFIC), frame([(1, "2013_W45", 0.0)], REFS)


def test_constant_feature_has_unit_scale(frame):
    traffic, refs = one_cell(frame, [(1, 2, 5), (3, 1, 5), (2, 4, 5), (5, 5, 5)], [(1, 2, 8)])
    model = subspace.fit(traffic, refs, n_components=2).first()
    assert model.scale[2] == 1.0
    found = subspace.detect(traffic, refs, n_components=2).collect()
    # Off the trained plane and no training error: flagged with the plain difference.
    assert [(r.internet_traffic, round(r.severity_score, 9)) for r in found] == [(8.0, 3.0)]


def test_rounding_noise_is_a_constant(frame):
    noisy = [100000.1, np.nextafter(100000.1, 2e5), 100000.1, np.nextafter(100000.1, 0)]
    train = [(1, 2, noisy[0]), (3, 1, noisy[1]), (2, 4, noisy[2]), (5, 5, noisy[3])]
    traffic, refs = one_cell(frame, train, [(2, 2, 100000.1), (2, 2, 100003.1)])
    assert subspace.fit(traffic, refs).first().scale[2] == 1.0
    assert [round(r.severity_score, 6) for r in subspace.detect(traffic, refs).collect()] == [3.0]


def test_full_rank_flags_nothing(frame):
    traffic, refs = one_cell(frame, [(1, 2, 5), (3, 1, 6), (2, 4, 9), (5, 5, 1), (7, 1, 2)], [(900, -3, 44)])
    assert subspace.detect(traffic, refs, n_components=3).count() == 0
    assert subspace.detect(traffic, refs, n_components=7).count() == 0


def test_single_training_row(frame):
    traffic, refs = one_cell(frame, [(1, 2, 5)], [(1, 2, 5), (4, 6, 5)])
    found = subspace.detect(traffic, refs).collect()
    assert [round(r.anomaly_score, 9) for r in found] == [5.0]


def test_cells_without_weeks_and_empty_weeks(frame):
    traffic, refs = one_cell(frame, [(1, 2, 5), (2, 2, 2), (3, 2, 8)], [(9, 9, 9)])
    other = traffic.withColumn("cell_id", F.lit(2).cast("bigint"))
    assert {r.cell_id for r in subspace.SubspaceDetector(traffic.union(other), refs).scores().collect()} == {1}
    none = subspace.detect(traffic, refs.where("false"))
    assert none.count() == 0 and none.columns == ANOMALIES.fieldNames()


def test_other_feature_sets(frame):
    rng = np.random.default_rng(5)
    rows = [(1, d, *map(float, rng.random(4))) for d in DAYS]
    df = frame(rows, "k bigint, t timestamp, a double, b double, c double, d double")
    picked = weeks.select_reference_weeks(df, features=("a", "b", "c", "d"), key="k", time="t", mad_threshold=1e12)
    assert picked.count() == 3
    data = np.array([r[2:] for r in rows])
    scores = subspace.SubspaceDetector(df, picked, 2, features=("a", "b", "c", "d"), key="k", time="t").scores()
    expected, _, _ = brute_force(data, np.ones(21, dtype=bool), 2, 2.0)
    found = [r.anomaly_score for r in scores.orderBy("t").collect()]
    assert found == pytest.approx(expected.tolist(), abs=1e-9)


def test_rank_must_be_positive(panel):
    _, traffic, refs, _ = panel
    with pytest.raises(ValueError):
        subspace.detect(traffic, refs, n_components=0)


def test_shuffled_panel_is_one_exchange_for_all_passes(spark, panel):
    traffic, refs = stage_table(panel[1], "traffic"), stage_table(panel[2], "weeks")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        found = subspace.detect(traffic, refs, limit=0, part_rows=5)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for n in names:
            spark.conf.unset(n)
    # Two of the three passes read the exchange of the third; a plan prints reuse once executed.
    assert sum("ReusedExchange" in line and "timestamp#" in line for line in plan.splitlines()) == 2
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_training_reads_a_range_of_weeks_and_decomposes_once_per_branch(panel, tmp_path):
    _, traffic, refs, _ = panel
    traffic.write.parquet(str(tmp_path / "panel"))
    stored = traffic.sparkSession.read.parquet(str(tmp_path / "panel"))
    stored.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    found = subspace.SubspaceDetector(stored, refs, 2).anomalies()
    plan = found._jdf.queryExecution().executedPlan().toString()
    stored.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("GreaterThanOrEqual(timestamp" in line for line in scans) >= 2
    assert plan.count("ArrowEvalPython") <= 2 and "weekofyear" not in plan and "yearofweek" not in plan.lower()


def test_week_labels_become_indexes(spark):
    days = spark.sql("SELECT explode(sequence(timestamp'2004-12-20', timestamp'2027-01-20', interval 5 days)) AS t")
    rows = days.select(timekeys.week_index("t").alias("a"), timekeys.label_index(timekeys.week_label("t")).alias("b"), "t").collect()
    assert all(r.a == r.b for r in rows)
    assert all(timekeys.week_start(r.a) <= str(r.t) < timekeys.week_start(r.a + 1) for r in rows)
    odd = spark.createDataFrame([("x",), (None,), ("2013_W00",)], "label string")
    assert [r[0] for r in odd.select(timekeys.label_index("label")).collect()] == [None, None, None]


def test_equal_eigenvalues_take_the_leading_features(frame):
    """Three days with a feature each: correlations of -1/2, eigenvalues 3/2, 3/2 and 0. A rotation of the first two features gives (1, -1, 0)."""
    traffic, refs = one_cell(frame, [(4, 0, 0), (0, 30, 0), (0, 0, 7)], [(1, 2, 3)])
    for parts in (1, 3):
        model = subspace.fit(traffic.repartition(parts), refs, n_components=1).first()
        assert model["rank"] == 1 and model.eigenvalues == pytest.approx([1.5, 1.5, 0.0], abs=1e-9)
        expected = np.array([[0.5, 0.5, 0], [0.5, 0.5, 0], [0, 0, 1]]) / np.array(model.scale)
        assert model.residual_map == pytest.approx(expected.ravel().tolist(), abs=1e-9)
