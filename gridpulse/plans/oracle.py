"""The SQL counterpart of every registered query, written independently of the Spark code.

Table expressions are chained by name; the eigen-decomposition of each cell's 3×3 moment matrix is a
cyclic Jacobi iteration in a recursive table expression.
"""

from __future__ import annotations

FEATURES = ("sms_total", "calls_total", "internet_traffic")
MEASURES = ("sms_in", "sms_out", "call_in", "call_out", "internet_traffic")
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name or expression}"


def each(template: str, names=FEATURES) -> str:
    return ", ".join(template.format(f=f, i=i) for i, f in enumerate(names))


# --- stages -----------------------------------------------------------------------------------

EVENTS_INGESTED = """SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, user_id AS cell_id,
    CASE WHEN event_type = 'signup' THEN value END AS sms_in,
    CASE WHEN event_type = 'purchase' THEN value END AS sms_out,
    CASE WHEN event_type = 'error' THEN value END AS call_in,
    CASE WHEN event_type = 'view' THEN value END AS call_out,
    CASE WHEN event_type = 'click' THEN value END AS internet_traffic
  FROM events"""
ORDERS_INGESTED = """SELECT l_shipdate::TIMESTAMP AS timestamp, l_suppkey AS cell_id, l_quantity AS sms_in,
    l_tax AS sms_out, l_linenumber::DOUBLE AS call_in, l_discount AS call_out, l_extendedprice AS internet_traffic
  FROM lineitem"""
SUMS = f"SELECT cell_id, timestamp, {each('coalesce(sum({f}), 0.0::DOUBLE) AS {f}', MEASURES)} FROM ingested GROUP BY ALL"
TRAFFIC = """SELECT cell_id, timestamp, sms_in + sms_out AS sms_total, call_in + call_out AS calls_total,
    internet_traffic FROM sums"""
LABEL = "isoyear({t})::VARCHAR || '_W' || lpad(week({t})::VARCHAR, 2, '0')"
WEEKLY = f"""SELECT cell_id, {LABEL.format(t='timestamp')} AS year_week, {each('sum({f}) AS {f}')}
  FROM traffic GROUP BY ALL"""
MEDIANS = f"SELECT *, {each('median({f}) OVER (PARTITION BY cell_id) AS {f}_median')} FROM weekly"
DEVS = f"SELECT *, {each('abs({f} - {f}_median) AS {f}_abs_dev')} FROM medians"
MADS = f"SELECT *, {each('median({f}_abs_dev) OVER (PARTITION BY cell_id) AS {f}_mad')} FROM devs"
RATIOS = f"SELECT *, {each('{f}_abs_dev / ({f}_mad + 1e-8) AS {f}_norm_dev')} FROM mads"


def normal(threshold: float) -> str:
    within = " AND ".join(f"{f}_norm_dev <= {threshold}" for f in FEATURES)
    return f"""SELECT cell_id, year_week, {' + '.join(f'{f}_norm_dev' for f in FEATURES)} AS stability_score
      FROM ratios WHERE {within}"""


def refs(n: int) -> str:
    return f"""SELECT cell_id, year_week AS reference_week, stability_score FROM normal QUALIFY
      row_number() OVER (PARTITION BY cell_id ORDER BY round(stability_score, 9), year_week) <= {n}"""


TRAIN = f"""SELECT t.* FROM traffic t WHERE EXISTS (SELECT 1 FROM refs w WHERE w.cell_id = t.cell_id
    AND w.reference_week = {LABEL.format(t='t.timestamp')})"""
MOMENTS = f"""SELECT cell_id, count(*) AS n_train, {each('avg({f}) AS a{i}')}, {each('stddev_pop({f}) AS s{i}')},
    covar_pop(sms_total, calls_total) AS c01, covar_pop(sms_total, internet_traffic) AS c02,
    covar_pop(calls_total, internet_traffic) AS c12 FROM train GROUP BY cell_id"""


def scaled(standardize: bool) -> str:
    """Mean, scale and second moments of the rows as the model sees them."""
    def co(i, j):
        return f"s{i} * s{i}" if i == j else f"c{i}{j}"
    if standardize:
        head = each("a{i} AS mean{i}, CASE WHEN s{i} <= greatest(1e-12, n_train * abs(a{i}) * 2.0::DOUBLE ** -52) "
                    "THEN 1.0::DOUBLE ELSE s{i} END AS scale{i}")
        cells = [f"({co(i, j)}) / (scale{i} * scale{j}) AS m{i}{j}" for i, j in PAIRS]
    else:
        head = each("0.0::DOUBLE AS mean{i}, 1.0::DOUBLE AS scale{i}")
        cells = [f"({co(i, j)}) + a{i} * a{j} AS m{i}{j}" for i, j in PAIRS]
    return f"SELECT *, {', '.join(cells)} FROM (SELECT *, {head} FROM moments)"


# One rotation zeroes the entry between the first two axes, then the axes change places in a ring.
JACOBI = """SELECT cell_id, 0 AS step, m00 AS p, m11 AS q, m22 AS s, m01 AS pq, m02 AS ps, m12 AS qs,
    1.0::DOUBLE AS u0, 0.0::DOUBLE AS u1, 0.0::DOUBLE AS u2, 0.0::DOUBLE AS v0, 1.0::DOUBLE AS v1, 0.0::DOUBLE AS v2,
    0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 1.0::DOUBLE AS w2 FROM scaled
  UNION ALL
  SELECT cell_id, step + 1, q + t * pq, s, p - t * pq, sn * ps + c * qs, 0.0::DOUBLE, c * ps - sn * qs,
    sn * u0 + c * v0, sn * u1 + c * v1, sn * u2 + c * v2, w0, w1, w2, c * u0 - sn * v0, c * u1 - sn * v1, c * u2 - sn * v2
  FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS sn FROM (SELECT *,
      CASE WHEN abs(pq) < 1e-150 THEN 0.0::DOUBLE ELSE
        (CASE WHEN q >= p THEN 1 ELSE -1 END) / (abs((q - p) / (2 * pq)) + sqrt(((q - p) / (2 * pq)) ** 2 + 1))
        * (CASE WHEN pq >= 0 THEN 1 ELSE -1 END) END AS t
    FROM jacobi WHERE step < 30))"""
EIGEN = """SELECT cell_id, p AS l, u0 AS x0, u1 AS x1, u2 AS x2 FROM jacobi WHERE step = 30
  UNION ALL SELECT cell_id, q, v0, v1, v2 FROM jacobi WHERE step = 30
  UNION ALL SELECT cell_id, s, w0, w1, w2 FROM jacobi WHERE step = 30"""


def axes(k: int) -> str:
    """Kept: the first k eigenvalues above round-off."""
    maps = ", ".join(f"sum(CASE WHEN kept THEN 0.0 ELSE x{i} * x{j} END) AS r{i}{j}" for i, j in PAIRS)
    return f"""SELECT cell_id, count(*) FILTER (kept) AS rank, max(l) FILTER (place = 1) AS l1,
        max(l) FILTER (place = 2) AS l2, max(l) FILTER (place = 3) AS l3, {maps}
      FROM (SELECT *, l > 1e-9 AND place <= {min(k, 3)} AS kept
        FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY l DESC) AS place FROM eigen)) GROUP BY cell_id"""


def residual(rows: str) -> str:
    """Rows of modelled cells with the length of their unexplained part."""
    z = each("(t.{f} - m.mean{i}) / m.scale{i} AS z{i}")
    parts = " + ".join(
        "(" + " + ".join(f"m_r{min(i, j)}{max(i, j)} * z{j}" for j in range(3)) + ") ** 2" for i in range(3)
    )
    maps = ", ".join(f"x.r{i}{j} AS m_r{i}{j}" for i, j in PAIRS)
    return f"""SELECT *, CASE WHEN e <= 1e-6 THEN 0.0::DOUBLE ELSE e END AS score FROM (SELECT *, sqrt({parts}) AS e FROM (
        SELECT t.*, {z}, {maps} FROM {rows} t JOIN scaled m ON t.cell_id = m.cell_id JOIN axes x ON t.cell_id = x.cell_id))"""


def errors(t: float) -> str:
    return f"""SELECT *, mean_error + {t}::DOUBLE * std_error AS threshold FROM (SELECT cell_id, avg(score) AS mean_error,
        CASE WHEN stddev_pop(score) <= 1e-6 THEN 0.0::DOUBLE ELSE stddev_pop(score) END AS std_error
      FROM fitted GROUP BY cell_id)"""


SCORED = "SELECT s.*, e.mean_error, e.std_error, e.threshold FROM rescored s JOIN errors e ON s.cell_id = e.cell_id"
ANOMALIES = f"""SELECT cell_id, timestamp, score AS anomaly_score, {', '.join(FEATURES)},
    CASE WHEN std_error <> 0 THEN (score - mean_error) / std_error ELSE score - mean_error END AS severity_score
  FROM scored WHERE score > threshold + CASE WHEN std_error = 0 THEN 1e-6 ELSE 0 END"""
ANOMALY_COLUMNS = ", ".join(
    ["cell_id", "timestamp", r("anomaly_score"), *[r(f) for f in FEATURES], r("severity_score", digits=3)]
)
LOG_COLUMNS = ", ".join(
    ["cell_id", "timestamp", r("anomaly_score"), *[r(f) for f in FEATURES], r("ln(severity_score)", "log_severity", 4)]
)
STATS = f"""SELECT *, anomaly_count * avg_severity AS weighted_severity,
    0.5::DOUBLE * anomaly_count * avg_severity + 0.3::DOUBLE * max_severity + 0.2::DOUBLE * anomaly_count AS severity_impact,
    extreme_anomaly_count > 0 AS has_extreme_anomalies
  FROM (SELECT cell_id, count(*) AS anomaly_count, avg(severity_score) AS avg_severity, max(severity_score) AS max_severity,
      stddev_samp(severity_score) AS severity_std, {each('avg({f}) AS {f}_mean')},
      count(*) FILTER (severity_score >= (SELECT quantile_cont(severity_score, 0.99) FROM anomalies)) AS extreme_anomaly_count
    FROM anomalies GROUP BY cell_id)"""
STAT_COLUMNS = (
    "anomaly_count", "avg_severity", "max_severity", "severity_std", *[f"{f}_mean" for f in FEATURES],
    "weighted_severity", "severity_impact", "has_extreme_anomalies", "extreme_anomaly_count",
)
COUNTED = ("anomaly_count", "extreme_anomaly_count")


def stat_list(prefix: str = "", zero: bool = False, digits: int = 6) -> str:
    out = []
    for c in STAT_COLUMNS:
        e = f"{prefix}{c}"
        if c == "has_extreme_anomalies":
            out.append(f"coalesce({e}, false) AS {c}" if zero else f"{e} AS {c}")
        elif c in COUNTED:
            out.append(f"coalesce({e}, 0)::BIGINT AS {c}" if zero else f"{e}::BIGINT AS {c}")
        else:
            out.append(r(f"coalesce({e}, 0.0::DOUBLE)" if zero else e, c, digits))
    return ", ".join(out)


FULL = f"""SELECT coalesce(s.cell_id, c_custkey) AS cell_id, {', '.join(
    f"coalesce(s.{c}, {'false' if c == 'has_extreme_anomalies' else '0'}) AS {c}" for c in STAT_COLUMNS)}
  FROM stats s FULL JOIN customer ON s.cell_id = c_custkey"""


def cuts(source: str, column: str, probs, where: str = "true") -> str:
    return "SELECT " + ", ".join(f"quantile_cont({column}, {q}) AS p{i}" for i, q in enumerate(probs)) + f" FROM {source} WHERE {where}"


CUTS_COUNT = cuts("full_stats", "anomaly_count", (0.25, 0.5, 0.75, 0.9), "anomaly_count <> 0")
CLASSIFIED = """SELECT f.*, CASE WHEN anomaly_count = 0 THEN 'No Anomalies' WHEN anomaly_count <= p0 THEN 'Low Activity'
    WHEN anomaly_count <= p1 THEN 'Moderate Activity' WHEN anomaly_count <= p2 THEN 'High Activity'
    WHEN anomaly_count <= p3 THEN 'Very High Activity' ELSE 'Extreme Activity' END AS category
  FROM full_stats f, cuts_count"""
CUTS_EXTREME = cuts("stats", "extreme_anomaly_count", (0.25, 0.5, 0.75), "has_extreme_anomalies")
EXTREMES = """SELECT s.*, CASE WHEN extreme_anomaly_count <= p0 THEN 'Low Extreme' WHEN extreme_anomaly_count <= p1 THEN 'Moderate Extreme'
    WHEN extreme_anomaly_count <= p2 THEN 'High Extreme' ELSE 'Critical Extreme' END AS category
  FROM stats s, cuts_extreme WHERE has_extreme_anomalies"""
EVENT_ANOMALIES = """SELECT user_id AS cell_id, ts AS timestamp, value / 10 AS anomaly_score,
    CASE WHEN event_type IN ('signup', 'purchase') THEN value ELSE 0.0 END AS sms_total,
    CASE WHEN event_type IN ('error', 'view') THEN value ELSE 0.0 END AS calls_total,
    CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS internet_traffic, value AS severity_score FROM events"""


def quintiles(source: str, column: str) -> str:
    return f"""SELECT f.*, CASE WHEN {column} <= p0 THEN 'Very Low' WHEN {column} <= p1 THEN 'Low' WHEN {column} <= p2 THEN 'Moderate'
        WHEN {column} <= p3 THEN 'High' ELSE 'Very High' END AS category FROM {source} f, ({cuts(source, column, (0.2, 0.4, 0.6, 0.8))})"""


TIMELINE = """SELECT *, hour(timestamp) AS hour, timestamp::DATE AS date, dayname(timestamp) AS day_of_week, week(timestamp) AS week
  FROM anomalies WHERE cell_id = (SELECT cell_id FROM anomalies GROUP BY cell_id ORDER BY count(*) DESC, cell_id LIMIT 1)"""


def chain(
    last: str, select: str, source: str = EVENTS_INGESTED, k: int = 2, t: float = 2.0, standardize: bool = True,
    weeks: int = 4, mad: float = 1.5, anomalies: str | None = None, extra: dict[str, str] | None = None,
) -> str:
    """``select`` over all stages up to ``last``."""
    stages = {
        "ingested": source, "sums": SUMS, "traffic": TRAFFIC, "weekly": WEEKLY, "medians": MEDIANS, "devs": DEVS,
        "mads": MADS, "ratios": RATIOS, "normal": normal(mad), "refs": refs(weeks), "train": TRAIN,
        "moments": MOMENTS, "scaled": scaled(standardize), "jacobi": JACOBI, "eigen": EIGEN, "axes": axes(k),
        "fitted": residual("train"), "errors": errors(t), "rescored": residual("traffic"), "scored": SCORED,
        "anomalies": ANOMALIES, "stats": STATS, "full_stats": FULL, "cuts_count": CUTS_COUNT, "classified": CLASSIFIED,
        "cuts_extreme": CUTS_EXTREME, "extremes": EXTREMES,
    }
    names = list(stages)
    names = names[: names.index(last) + 1]
    if anomalies:
        stages["anomalies"] = anomalies
        names = names[names.index("anomalies"):]
    chosen = {n: stages[n] for n in names} | (extra or {})
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in chosen.items()) + "\n" + select


def over_events(select: str, last: str = "anomalies", **extra: str) -> str:
    """``select`` over events read as anomaly records."""
    return chain(last, select, anomalies=EVENT_ANOMALIES, extra=extra)


def even(x: str, digits: int = 2) -> str:
    return f"round_even(round({x}, 9) * {10 ** digits}::DOUBLE, 0) / {10 ** digits}::DOUBLE"


def text(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {even(x, digits)})"


def sigma(x: str) -> str:
    return f"{text(x, 2)} || 'σ'"


def numbered(section: str, base: int, pairs: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {base + i} AS position, '{section}' AS section, '{key}' AS key, ({value})::VARCHAR AS value FROM {source}"
        for i, (key, value) in enumerate(pairs.items(), 1)
    )


def listed(section: str, base: int, key: str, value: str, order: str, source: str) -> str:
    return f"""SELECT {base} + row_number() OVER (ORDER BY {order}) AS position, '{section}' AS section,
        ({key})::VARCHAR AS key, ({value})::VARCHAR AS value FROM {source}"""


def grouped(x: str) -> str:
    return f"format('{{:,}}', ({x})::BIGINT)"


DESCRIBE = {
    "count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})::DOUBLE",
    "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)",
    "max": "max({c})::DOUBLE",
}


def describe(source: str, column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{name}' AS statistic, ({e.format(c=column)})::DOUBLE AS value FROM {source}"
        for i, (name, e) in enumerate(DESCRIBE.items())
    )


def range_row(column: str, low: float | None, high: float | None) -> str:
    bad = " OR ".join([f"{column} < {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None))
    return f"""SELECT '{column}' AS "column", {r(f'min({column})::DOUBLE', 'min_value')}, {r(f'max({column})::DOUBLE', 'max_value')},
        count(*) FILTER ({bad}) AS violations FROM anomalies"""


def bin_of(x: str, bins: int) -> str:
    """0-based bin, checked against the bin's own edges."""
    return f"""(SELECT CASE WHEN {x} < lo + raw * step THEN raw - 1
        WHEN {x} >= lo + (raw + 1) * step AND raw < {bins - 1} THEN raw + 1 ELSE raw END
        FROM (SELECT least(floor(({x} - lo) * ({bins} / (hi - lo)))::BIGINT, {bins - 1}) AS raw))"""


def histogram(source: str, column: str, density: bool, bins: int = 50) -> str:
    shown = f", {r('coalesce(n, 0) / (total * step)', 'density')}" if density else ""
    return f"""SELECT b AS bin, {r('lo + b * step', 'bin_start')}, {r('lo + (b + 1) * step', 'bin_end')}, coalesce(n, 0) AS n{shown}
      FROM (SELECT unnest(range({bins})) AS b) CROSS JOIN bounds LEFT JOIN (
        SELECT {bin_of('x', bins)} AS bin, count(*) AS n FROM (SELECT {column} AS x FROM {source}) CROSS JOIN bounds GROUP BY 1) h ON h.bin = b"""


def bounds(source: str, column: str, bins: int = 50) -> str:
    return f"""SELECT lo, hi, total, (hi - lo) / {bins} AS step FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi,
        count({column}) AS total FROM {source})"""


GRID = """SELECT c_custkey AS cell_id, 9.0::DOUBLE + (c_custkey % 100) * 0.01::DOUBLE AS west,
    45.0::DOUBLE + floor(c_custkey / 100) * 0.01::DOUBLE AS south FROM customer"""
LON = "(west + (west + 0.01::DOUBLE) + (west + 0.01::DOUBLE) + west + west) / 5"
LAT = "(south + south + (south + 0.01::DOUBLE) + (south + 0.01::DOUBLE) + south) / 5"
# Class names and colours; those of classes, labels and report lines in the texts below are fixed too.
COUNT_COLOURS = {
    "No Anomalies": "#2E8B57", "Low Activity": "#90EE90", "Moderate Activity": "#FFD700", "High Activity": "#FF8C00",
    "Very High Activity": "#FF4500", "Extreme Activity": "#8B0000",
}
EXTREME_COLOURS = {
    "Low Extreme": "#FFA500", "Moderate Extreme": "#FF6347", "High Extreme": "#DC143C", "Critical Extreme": "#8B0000",
}


def colour(table: dict[str, str], default: str) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def label(lines: dict[str, str]) -> str:
    return " || chr(10) || ".join(f"'{k}: ' || {v}" for k, v in lines.items())


TRAFFIC_LINES = {
    "Weighted Severity": text("weighted_severity", 1), "Severity Impact": text("severity_impact", 1),
    "Avg SMS": text("sms_total_mean", 1), "Avg Calls": text("calls_total_mean", 1),
    "Avg Internet": text("internet_traffic_mean", 1),
}
CELL_LABEL = label({
    "Cell ID": "cell_id", "Category": "category", "Anomaly Count": "anomaly_count::BIGINT",
    "Avg Severity": sigma("avg_severity"), "Max Severity": sigma("max_severity"),
    "P99+ Extreme Anomalies":
        "CASE WHEN has_extreme_anomalies THEN '🔥 YES' ELSE 'No' END || ' (' || extreme_anomaly_count::BIGINT || ')'",
    **TRAFFIC_LINES,
})
EXTREME_LABEL = label({
    "Cell ID": "g.cell_id", "Extreme Category": "category", "P99+ Extreme Anomalies": "extreme_anomaly_count",
    "Total Anomalies": "anomaly_count", "Max Severity": sigma("max_severity"), "Avg Severity": sigma("avg_severity"),
    **TRAFFIC_LINES,
})
WEEK = "VALUES (0, 'Monday', 'Mon'), (1, 'Tuesday', 'Tue'), (2, 'Wednesday', 'Wed'), (3, 'Thursday', 'Thu'), " \
    "(4, 'Friday', 'Fri'), (5, 'Saturday', 'Sat'), (6, 'Sunday', 'Sun')"
SEVERITY_ROW = ", ".join([
    "count(*) AS total_anomalies", "min(timestamp) AS first_seen", "max(timestamp) AS last_seen",
    "count(DISTINCT date) AS days_active", r("min(severity_score)", "min_severity"), r("max(severity_score)", "max_severity"),
    r("avg(severity_score)", "mean_severity"), r("stddev_samp(severity_score)", "std_severity"),
    *[r(f"avg({f})", f"avg_{f}") for f in FEATURES], *[r(f"max({f})", f"max_{f}") for f in FEATURES],
    r("count(*)::DOUBLE / count(DISTINCT date)", "anomalies_per_day"), r("quantile_cont(severity_score, 0.5)", "median_severity"),
    r("quantile_cont(severity_score, 0.95)", "p95_severity"), r("quantile_cont(severity_score, 0.99)", "p99_severity"),
])
PEAKS = """SELECT (SELECT hour FROM timeline GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour,
    (SELECT day_of_week FROM timeline GROUP BY day_of_week, isodow(timestamp) ORDER BY count(*) DESC, isodow(timestamp) LIMIT 1) AS peak_day,
    (SELECT date FROM timeline GROUP BY date ORDER BY count(*) DESC, date LIMIT 1)::VARCHAR AS peak_date,
    (SELECT count(*) FROM timeline GROUP BY date ORDER BY 1 DESC LIMIT 1) AS max_daily_anomalies"""
TOP10 = "SELECT *, row_number() OVER (ORDER BY severity_score DESC, timestamp) AS rank FROM timeline ORDER BY severity_score DESC, timestamp LIMIT 10"
STAGES = (("ingested", True), ("traffic", True), ("refs", False), ("anomalies", True))
MODEL_COLUMNS = ", ".join([
    "m.cell_id", "n_train", "rank", *[r(f"l{i}", f"eigenvalue_{i}") for i in (1, 2, 3)],
    r("mean_error"), r("std_error"), r("threshold"),
])

ORACLE: dict[str, str] = {
    # --- ingest
    "ingest_parse": """SELECT date_trunc('milliseconds', ts)::TIMESTAMP AS timestamp, user_id AS cell_id,
        CASE WHEN event_type = 'signup' THEN value END AS sms_in, CASE WHEN event_type = 'purchase' THEN value END AS sms_out,
        NULL::DOUBLE AS call_in, CASE WHEN event_type = 'view' THEN value END AS call_out,
        CASE WHEN event_type = 'click' THEN value END AS internet_traffic FROM events WHERE event_type <> 'error' AND event_id % 11 NOT IN (3, 7)""",
    "ingest_losses": """SELECT count(*) AS records, count(*) FILTER (event_type = 'error') AS no_time,
        count(*) FILTER (event_type <> 'error' AND event_id % 11 IN (3, 7)) AS time_out_of_range, 0::BIGINT AS sms_in_non_finite,
        count(*) FILTER (event_type <> 'purchase') AS sms_out_non_finite, count(*) FILTER (event_type <> 'error') AS call_in_non_finite,
        0::BIGINT AS call_out_non_finite, 0::BIGINT AS internet_traffic_non_finite FROM events""",
    "csv_table": f"""SELECT user_id AS cell_id, date_trunc('second', ts)::TIMESTAMP AS timestamp, 1.5::DOUBLE AS anomaly_score,
        {', '.join(r('value', f) for f in FEATURES)}, NULL::DOUBLE AS severity_score FROM events""",
    "grid_parse": """SELECT c_custkey AS cell_id, 'Polygon' AS geometry_type, 5::BIGINT AS corners,
        round(9.0::DOUBLE + (c_custkey % 100) * 0.01::DOUBLE, 6) AS west, round(45.0::DOUBLE + floor(c_custkey / 100) * 0.01::DOUBLE, 6) AS south,
        round(9.0::DOUBLE + (c_custkey % 100) * 0.01::DOUBLE + 0.01::DOUBLE, 6) AS east,
        round(45.0::DOUBLE + floor(c_custkey / 100) * 0.01::DOUBLE + 0.01::DOUBLE, 6) AS north FROM customer""",
    "traffic_agg": chain("sums", f"SELECT cell_id, timestamp, {', '.join(r(m) for m in MEASURES)} FROM sums"),
    "merge_directions": chain("traffic", f"SELECT cell_id, timestamp, {', '.join(r(f) for f in FEATURES)} FROM traffic"),
    "orders_traffic": chain("traffic", f"SELECT cell_id, timestamp, {', '.join(r(f) for f in FEATURES)} FROM traffic", ORDERS_INGESTED),
    "all_null_sum": chain("ingested", "SELECT " + ", ".join(f"count(*) FILTER (n_{m} = 0) AS {m}" for m in MEASURES)
        + f" FROM (SELECT cell_id, timestamp, {each('count({f}) AS n_{f}', MEASURES)} FROM ingested GROUP BY ALL)"),
    "array_key_unwrap": f"SELECT user_id AS cell_id, count(value) AS n, {r('sum(value)', 'total')} FROM events GROUP BY user_id",
    "timestamp_parse": "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS timestamp FROM events",
    # --- quality
    "nearest_contract_findings": chain("traffic", """SELECT * FROM (VALUES ('unknown_schema', 'cell_id,timestamp,sms_total,internet_traffic', 'error', 1::BIGINT),
        ('missing_column', 'calls_total', 'error', 1::BIGINT)) AS v("check", subject, level, n)
        UNION ALL SELECT * FROM (SELECT 'range', 'cell_id', 'warning', count(*) FILTER (cell_id < 1 OR cell_id > 100000) AS n FROM traffic
        UNION ALL SELECT 'range', 'sms_total', 'warning', count(*) FILTER (sms_total < 0 OR sms_total > 50000) FROM traffic
        UNION ALL SELECT 'range', 'internet_traffic', 'warning', count(*) FILTER (internet_traffic < 0 OR internet_traffic > 1e12) FROM traffic) WHERE n > 0"""),
    "schema_findings": """SELECT *, (SELECT count(*)::INTEGER FROM lineitem) AS rows FROM (SELECT * FROM (VALUES ('missing_column', 'calls_total', 'error', 1::BIGINT),
        ('missing_column', 'internet_traffic', 'error', 1::BIGINT), ('extra_column', 'l_discount', 'info', 1::BIGINT),
        ('type_mismatch', 'timestamp', 'warning', 1::BIGINT)) AS v("check", subject, level, n)
        UNION ALL SELECT * FROM (SELECT 'range', 'cell_id', 'warning', count(*) FILTER (l_suppkey < 1 OR l_suppkey > 100000) AS n FROM lineitem
        UNION ALL SELECT 'range', 'sms_total', 'warning', count(*) FILTER (l_quantity < 0 OR l_quantity > 50000) FROM lineitem) WHERE n > 0)""",
    "anomalies_from_csv": f"""SELECT cell_id, timestamp, {', '.join(r(f) for f in ('anomaly_score', *FEATURES, 'severity_score'))} FROM ({EVENT_ANOMALIES})""",
    "non_finite_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, {nulls} AS nulls, {odd} AS non_finite FROM events""" for c, nulls, odd in (
            ("cell_id", "count(*) FILTER (user_id IS NULL)", "0::BIGINT"), ("timestamp", "count(*) FILTER (ts IS NULL)", "0::BIGINT"),
            ("severity_score", "count(*) FILTER (value IS NULL AND event_id % 13 NOT IN (1, 2, 3))", "count(*) FILTER (event_id % 13 IN (1, 2, 3))"),
            *((f, "count(*) FILTER (value IS NULL)", "0::BIGINT") for f in FEATURES))),
    "sum_reconciliation": chain("traffic", " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(coalesce(sum(coalesce({a}, 0) + coalesce({b}, 0)), 0), 4) AS before, (SELECT round(sum({f}), 4) FROM traffic) AS after FROM ingested"
        for f, a, b in (("sms_total", "sms_in", "sms_out"), ("calls_total", "call_in", "call_out"), ("internet_traffic", "internet_traffic", "0.0::DOUBLE")))),
    "severity_recheck": chain("anomalies", """SELECT count(*) AS both, 0::BIGINT AS only_stored, 0::BIGINT AS only_again, 0::BIGINT AS different FROM anomalies"""),
    "stability_recheck": chain("refs", """SELECT count(*) AS both, 0::BIGINT AS only_stored, 0::BIGINT AS only_again, 0::BIGINT AS different FROM refs"""),
    "detection_losses": chain("refs", f"""SELECT * FROM (SELECT t.cell_id, count(*) AS rows,
          count(*) FILTER (day(t.timestamp) = 1 AND t.cell_id % 5 IN (1, 2)) AS rows_skipped,
          CASE WHEN NOT bool_or(w.cell_id IS NOT NULL) THEN 'no reference week'
            WHEN NOT bool_or(coalesce(v.cell_id IS NOT NULL AND NOT (day(t.timestamp) = 1 AND t.cell_id % 5 IN (1, 2)), FALSE)) THEN 'no training row' ELSE '' END AS not_modelled
        FROM traffic t LEFT JOIN (SELECT DISTINCT cell_id FROM refs) w ON w.cell_id = t.cell_id
          LEFT JOIN refs v ON v.cell_id = t.cell_id AND v.reference_week = {LABEL.format(t='t.timestamp')}
        GROUP BY t.cell_id) WHERE rows_skipped > 0 OR not_modelled <> ''"""),
    "dup_keys_unordered": "SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "dup_keys": chain("ingested", "SELECT cell_id, timestamp, count(*) AS n FROM ingested GROUP BY ALL HAVING count(*) > 1"),
    "null_counts": chain("ingested", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
            {r(f'count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE', 'null_share')} FROM ingested"""
        for c in ("timestamp", "cell_id", *MEASURES))),
    "range_checks": chain("anomalies", " UNION ALL ".join([
        range_row("cell_id", 1, 100000), range_row("sms_total", 0, 50000), range_row("calls_total", 0, 20000),
        range_row("internet_traffic", 0, 1e12), range_row("anomaly_score", 0, None), range_row("severity_score", 2, None)])),
    "negative_counts": """SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal < 0) AS negatives FROM customer
        UNION ALL SELECT 'c_custkey', count(*) FILTER (c_custkey < 0) FROM customer""",
    "unknown_cells": chain("traffic", "SELECT DISTINCT cell_id FROM traffic WHERE cell_id NOT IN (SELECT s_suppkey FROM supplier)"),
    "grid_coverage": chain("traffic", f"""SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS grid_cells, count(DISTINCT cell_id) AS data_cells,
        count(DISTINCT c_custkey) AS covered_cells, {r('count(DISTINCT c_custkey) * 100.0 / (SELECT count(DISTINCT c_custkey) FROM customer)', 'coverage_percent')}
        FROM traffic LEFT JOIN customer ON cell_id = c_custkey"""),
    "stage_consistency": chain("anomalies", " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS position, '{'reference_weeks' if n == 'refs' else n}' AS stage, count(*) AS rows, count(DISTINCT cell_id) AS cells,
            {'min(timestamp)' if timed else 'NULL::TIMESTAMP'} AS first_time, {'max(timestamp)' if timed else 'NULL::TIMESTAMP'} AS last_time,
            count(DISTINCT cell_id) = (SELECT count(DISTINCT cell_id) FROM ingested) AS same_cells, {
            'min(timestamp) >= (SELECT min(timestamp) FROM ingested) AND max(timestamp) <= (SELECT max(timestamp) FROM ingested)'
            if timed else 'true'} AS time_within FROM {n}"""
        for i, (n, timed) in enumerate(STAGES))),
    "severity_bands": chain("anomalies", """SELECT count(*) AS anomalies, count(*) FILTER (severity_score > 10) AS severe,
        count(*) FILTER (severity_score > 100) AS extreme FROM anomalies"""),
    "week_format": chain("refs", r"""SELECT count(*) AS labels,
        count(*) FILTER (NOT regexp_full_match(reference_week, '\d{4}_W\d{2}')) AS malformed FROM refs"""),
    "validate_stages": chain("refs", """SELECT * FROM (
        SELECT 'traffic' AS stage, 'range' AS "check", 'cell_id' AS subject, 'warning' AS level, count(*) FILTER (cell_id < 1 OR cell_id > 100000) AS n FROM traffic
        UNION ALL SELECT 'reference_weeks', 'range', 'cell_id', 'warning', count(*) FILTER (cell_id < 1 OR cell_id > 100000) FROM refs
        UNION ALL SELECT 'reference_weeks', 'extra_column', 'stability_score', 'info', 1
        UNION ALL SELECT 'reference_weeks', 'cells_without_weeks', 'cell_id', 'warning', count(DISTINCT cell_id) FROM traffic
          WHERE cell_id NOT IN (SELECT cell_id FROM refs)
        ) WHERE n > 0"""),
    "validate_traffic": chain("traffic", """SELECT * FROM (
        SELECT 'range' AS "check", 'cell_id' AS subject, 'warning' AS level, count(*) FILTER (cell_id < 1 OR cell_id > 100000) AS n FROM traffic
        UNION ALL SELECT 'range', 'sms_total', 'warning', count(*) FILTER (sms_total < 0 OR sms_total > 50000) FROM traffic
        UNION ALL SELECT 'range', 'calls_total', 'warning', count(*) FILTER (calls_total < 0 OR calls_total > 20000) FROM traffic
        UNION ALL SELECT 'range', 'internet_traffic', 'warning', count(*) FILTER (internet_traffic < 0 OR internet_traffic > 1e12) FROM traffic
        UNION ALL SELECT 'unknown_cells', 'cell_id', 'error', count(DISTINCT cell_id) FILTER (cell_id NOT IN (SELECT s_suppkey FROM supplier)) FROM traffic
        ) WHERE n > 0"""),
    # --- weeks
    "iso_week_keys": f"""SELECT day, isoyear(day) AS iso_year, week(day) AS iso_week, {LABEL.format(t='day')} AS label,
        isoyear(day) * 100 + week(day) AS week_number FROM (SELECT DISTINCT l_shipdate::TIMESTAMP AS day FROM lineitem)""",
    "week_label_roundtrip": f"""SELECT label, replace(label, '_W', '')::BIGINT AS week_number
        FROM (SELECT DISTINCT {LABEL.format(t='l_shipdate')} AS label FROM lineitem)""",
    "weekly_totals": chain("weekly", f"SELECT cell_id, year_week, {', '.join(r(f) for f in FEATURES)} FROM weekly"),
    "orders_weekly_totals": chain("weekly", f"SELECT cell_id, year_week, {', '.join(r(f) for f in FEATURES)} FROM weekly", ORDERS_INGESTED),
    "weekly_median": chain("devs", "SELECT cell_id, year_week, "
        + ", ".join([r(f"{f}_median") for f in FEATURES] + [r(f"{f}_abs_dev") for f in FEATURES]) + " FROM devs"),
    "weekly_mad": chain("mads", f"SELECT DISTINCT cell_id, {', '.join(r(f'{f}_mad') for f in FEATURES)} FROM mads"),
    "norm_dev": chain("ratios", "SELECT cell_id, year_week, "
        + ", ".join(r(f"CASE WHEN {f}_norm_dev < 1e6 THEN {f}_norm_dev ELSE ln({f}_norm_dev) END", f"{f}_norm_dev") for f in FEATURES) + " FROM ratios"),
    "normal_weeks": chain("normal", f"SELECT cell_id, year_week, {r('stability_score')} FROM normal"),
    "reference_weeks": chain("refs", f"SELECT cell_id, reference_week, {r('stability_score')} FROM refs"),
    "reference_weeks_strict": chain("refs", f"SELECT cell_id, reference_week, {r('stability_score')} FROM refs", weeks=2, mad=0.75),
    "orders_reference_weeks": chain("refs", f"SELECT cell_id, reference_week, {r('stability_score')} FROM refs", ORDERS_INGESTED),
    "reference_week_distribution": chain("refs", f"""SELECT position, statistic, {r('value')} FROM (
        {describe('(SELECT count(*) AS n FROM refs GROUP BY cell_id)', 'n')})"""),
    # --- model
    "mark_reference": chain("train", """SELECT t.cell_id, t.timestamp, x.cell_id IS NOT NULL AS is_reference FROM traffic t
        LEFT JOIN train x ON x.cell_id = t.cell_id AND x.timestamp = t.timestamp"""),
    "training_rows": chain("train", f"SELECT cell_id, timestamp, {', '.join(r(f) for f in FEATURES)} FROM train"),
    "scaler_fit": chain("scaled", "SELECT cell_id, n_train, " + each("round(mean{i}, 6) AS {f}_mean, round(scale{i}, 6) AS {f}_scale") + " FROM scaled"),
    "standardised_rows": chain("scaled", "SELECT t.cell_id, t.timestamp, " + each("round(({f} - mean{i}) / scale{i}, 6) AS z_{f}")
        + " FROM traffic t JOIN scaled s ON s.cell_id = t.cell_id"),
    "moment_matrix": chain("scaled", f"SELECT cell_id, {', '.join(r(f'm{i}{j}') for i, j in PAIRS)} FROM scaled"),
    "osp_model": chain("errors", f"SELECT {MODEL_COLUMNS} FROM moments m JOIN axes x ON x.cell_id = m.cell_id JOIN errors e ON e.cell_id = m.cell_id"),
    "osp_residual_map": chain("axes", "SELECT x.cell_id, " + ", ".join(
        r(f"r{min(i, j)}{max(i, j)} / scale{j}", f"r{i}{j}") for i in range(3) for j in range(3))
        + " FROM axes x JOIN scaled s ON s.cell_id = x.cell_id", k=1),
    "osp_scores": chain("scored", f"SELECT cell_id, timestamp, {r('score', 'anomaly_score')}, {r('threshold')} FROM scored"),
    "orders_training_weekly": chain("train", f"SELECT cell_id, timestamp, {', '.join(r(f) for f in FEATURES)} FROM train", ORDERS_INGESTED),
    "osp_anomalies_k1": chain("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies", k=1),
    "osp_anomalies_k2": chain("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies", k=2),
    "osp_anomalies_k3": chain("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies", k=3),
    "osp_anomalies_t3": chain("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies", t=3.0),
    "osp_anomalies_unscaled": chain("anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies", k=1, standardize=False),
    "orders_osp_anomalies": chain("anomalies", f"SELECT {LOG_COLUMNS} FROM anomalies", ORDERS_INGESTED),
    "cells_without_weeks": chain("refs", "SELECT DISTINCT cell_id FROM traffic WHERE cell_id NOT IN (SELECT cell_id FROM refs)"),
    # --- summary
    "severity_describe": chain("anomalies", f"SELECT position, statistic, {r('value')} FROM ({describe('anomalies', 'severity_score')})"),
    "top_cells": chain("anomalies", "SELECT cell_id, count(*) AS n FROM anomalies GROUP BY cell_id ORDER BY n DESC, cell_id LIMIT 5"),
    "most_severe": chain("anomalies", f"""SELECT cell_id, timestamp, {r('severity_score')} FROM (
        SELECT * FROM anomalies ORDER BY severity_score DESC, cell_id, timestamp LIMIT 5)"""),
    "by_weekday": chain("anomalies", "SELECT dayname(timestamp) AS day_of_week, count(*) AS n FROM anomalies GROUP BY 1"),
    "by_hour": over_events("SELECT hour(timestamp) AS hour, count(*) AS n FROM anomalies GROUP BY 1"),
    "date_range": chain("anomalies", """SELECT min(timestamp)::DATE::VARCHAR AS first_date, max(timestamp)::DATE::VARCHAR AS last_date
        FROM anomalies"""),
    "distinct_cells": chain("anomalies", "SELECT count(DISTINCT cell_id) AS distinct_cell_id FROM anomalies"),
    "stage_yield": chain("anomalies", f"""SELECT position, stage, rows,
        {r('100.0 - rows * 100.0 / lag(rows) OVER (ORDER BY position)', 'reduction_percent')} FROM (
        SELECT 0::BIGINT AS position, 'ingested' AS stage, count(*)::DOUBLE AS rows FROM ingested
        UNION ALL SELECT 1, 'traffic', count(*) FROM traffic UNION ALL SELECT 2, 'anomalies', count(*) FROM anomalies)""")
        .replace("SELECT position, stage, rows,", "SELECT position, stage, rows::BIGINT AS rows,"),
    "anomaly_summary": over_events("SELECT * FROM (" + " UNION ALL ".join([
        numbered("overview", 0, {
            "Total Anomalies Detected": grouped("n"), "Unique Cells with Anomalies": grouped("cells"),
            "Date Range": "lo || ' to ' || hi"},
            "(SELECT count(*) AS n, count(DISTINCT cell_id) AS cells, min(timestamp)::DATE AS lo, max(timestamp)::DATE AS hi FROM anomalies)"),
        listed("severity_score", 100, "statistic", text("value", 2), "position", f"({describe('anomalies', 'severity_score')})"),
        listed("top_cells", 200, "cell_id", "n", "n DESC, cell_id",
            "(SELECT cell_id, count(*) AS n FROM anomalies GROUP BY cell_id ORDER BY n DESC, cell_id LIMIT 5)"),
        listed("day_of_week", 300, "d", "n", "n DESC, w",
            "(SELECT dayname(timestamp) AS d, isodow(timestamp) AS w, count(*) AS n FROM anomalies GROUP BY 1, 2)"),
        listed("hour", 400, "h", "n", "h", "(SELECT hour(timestamp) AS h, count(*) AS n FROM anomalies GROUP BY 1)"),
    ]) + ")"),
    # --- cells
    "cell_stats": chain("stats", f"SELECT cell_id, {stat_list()} FROM stats"),
    "event_cell_stats": over_events(f"SELECT cell_id, {stat_list(digits=8)} FROM stats", "stats"),
    "extreme_flags": chain("stats", "SELECT cell_id, has_extreme_anomalies, extreme_anomaly_count FROM stats"),
    "extreme_anomalies": chain("anomalies", f"""SELECT cell_id, timestamp, {r('severity_score')} FROM anomalies
        WHERE severity_score >= (SELECT quantile_cont(severity_score, 0.99) FROM anomalies)"""),
    "infinite_percentiles": """WITH v AS (SELECT CASE event_id % 13 WHEN 1 THEN NULL WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE value END AS x, event_id FROM events)
        SELECT count(*) FILTER (x IS NOT NULL OR event_id % 13 = 1) AS n, '-Infinity' AS p2, """ + ", ".join(
            f"round(quantile_cont(x, {q / 100}), 6)::VARCHAR AS p{q}" for q in (25, 50, 75)) + ", 'Infinity' AS p98 FROM v",
    "stats_without_nan": f"""SELECT user_id AS cell_id, count(x) AS anomaly_count, {r('avg(x)', 'avg_severity')}, {r('max(x)', 'max_severity')},
        count(*) FILTER (x >= 100) AS extreme_anomaly_count
        FROM (SELECT user_id, CASE WHEN event_id % 13 = 1 THEN NULL ELSE value END AS x FROM events WHERE event_id % 13 NOT IN (2, 3)) GROUP BY user_id""",
    "empty_anomalies": """SELECT c_custkey AS cell_id, 0::BIGINT AS anomaly_count, 0.0::DOUBLE AS max_severity, 'No Anomalies' AS category FROM customer""",
    "usable_metrics": chain("classified", f"""SELECT category, count(*) AS cells, 'anomaly_count' AS metric FROM classified GROUP BY category
        UNION ALL SELECT category, count(*), 'avg_severity' FROM ({quintiles('full_stats', 'avg_severity')}) GROUP BY category"""),
    "severity_percentiles": "SELECT count(value) AS n, "
        + ", ".join(r(f"quantile_cont(value, {q / 100})", f"p{q}") for q in (25, 50, 75, 90, 99)) + " FROM events",
    "missing_cells": chain("stats", "SELECT c_custkey AS cell_id FROM customer WHERE c_custkey NOT IN (SELECT cell_id FROM stats)"),
    "zero_rows": chain("full_stats", f"SELECT cell_id, {stat_list(zero=True)} FROM full_stats"),
    "zero_fill": chain("full_stats", f"SELECT cell_id, {stat_list(zero=True)} FROM full_stats"),
    "classify_count": chain("classified", "SELECT cell_id, anomaly_count::BIGINT AS anomaly_count, category FROM classified"),
    "classify_quintile": chain("full_stats", f"SELECT cell_id, {r('avg_severity')}, category FROM ({quintiles('full_stats', 'avg_severity')})"),
    "classify_impact": chain("stats", f"SELECT cell_id, {r('severity_impact')}, category FROM ({quintiles('stats', 'severity_impact')})"),
    "category_stats": chain("classified", f"""SELECT category, count(*) AS cells, sum(anomaly_count)::BIGINT AS anomalies,
        {even('avg(anomaly_count)')} AS mean_anomalies, {even('avg(avg_severity)')} AS mean_avg_severity,
        {even('max(max_severity)')} AS max_severity FROM classified GROUP BY category"""),
    "category_breakdown": chain("classified", f"""SELECT category, count(*) AS cells,
        {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified)', 'share')}, sum(anomaly_count)::BIGINT AS anomalies,
        {r('avg(anomaly_count)', 'anomalies_per_cell')}, {r('CASE WHEN sum(anomaly_count) > 0 THEN avg(avg_severity) END', 'mean_severity')}
        FROM classified GROUP BY category"""),
    "category_values": chain("classified", "SELECT DISTINCT category FROM classified"),
    "map_totals": chain("full_stats", f"""SELECT count(*) AS total_cells, count(*) FILTER (anomaly_count > 0) AS cells_with_anomalies,
        sum(anomaly_count)::BIGINT AS total_anomalies, count(*) FILTER (anomaly_count = 0) AS cells_without_anomalies,
        {r('sum(anomaly_count)::DOUBLE / count(*)', 'avg_anomalies_per_cell')} FROM full_stats"""),
    "extreme_classes": chain("extremes", "SELECT cell_id, extreme_anomaly_count, category FROM extremes"),
    "extreme_overview": chain("stats", f"""SELECT count(*) AS cells, count(*) FILTER (has_extreme_anomalies) AS extreme_cells,
        sum(extreme_anomaly_count)::BIGINT AS extreme_anomalies,
        {r('avg(extreme_anomaly_count) FILTER (has_extreme_anomalies)', 'extremes_per_cell')},
        {r('count(*) FILTER (has_extreme_anomalies) * 100.0::DOUBLE / count(*)', 'extreme_share')} FROM stats"""),
    "extreme_breakdown": chain("extremes", f"""SELECT category, count(*) AS cells, sum(extreme_anomaly_count)::BIGINT AS extreme_anomalies,
        {r('avg(extreme_anomaly_count)', 'extremes_per_cell')}, {r('max(max_severity)', 'max_severity')},
        {r('avg(avg_severity)', 'mean_severity')}, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM extremes)', 'share')}
        FROM extremes GROUP BY category"""),
    "classification_report": chain("classified", "SELECT * FROM (" + " UNION ALL ".join([
        numbered("overview", 0, {
            "Total cells": grouped("n"), "Cells with anomalies": grouped("w"), "Cells without anomalies": grouped("n - w"),
            "Total anomalies": grouped("a"), "Average anomalies per cell": text("a::DOUBLE / n", 1)},
            "(SELECT count(*) AS n, count(*) FILTER (anomaly_count > 0) AS w, sum(anomaly_count)::BIGINT AS a FROM classified)"),
        listed("category", 100, "category",
            f"'Cells ' || n || ' (' || {text('share', 1)} || '%), Total anomalies ' || {grouped('a')} || ', Avg anomalies per cell ' || {text('m', 1)}"
            f" || CASE WHEN a > 0 THEN ', Avg severity ' || {sigma('s')} ELSE '' END", "category",
            """(SELECT category, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified) AS share,
              sum(anomaly_count)::BIGINT AS a, avg(anomaly_count) AS m, avg(avg_severity) AS s FROM classified GROUP BY category)"""),
    ]) + ")"),
    "extreme_report": chain("extremes", "SELECT * FROM (" + " UNION ALL ".join([
        numbered("overview", 0, {
            "Total cells analyzed": grouped("n"),
            "Cells with extreme anomalies": f"{grouped('w')} || ' (' || {text('w * 100.0::DOUBLE / n', 1)} || '%)'",
            "Total extreme anomalies": grouped("a"), "Average extreme anomalies per extreme cell": text("a::DOUBLE / w", 1)},
            "(SELECT count(*) AS n, count(*) FILTER (has_extreme_anomalies) AS w, sum(extreme_anomaly_count)::BIGINT AS a FROM stats)"),
        listed("category", 100, "category",
            f"'Cells ' || n || ' (' || {text('share', 1)} || '%), Extreme anomalies ' || {grouped('a')} || ', Avg extreme per cell ' || {text('m', 1)}"
            f" || ', Max severity ' || {sigma('mx')} || ', Avg severity ' || {sigma('s')}", "category",
            """(SELECT category, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM extremes) AS share,
              sum(extreme_anomaly_count)::BIGINT AS a, avg(extreme_anomaly_count) AS m, max(max_severity) AS mx, avg(avg_severity) AS s
              FROM extremes GROUP BY category)"""),
    ]) + ")"),
    # --- geo
    "ring_centroids": f"SELECT cell_id, {r(LON, 'lon')}, {r(LAT, 'lat')} FROM ({GRID})",
    "centroid_points": chain("stats", f"""SELECT g.cell_id, {r(LON, 'lon')}, {r(LAT, 'lat')}, anomaly_count, {r('avg_severity')}
        FROM ({GRID}) g JOIN stats s ON s.cell_id = g.cell_id"""),
    "geo_join": chain("stats", f"""SELECT c_custkey AS cell_id, {stat_list('c.', zero=True)}, coalesce(category, 'Unknown') AS category
        FROM customer LEFT JOIN own_classes c ON c.cell_id = c_custkey""", extra={
            "own_cuts": CUTS_COUNT.replace("full_stats", "stats"),
            "own_classes": CLASSIFIED.replace("full_stats", "stats").replace("cuts_count", "own_cuts")}),
    "legend_counts": chain("classified", f"""SELECT position, l.category, count(c.cell_id) AS cells FROM (VALUES {', '.join(
        f"({i}::BIGINT, '{c}')" for i, c in enumerate(COUNT_COLOURS))}) l(position, category) LEFT JOIN classified c ON c.category = l.category GROUP BY ALL"""),
    "extreme_legend": chain("extremes", f"""SELECT position, l.category, count(c.cell_id) AS cells FROM (VALUES {', '.join(
        f"({i}::BIGINT, '{c}')" for i, c in enumerate(EXTREME_COLOURS))}) l(position, category) LEFT JOIN extremes c ON c.category = l.category GROUP BY ALL
        UNION ALL SELECT 4, 'No Extreme Anomalies', (SELECT count(*) FROM customer) - (SELECT count(*) FROM extremes)"""),
    "geo_features": chain("classified", f"""SELECT cell_id, category, {colour(COUNT_COLOURS, '#CCCCCC')} AS color, {CELL_LABEL} AS label,
        'Cell ' || cell_id || ': ' || category AS tooltip, 'Feature' AS feature_type, 'Polygon' AS geometry_type, cell_id AS feature_cell
        FROM classified WHERE cell_id IN (SELECT c_custkey FROM customer)"""),
    "extreme_geo_features": chain("extremes", f"""SELECT g.cell_id, category,
        CASE WHEN category IS NULL THEN '#E8E8E8' ELSE {colour(EXTREME_COLOURS, '#CCCCCC')} END AS color,
        {EXTREME_LABEL} AS label, CASE WHEN category IS NULL THEN 'Cell ' || g.cell_id || ': No extreme anomalies'
          ELSE 'Cell ' || g.cell_id || ': ' || category || ' (' || extreme_anomaly_count || ' extreme)' END AS tooltip,
        'Feature' AS feature_type, 'Polygon' AS geometry_type, g.cell_id AS feature_cell
        FROM (SELECT c_custkey AS cell_id FROM customer) g LEFT JOIN extremes e ON e.cell_id = g.cell_id"""),
    # --- timeline
    "most_extreme_cell": over_events("SELECT cell_id, count(*) AS n FROM anomalies GROUP BY cell_id ORDER BY n DESC, cell_id LIMIT 1"),
    "cell_timeline": over_events(f"""SELECT cell_id, timestamp, {r('severity_score')}, hour, date::VARCHAR AS date, day_of_week, week
        FROM timeline""", timeline=TIMELINE),
    "daily_stats": over_events(f"""SELECT date::VARCHAR AS date, count(*) AS n, {even('avg(severity_score)')} AS mean_severity,
        {even('max(severity_score)')} AS max_severity FROM timeline GROUP BY timeline.date""", timeline=TIMELINE),
    "hourly_stats": over_events(f"""SELECT hour, count(*) AS n, {even('avg(severity_score)')} AS mean_severity FROM timeline
        GROUP BY hour""", timeline=TIMELINE),
    "weekday_stats": chain("anomalies", f"""SELECT position::BIGINT AS position, d.day_of_week, label, n, mean_severity FROM ({WEEK}) d(position, day_of_week, label)
        LEFT JOIN (SELECT day_of_week, count(*) AS n, {even('avg(severity_score)')} AS mean_severity FROM timeline GROUP BY 1) s
        ON s.day_of_week = d.day_of_week""", extra={"timeline": TIMELINE}),
    "peak_hours": over_events("SELECT hour, count(*) AS n FROM timeline GROUP BY hour ORDER BY n DESC, hour LIMIT 3", timeline=TIMELINE),
    "temporal_peaks": over_events(PEAKS, timeline=TIMELINE),
    "cell_profile": over_events(f"SELECT {SEVERITY_ROW} FROM timeline", timeline=TIMELINE),
    "severity_guides": over_events(f"""SELECT {r('quantile_cont(severity_score, 0.95)', 'p95')}, {r('avg(severity_score)', 'mean')},
        {r('quantile_cont(severity_score, 0.5)', 'median')} FROM timeline""", timeline=TIMELINE),
    "traffic_stack": chain("anomalies", f"""SELECT timestamp, {r('severity_score')}, {r('sms_total', 'sms_edge')},
        {r('sms_total + calls_total', 'calls_edge')} FROM timeline""", extra={"timeline": TIMELINE}),
    "top10_severe": over_events(f"SELECT timestamp, {r('severity_score')}, {', '.join(r(f) for f in FEATURES)}, rank FROM ({TOP10})",
        timeline=TIMELINE),
    "short_days": over_events("SELECT left(day_of_week, 3) AS label, count(*) AS n FROM timeline GROUP BY 1", timeline=TIMELINE),
    "cell_report": chain("anomalies", "SELECT * FROM (" + " UNION ALL ".join([
        numbered("overview", 0, {
            "Cell ID": "cell", "Total anomalies": grouped("n"),
            "Date range": "strftime(lo, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(hi, '%Y-%m-%d %H:%M:%S')", "Days active": "days",
            "Average anomalies per day": text("n::DOUBLE / days", 1)}, "profile"),
        numbered("severity", 100, {
            "Minimum severity": sigma("mn"), "Maximum severity": sigma("mx"), "Average severity": sigma("av"),
            "Median severity": sigma("md"), "Standard deviation": sigma("sd"), "95th percentile": sigma("p95"),
            "99th percentile": sigma("p99")}, "profile"),
        numbered("temporal", 200, {
            "Peak hour": "peak_hour || ':00'", "Peak day of week": "peak_day", "Most active date": "peak_date",
            "Max anomalies in single day": "max_daily_anomalies"}, f"({PEAKS})"),
        numbered("traffic", 300, {
            "Average SMS": text("a0", 1), "Average Calls": text("a1", 1), "Average Internet": text("a2", 1),
            "Maximum SMS": text("m0", 1), "Maximum Calls": text("m1", 1), "Maximum Internet": text("m2", 1)}, "profile"),
        listed("top_10", 400, "rank",
            f"strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ': ' || {sigma('severity_score')} || ' (SMS:' || {text('sms_total', 1)}"
            f" || ', Calls:' || {text('calls_total', 1)} || ', Internet:' || {text('internet_traffic', 1)} || ')'", "rank", f"({TOP10})"),
    ]) + ")", extra={"timeline": TIMELINE, "profile": f"""SELECT max(cell_id) AS cell, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi,
        count(DISTINCT date) AS days, min(severity_score) AS mn, max(severity_score) AS mx, avg(severity_score) AS av,
        quantile_cont(severity_score, 0.5) AS md, stddev_samp(severity_score) AS sd, quantile_cont(severity_score, 0.95) AS p95,
        quantile_cont(severity_score, 0.99) AS p99, {each('avg({f}) AS a{i}, max({f}) AS m{i}')} FROM timeline"""}),
    # --- distribution
    "hist_counts": chain("anomalies", histogram("anomalies", "severity_score", False), extra={"bounds": bounds("anomalies", "severity_score")}),
    "hist_density": f"WITH bounds AS ({bounds('events', 'value')}) {histogram('events', 'value', True)}",
    "kde_curve": f"""WITH k AS (SELECT lo, hi, n, bw, bw / 10 AS w, (hi - lo) / 199 AS step FROM (
            SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * count(value) ** (-0.2::DOUBLE) AS bw FROM events)),
        binned AS (SELECT floor((value - lo) / w) AS slot, count(*) AS m, avg(value) AS mid FROM events CROSS JOIN k GROUP BY 1)
        SELECT point, {r('lo + point * step', 'x')}, {r('sum(m * exp(-0.5::DOUBLE * ((lo + point * step - mid) / bw) ** 2)) / (n * bw * sqrt(2 * pi()))', 'density')}
        FROM binned CROSS JOIN k CROSS JOIN (SELECT unnest(range(200)) AS point) GROUP BY point, lo, step, n, bw""",
}
for _same, _as in (("osp_anomalies_salted", "osp_anomalies_k2"), ("osp_anomalies_weekly", "osp_anomalies_k2"), ("dup_keys_clustered", "dup_keys"), ("grid_files", "grid_parse"), ("osp_model_merged", "osp_model"), ("osp_scores_bucketed", "osp_scores"), ("ingest_fields", "ingest_parse"), ("osp_score_stored_model", "osp_scores")):
    ORACLE[_same] = ORACLE[_as]
