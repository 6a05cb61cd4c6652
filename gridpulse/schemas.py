"""Column contracts of the stage tables and the value ranges checked on them."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "cell_id"
TIME = "timestamp"
# The folder column of a panel that is written by week; holds a `week_index`.
WEEK = "week"
MEASURES = ("sms_in", "sms_out", "call_in", "call_out", "internet_traffic")
FEATURES = ("sms_total", "calls_total", "internet_traffic")


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_LONG, _INT, _DOUBLE, _TEXT, _TS, _BOOL = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType(), T.BooleanType(),
)

RAW = _struct(
    (KEY, _LONG), ("timestamp_ms", _LONG), ("country_code", _INT), *((m, _DOUBLE) for m in MEASURES)
)
INGESTED = _struct((TIME, _TS), (KEY, _LONG), *((m, _DOUBLE) for m in MEASURES))
TRAFFIC = _struct((KEY, _LONG), (TIME, _TS), *((f, _DOUBLE) for f in FEATURES))
REFERENCE_WEEKS = _struct((KEY, _LONG), ("reference_week", _TEXT), ("stability_score", _DOUBLE))
ANOMALIES = _struct(
    (KEY, _LONG), (TIME, _TS), ("anomaly_score", _DOUBLE), *((f, _DOUBLE) for f in FEATURES),
    ("severity_score", _DOUBLE),
)
CELL_STATS = _struct(
    (KEY, _LONG), ("anomaly_count", _LONG), ("avg_severity", _DOUBLE), ("max_severity", _DOUBLE),
    ("severity_std", _DOUBLE), *((f"{f}_mean", _DOUBLE) for f in FEATURES),
    ("weighted_severity", _DOUBLE), ("severity_impact", _DOUBLE),
    ("has_extreme_anomalies", _BOOL), ("extreme_anomaly_count", _LONG),
)
GRID_FILE = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", _struct(("cellId", _TEXT), ("cell_id", _TEXT))),
        T.StructField("geometry", T.StructType([
            T.StructField("type", _TEXT),
            T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(_DOUBLE)))),
        ])),
    ]))),
])

# Required columns of each named stage table, the most telling ones checked first by `detect_contract`.
CONTRACTS: dict[str, T.StructType] = {
    "ingested": INGESTED,
    "preprocessed": TRAFFIC,
    "reference_weeks": _struct((KEY, _LONG), ("reference_week", _TEXT)),
    "individual_anomalies": ANOMALIES,
    "cell_statistics": _struct(
        (KEY, _LONG), ("anomaly_count", _LONG), ("avg_severity", _DOUBLE), ("max_severity", _DOUBLE)
    ),
}

# The accepted range of each column, None for no limit.
VALUE_RANGES: dict[str, tuple[float | None, float | None]] = {
    "cell_id": (1, 100_000),
    "sms_total": (0, 50_000),
    "calls_total": (0, 20_000),
    "internet_traffic": (0, 1e12),
    "anomaly_score": (0, None),
    "severity_score": (2.0, None),
    "anomaly_count": (0, None),
}
