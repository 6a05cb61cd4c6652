"""The engine's inputs, derived by Spark from the event, order-line and customer tables.

``events`` has five event types, which stand for the five measures: user = cell, day = time.
``lineitem`` by supplier and ship date is a longer panel. ``customer`` ids are the grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.operators.cells import cell_stats
from gridpulse.operators.joins import BucketedPanel, write_bucketed
from gridpulse.operators.subspace import SubspaceDetector
from gridpulse.operators.traffic import build_traffic
from gridpulse.operators.weeks import select_reference_weeks
from gridpulse.schemas import FEATURES, KEY, MEASURES, TIME
from gridpulse.session import configure, stage_path, write_stage
from gridpulse.sinks import write_clustered, write_csv, write_weekly

# Which event type stands for which measure.
EVENT_MEASURES = {
    "signup": "sms_in", "purchase": "sms_out", "error": "call_in", "view": "call_out", "click": "internet_traffic",
}
ORDER_MEASURES = {
    "l_quantity": "sms_in", "l_tax": "sms_out", "l_linenumber": "call_in", "l_discount": "call_out",
    "l_extendedprice": "internet_traffic",
}
_STAGED: dict[tuple[str, str, str], tuple[tuple, str, T.StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and modification times of the files under a folder, as its file system tells them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def staged(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], str] = write_stage,
) -> DataFrame:
    """A stage table shared by the queries of one application, written by the first that needs it.

    It is written anew once a file of the input has changed, and the outdated one is left to the folder's owner.
    """
    at, state = (spark.sparkContext.applicationId, sf_dir, name), input_state(spark, sf_dir)
    if at in _STAGED and _STAGED[at][0] == state:
        _, path, schema = _STAGED[at]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _STAGED[at]
    df = build()
    path = write(df, name)
    # Folder columns come last in what is read.
    _STAGED[at] = (state, path, spark.read.parquet(path).schema if write is not write_stage else df.schema)
    return spark.read.schema(_STAGED[at][2]).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a UTC timestamp instead of a zone-less one."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event with a single measure set, in daily bins."""
    measures = [
        F.when(F.col("event_type") == e, F.col("value")).alias(m) for e, m in EVENT_MEASURES.items()
    ]
    return events(spark, sf_dir).select(F.date_trunc("day", "ts").alias(TIME), F.col("user_id").alias(KEY), *measures)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw tab-separated lines with every kind of imperfect field."""
    kind, value = F.col("event_type"), F.col("value").cast("string")

    def field(measure: str, absent: str) -> Column:
        own = next(e for e, m in EVENT_MEASURES.items() if m == measure)
        return F.when(kind == own, value).otherwise(absent)

    time = F.unix_millis("ts").cast("string")
    # Some records have their time in micro- or nanoseconds, with 16 or 19 digits.
    longer = F.when(F.col("event_id") % 11 == 3, F.concat(time, F.lit("000"))).when(
        F.col("event_id") % 11 == 7, F.concat(time, F.lit("000000"))).otherwise(time)
    millis = F.when(kind == "error", "n/a").otherwise(longer)
    surplus = F.when(kind == "click", F.lit("surplus"))
    fields = [
        F.col("user_id").cast("string"), millis, F.lit("39"), field("sms_in", ""), field("sms_out", "NULL"),
        field("call_in", "bad"), field("call_out", "null"), field("internet_traffic", ""), surplus,
    ]
    return events(spark, sf_dir).select(F.concat_ws("\t", *fields).alias("line"))


def events_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "traffic", lambda: build_traffic(events_ingested(spark, sf_dir)))


def _clustered(df: DataFrame, name: str) -> str:
    path = stage_path(df.sparkSession, name)
    write_clustered(df, path)
    return path


def events_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested events in files clustered on cell and time."""
    return staged(spark, sf_dir, "ingested_clustered", lambda: events_ingested(spark, sf_dir), _clustered)


_BUCKETED: dict[tuple[str, str], tuple[tuple, str, str]] = {}


def events_bucketed(spark: SparkSession, sf_dir: str, buckets: int = 8, part_rows: int = 20) -> BucketedPanel:
    """The events panel in buckets, with so small a bound on a part that many cells are hot ones."""
    at, state = (spark.sparkContext.applicationId, sf_dir), input_state(spark, sf_dir)
    if at not in _BUCKETED or _BUCKETED[at][0] != state or not spark.catalog.tableExists(_BUCKETED[at][1]):
        path = stage_path(spark, "bucketed")
        name = "panel_" + path.rsplit("-", 1)[1]
        write_bucketed(events_traffic(spark, sf_dir), name, path, buckets, part_rows=part_rows)
        _BUCKETED[at] = (state, name, path)
    return BucketedPanel(spark, *_BUCKETED[at][1:])


def _by_week(df: DataFrame, name: str) -> str:
    path = stage_path(df.sparkSession, name)
    write_weekly(df, path)
    return path


def events_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events panel in a folder per week."""
    return staged(spark, sf_dir, "traffic_weekly", lambda: build_traffic(events_ingested(spark, sf_dir)), _by_week)


def orders_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order panel in a folder per week, seven years of them."""
    return staged(spark, sf_dir, "orders_weekly", lambda: build_traffic(orders_ingested(spark, sf_dir)), _by_week)


def events_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "weeks", lambda: select_reference_weeks(events_traffic(spark, sf_dir)))


def detector(spark: SparkSession, sf_dir: str, k: int = 2, **options) -> SubspaceDetector:
    return SubspaceDetector(events_traffic(spark, sf_dir), events_weeks(spark, sf_dir), n_components=k, **options)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events panel's anomalies with two components."""
    return staged(spark, sf_dir, "anomalies", lambda: detector(spark, sf_dir).anomalies())


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "cell_stats", lambda: cell_stats(anomalies(spark, sf_dir)))


def event_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as an anomaly record with its value as severity: full times of day, all cells."""
    groups = {
        "sms_total": ("signup", "purchase"), "calls_total": ("error", "view"), "internet_traffic": ("click",),
    }
    features = [
        F.when(F.col("event_type").isin(*groups[f]), F.col("value")).otherwise(0.0).alias(f) for f in FEATURES
    ]
    return events(spark, sf_dir).select(
        F.col("user_id").alias(KEY), F.col("ts").alias(TIME), (F.col("value") / 10).alias("anomaly_score"),
        *features, F.col("value").alias("severity_score"),
    )


_CSV: dict[tuple[str, str], tuple[tuple, str]] = {}


def anomalies_csv(spark: SparkSession, sf_dir: str) -> str:
    """The path of the event anomalies as CSV files with a header."""
    at, state = (spark.sparkContext.applicationId, sf_dir), input_state(spark, sf_dir)
    if at not in _CSV or _CSV[at][0] != state:
        path = stage_path(spark, "anomalies") + ".csv"
        rows = event_anomalies(spark, sf_dir).withColumn(TIME, F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        write_csv(rows, path)
        _CSV[at] = (state, path)
    return _CSV[at][1]


def orders_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by supplier and ship date, seven years long."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_shipdate").cast("timestamp").alias(TIME), F.col("l_suppkey").alias(KEY),
        *[F.col(c).cast("double").alias(m) for c, m in ORDER_MEASURES.items()],
    )


def orders_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "orders_traffic", lambda: build_traffic(orders_ingested(spark, sf_dir)))


def orders_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "orders_weeks", lambda: select_reference_weeks(orders_traffic(spark, sf_dir)))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per customer id, a hundred to a row, as a closed ring of [lon, lat]."""
    cell = F.col("c_custkey")
    west, south = F.lit(9.0) + (cell % 100) * 0.01, F.lit(45.0) + F.floor(cell / 100) * 0.01
    east, north = west + 0.01, south + 0.01
    ring = F.array(*[F.array(x, y) for x, y in
                     ((west, south), (east, south), (east, north), (west, north), (west, south))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return table(spark, sf_dir, "customer").select(cell.alias(KEY), geometry.alias("geometry"))


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as GeoJSON text, a collection of one feature per customer; every second id is text."""
    text = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.when(F.col(KEY) % 2 == 0, F.col(KEY).cast("string")).alias("cellId"), F.when(F.col(KEY) % 2 == 1, F.col(KEY)).alias("cell_id")).alias("properties"),
        F.col("geometry"),
    )).alias("features")))
    return grid(spark, sf_dir).select(text.alias("line"))


FILE_FEATURES = 10_000
_GRID_FILES: dict[tuple[str, str], tuple[tuple, str]] = {}


def grid_files(spark: SparkSession, sf_dir: str) -> str:
    """The path of the grid as GeoJSON files, one collection of up to some ten thousand features in each."""
    at, state = (spark.sparkContext.applicationId, sf_dir), input_state(spark, sf_dir)
    if at not in _GRID_FILES or _GRID_FILES[at][0] != state:
        path, cells = stage_path(spark, "grid"), grid(spark, sf_dir)
        files = 1 + cells.count() // FILE_FEATURES
        feature = F.to_json(F.struct(
            F.lit("Feature").alias("type"), F.struct(F.col(KEY).alias("cellId"), F.lit('a "}" in a name').alias("name")).alias("properties"), "geometry"))
        collections = cells.groupBy(F.pmod(F.xxhash64(KEY), F.lit(files)).alias("file")).agg(F.concat(
            F.lit('{"type": "FeatureCollection", "features": [\n'), F.array_join(F.collect_list(feature), ",\n"), F.lit("]}")).alias("value"))
        collections.write.partitionBy("file").text(path)
        _GRID_FILES[at] = (state, path)
    return _GRID_FILES[at][1]


def imperfect_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as anomaly records: a value each, some of them NaN or infinite, of either sign."""
    nth, value = F.col("event_id") % 13, F.col("value")
    odd = F.when(nth == 1, F.lit(float("nan"))).when(nth == 2, F.lit(float("inf"))).when(nth == 3, F.lit(float("-inf"))).otherwise(value)
    return events(spark, sf_dir).select(
        F.col("user_id").alias(KEY), F.col("ts").alias(TIME), odd.alias("severity_score"), *[value.alias(f) for f in FEATURES])


def small_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier ids: too few for the event cells."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(KEY))
