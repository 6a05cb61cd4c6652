"""Session settings the library relies on, and tables written between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "gridpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the one runtime setting results depend on: timestamps are UTC. Files get timestamps of a type that has
    statistics, without which no read of a time range skips anything."""
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")):
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _FALLBACK:
        _FALLBACK[application] = tempfile.mkdtemp(prefix="spark-gridpulse-")
    return _FALLBACK[application]


def stage_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> str:
    """Write ``df`` as a Parquet table of its own in the shared folder and return its path."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage at a stage boundary.

    Later stages read only the columns and row groups they need, know the exact size, and
    survive the loss of any executor.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, name))
