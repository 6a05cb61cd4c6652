"""What several operators need from the session and the tables."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import gridpulse
from gridpulse.session import configure, shared_dir

_SHIPPED: set[str] = set()
# Whole texts travel to Python in batches of rows; Spark's default of 10000 is meant for short rows.
_BATCH_ROWS, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session: executors can import this package, checkpoints have a folder, and batches for Python are small.

    The folder is the one that ``spark.checkpoint.dir`` names; only a local session without the
    setting gets one of its own. The package travels by ``addPyFile`` once per application.
    """
    context = configure(spark).sparkContext
    if spark.conf.get(_BATCH_ROWS) == DEFAULT_ROWS:
        spark.conf.set(_BATCH_ROWS, TEXT_ROWS)
    if context.applicationId in _SHIPPED:
        return spark
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    home = os.path.dirname(os.path.abspath(gridpulse.__file__))
    if os.path.isdir(home):
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-gridpulse-code-"), "gridpulse.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(home):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(home)))
        context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut; the files lie in the checkpoint folder and go with the frame."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)
