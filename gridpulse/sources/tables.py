"""Stage tables by file type, with the two input repairs consumers may need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.schemas import ANOMALIES, KEY, TIME


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet for ``.parquet`` paths and folders, CSV with a header for ``.csv``."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_anomalies(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Anomaly records of any accepted layout, with a scalar key and a temporal timestamp.

    CSV has the columns of the anomaly contract unless a schema says otherwise, so nothing is inferred.
    """
    if schema is None and path.rstrip("/").endswith(".csv"):
        schema = ANOMALIES
    return as_timestamp(unwrap_key(read_table(spark, path, schema)))


def unwrap_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """A one-element array key becomes its element; a scalar key is left alone."""
    if isinstance(df.schema[key].dataType, T.ArrayType):
        return df.withColumn(key, F.try_element_at(F.col(key), F.lit(1)))
    return df


def as_timestamp(df: DataFrame, time: str = TIME) -> DataFrame:
    """Parse the time column unless it is temporal already; zone-less times are UTC."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        return df
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withColumn(time, F.to_timestamp(time))
