"""The geographic grid: one polygon per cell out of a GeoJSON feature collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.schemas import GRID_FILE, KEY
from gridpulse.sources.features import feature_texts

_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of one or many GeoJSON files as ``(cell_id, geometry)``; a defect is an error.

    A plain file is read in byte ranges by many tasks; a compressed one cannot be and is one task's work.
    """
    if path.rstrip("/").endswith(_COMPRESSED):
        reader = spark.read.schema(GRID_FILE).options(multiLine=True, mode="FAILFAST")
        return require_grid(grid_from_features(reader.json(path)))
    parsed = F.from_json("feature", GRID_FILE["features"].dataType.elementType, {"mode": "FAILFAST"})
    return require_grid(_cells(feature_texts(spark, path).select(parsed.alias("f"))))


def parse_grid(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same for feature collections that already sit in a text column."""
    parsed = lines.select(F.from_json(F.col(line), GRID_FILE, {"mode": "FAILFAST"}).alias("c"))
    return grid_from_features(parsed.select("c.*"))


def _need(value: Column, message: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


def grid_from_features(collections: DataFrame) -> DataFrame:
    """Explode ``features``; the id may be called ``cellId`` or ``cell_id`` and may be text.

    A collection without features and a feature without an id or a polygon are errors.
    """
    return _cells(collections.select(F.explode(_need(F.col("features"), "no features in the grid")).alias("f")))


def _cells(feature: DataFrame) -> DataFrame:
    cell = F.coalesce("f.properties.cellId", "f.properties.cell_id")
    return feature.select(
        _need(cell, "a grid feature has no id").cast("bigint").alias(KEY),
        F.when(F.col("f.geometry.coordinates").isNotNull(), F.col("f.geometry")).otherwise(
            F.raise_error(F.lit("a grid feature has no polygon"))).alias("geometry"),
    )


def require_grid(grid: DataFrame, key: str = KEY) -> DataFrame:
    """The gate on a grid: no cells, or an id twice, is an error."""
    cells, ids = grid.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if not cells:
        raise ValueError("the grid has no cells")
    if cells != ids:
        raise ValueError(f"{cells - ids} grid cells repeat an id")
    return grid
