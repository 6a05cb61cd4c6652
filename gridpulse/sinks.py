"""Writers: stage tables, result tables, report text and GeoJSON features.

A target that exists is an error unless ``mode`` says otherwise. ``watch`` of the Parquet writers is applied to the rows as
they are written, behind any shuffle, so that what it observes counts each of them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.timekeys import week_index
from gridpulse.schemas import KEY, TIME, WEEK


Watch = Callable[[DataFrame], DataFrame]


def write_parquet(
    df: DataFrame, path: str, codec: str | None = None, mode: str = "errorifexists", watch: Watch | None = None,
) -> None:
    writer = (watch(df) if watch else df).write.mode(mode)
    (writer.option("compression", codec) if codec else writer).parquet(path)


def write_clustered(
    df: DataFrame, path: str, keys: tuple[str, ...] = (KEY, TIME), mode: str = "errorifexists", watch: Watch | None = None,
) -> None:
    """Range-cluster on ``keys`` so that row-group statistics prune by cell.

    The ranges run over cell *and* time, so one hot cell is cut into many files. Finding the ranges
    runs the last stage of ``df`` once more, which is cheap behind a shuffle; see `write_balanced`.
    """
    clustered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_parquet(clustered, path, codec="zstd", mode=mode, watch=watch)


# Bits of a key's and of a week's place on the curve: 256 stretches each, 65,536 tiles.
CURVE_BITS = 8


def curve_place(df: DataFrame, key: str = KEY, time: str = TIME, bits: int = CURVE_BITS) -> Column:
    """A row's place on the Z-curve over key and week: the bits of both, taken in turn.

    Either is cut into equal stretches between its 1st and 99th percentile (by a sketch, one scan), with what lies
    beyond in the outermost ones, so that a stray id does not squeeze all others into one stretch.
    """
    week = week_index(time)
    span = df.agg(
        *[F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(c), F.array(F.lit(0.01), F.lit(0.99))).alias(n)
          for c, n in ((F.col(key).cast("long"), "key"), (week.cast("long"), "week"))]) if df.where(
              F.col(key).isNotNull() & F.col(time).isNotNull()).limit(1).count() else None
    found = span.first() if span is not None else None

    def stretch(value: Column, low: int, high: int) -> Column:
        part = F.floor((value.cast("double") - F.lit(float(low))) * F.lit((1 << bits) / (high - low + 1)))
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), part)), F.lit(0)).cast("long")

    if found is None:
        return F.lit(0).cast("long")
    keys, weeks = stretch(F.col(key), *found.key), stretch(week, *found.week)
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for value, to in ((keys, 2 * bit + 1), (weeks, 2 * bit)):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1).cast("long")), to))
    return place


def write_curved(
    df: DataFrame, path: str, key: str = KEY, time: str = TIME, mode: str = "errorifexists", watch: Watch | None = None,
) -> None:
    """Cluster along a Z-curve over key and week, so that reads of one cell and reads of one week both skip most row groups.

    `write_clustered` orders by cell first: a cell's rows are few row groups, but a week is in all of them. A row group
    without the wanted cell is told even where the cell lies within its range: by its dictionary of keys, or by a Bloom filter
    where there are too many for one.
    Reads ``df`` for the spans and for the ranges, so give it a stage table.
    """
    curve = "_curve"
    placed = df.withColumn(curve, curve_place(df, key, time))
    ordered = placed.repartitionByRange(curve, key, time).sortWithinPartitions(curve, key, time).drop(curve)
    writer = (watch(ordered) if watch else ordered).write.mode(mode).option("compression", "zstd")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_weekly(
    df: DataFrame, path: str, keys: tuple[str, ...] = (KEY, TIME), time: str = TIME, mode: str = "errorifexists", watch: Watch | None = None,
) -> None:
    """One folder per ISO week, named by its `week_index` in the column ``week``, clustered on ``keys`` inside.

    A join on the week then prunes folders at run time. The ranges run over week *and* keys, so a task writes few weeks and
    a large week or a hot cell is cut into many files. A panel has about 52 weeks a year, however many rows.
    """
    dated = df.withColumn(WEEK, week_index(time).cast("int"))
    clustered = dated.repartitionByRange(WEEK, *keys).sortWithinPartitions(WEEK, *keys)
    (watch(clustered) if watch else clustered).write.mode(mode).option("compression", "zstd").partitionBy(WEEK).parquet(path)


def write_balanced(
    df: DataFrame, path: str, keys: tuple[str, ...] = (KEY,), mode: str = "errorifexists", watch: Watch | None = None,
) -> None:
    """Keep a cell's rows together in files of even size; adaptive execution merges small partitions
    and splits that of a hot cell. Runs ``df`` once."""
    write_parquet(df.hint("rebalance", *keys), path, mode=mode, watch=watch)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Format by extension: ``.csv`` is CSV with a header, anything else Parquet."""
    if path.rstrip("/").endswith(".csv"):
        write_csv(df, path, mode)
    else:
        write_parquet(df, path, mode=mode)


def report_lines(report: DataFrame) -> DataFrame:
    """A report ``(position, section, key, value)`` as ordered text lines, one section after another."""
    return report.orderBy("position").select(
        F.format_string("%s | %s: %s", "section", "key", "value").alias("value")
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file; a report has a few dozen lines whatever the size of the input."""
    report_lines(report).coalesce(1).write.mode(mode).text(path)


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """GeoJSON features, one per line."""
    features.select(F.col("feature").alias("value")).write.mode(mode).text(path)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of a table for a look at its shape; ``df.printSchema()`` gives the rest."""
    return df.limit(rows)
