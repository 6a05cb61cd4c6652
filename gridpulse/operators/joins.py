"""Joining a large panel to one-row-per-key tables without a hot key and without a blind broadcast."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.schemas import KEY

# A table is broadcast only if its known row count times its width stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# A key with more rows than this is split into parts of about this many...
PART_ROWS = 1_000_000
# ...but into parts of no less than 1/HOT_PARTS of all rows, which bounds how many keys can be split.
HOT_PARTS = 100_000
_SALT, _SALTS = "_salt", "_salts"


def broadcast_rows(columns: int) -> int:
    """How many rows of ``columns`` eight-byte values (and some row overhead) may be broadcast."""
    return BROADCAST_BYTES // (8 * (columns + 4))


def hot_keys(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``(key, _salts)`` of the keys with more rows than a part holds.

    Fewer than HOT_PARTS rows by pigeonhole and fewer than twice as many salts in total, whatever
    the size of ``df``; counting is pre-aggregated and reads the key column.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    part = counts.agg(F.greatest(F.sum("n") / F.lit(HOT_PARTS), F.lit(float(part_rows)))).scalar()
    return (
        counts.withColumn("parts", F.col("n") / part).where("parts > 1")
        .select(key, F.ceil("parts").cast("int").alias(_SALTS))
    )


def _salted(panel: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The panel with ``_salt``: 0 but for hot keys, whose rows go evenly over their parts."""
    spread = F.xxhash64(*panel.columns)
    # A NULL key matches nothing, so its rows may go anywhere.
    salts = F.when(F.col(key).isNull(), F.lit(HOT_PARTS)).otherwise(F.coalesce(_SALTS, F.lit(1)))
    return panel.join(F.broadcast(hot), key, "left").withColumn(_SALT, F.pmod(spread, salts).cast("int")).drop(_SALTS)


def write_bucketed(
    panel: DataFrame, name: str, path: str, buckets: int, key: str = KEY, part_rows: int = PART_ROWS,
) -> None:
    """The panel as table ``name`` with files under ``path``, bucketed on key and salt and sorted by key within.

    For a panel that is joined again and again, as every new model scores it: `BucketedPanel` joins it without
    shuffling it. A bucket is one task's work, so choose ``buckets`` for some hundred megabytes each; hot keys are
    spread over buckets by their salt. The few hot keys are stored beside it.
    """
    hot = hot_keys(panel, key, part_rows)
    hot.write.parquet(f"{path}/hot")
    stored = panel.sparkSession.read.schema(hot.schema).parquet(f"{path}/hot")
    # One writer a bucket, or every task would write a file for each.
    dealt = _salted(panel, key, stored).repartition(buckets, key, _SALT)
    dealt.write.bucketBy(buckets, key, _SALT).sortBy(key, _SALT).option("path", f"{path}/rows").option("compression", "zstd").saveAsTable(name)


class Lookup:
    """Joins several lookup tables to one panel, choosing the strategy once from a checked size.

    ``rows`` and ``columns`` bound the size of every table that will be joined. Up to the
    broadcast limit (or ``limit`` rows, if given) they are broadcast and the panel is never
    shuffled. Beyond it both sides are shuffled on the key plus a salt that is zero except for
    hot keys, whose rows it spreads over parts of about ``part_rows``; the panel side is the same
    exchange for every table joined, and Spark reuses it.
    """

    def __init__(
        self, panel: DataFrame, key: str, rows: int, columns: int = 4, limit: int | None = None,
        part_rows: int = PART_ROWS,
    ):
        self.key, self.broadcast = key, rows <= (broadcast_rows(columns) if limit is None else limit)
        if self.broadcast:
            self.panel = panel
            return
        self.hot = hot_keys(panel, key, part_rows)
        self.panel = _salted(panel, key, self.hot)

    def join(
        self, table: DataFrame, how: str = "inner", on: Sequence[str] = (),
        panel: Callable[[DataFrame], DataFrame] = lambda p: p,
    ) -> DataFrame:
        """``panel(self.panel)`` joined to ``table`` on the key and the further columns ``on``."""
        keys = [self.key, *on]
        left = panel(self.panel)
        if self.broadcast:
            return left.join(F.broadcast(table), keys, how)
        spread = (
            table.join(F.broadcast(self.hot), self.key, "left")
            .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1)))
            .drop(_SALTS)
        )
        return left.join(spread, [*keys, _SALT], how).drop(_SALT)


class BucketedPanel(Lookup):
    """A panel that `write_bucketed` stored, joined where its buckets lie: only the lookup tables are shuffled."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str = KEY):
        self.key, self.broadcast = key, False
        self.panel = spark.table(name)
        self.hot = spark.read.schema(f"{key} {self.panel.schema[key].dataType.simpleString()}, {_SALTS} int").parquet(f"{path}/hot")
