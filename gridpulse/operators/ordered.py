"""Duplicate keys of a table whose files are clustered on them, found by reading neighbours instead of shuffling.

`sinks.write_clustered` leaves every file sorted and the files' ranges of keys apart, so equal keys are neighbours in a
file, or stand at the end of one range and the start of the next. A scan of the key columns alone compares neighbours and
reports, per byte range of a file, its first and last key, the repeated keys between them, and whether it was in order. Those
reports are small (two rows a range and the repeats), and only they are shuffled.

Whether the order holds is checked, not assumed: a range out of order, or two ranges that overlap, sends the whole table
to the grouping that needs no order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.operators.quality import duplicate_keys
from gridpulse.schemas import KEY, TIME
from gridpulse.session import stage_table

_COMPARABLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DateType, T.TimestampType, T.TimestampNTZType)
_FIRST, _INNER, _LAST = 0, 1, 2


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """A column as arrays that compare like it: NULL before everything, then the value."""
    there = column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    kind = pa.int32() if column.type in (pa.date32(), pa.int32()) else pa.int16() if column.type == pa.int16() else pa.int8() if column.type == pa.int8() else pa.int64()
    values = column.cast(kind) if pa.types.is_integer(column.type) else column.view(kind)
    return [there, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]


class _Range:
    """The runs of equal keys in one byte range, as far as it was read."""

    def __init__(self):
        self.last: tuple | None = None  # its key as numbers, its values, its rows
        self.first_done, self.sorted = False, True

    def add(self, values: list[pa.Array]) -> Iterator[tuple[int, list, int]]:
        """Runs that have ended: position, values of the keys, rows."""
        numbers = np.array([n for v in values for n in _numbers(v)])
        apart = (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)
        head = np.concatenate(([0], np.flatnonzero(apart) + 1))
        size = np.diff(head, append=numbers.shape[1])
        keys = numbers[:, head]
        # The first column that differs decides the order.
        down = np.zeros(max(keys.shape[1] - 1, 0), bool)
        open_ = ~down
        for row in keys:
            down |= open_ & (row[1:] < row[:-1])
            open_ &= row[1:] == row[:-1]
        self.sorted &= not down.any()
        runs = list(zip(map(tuple, keys.T.tolist()), head.tolist(), size.tolist(), strict=True))
        if self.last:
            if runs[0][0] == self.last[0]:
                self.last = (self.last[0], self.last[1], self.last[2] + runs[0][2])
                runs = runs[1:]
            elif runs[0][0] < self.last[0]:
                self.sorted = False
        if not runs:
            return
        if self.last:
            yield from self._ended(*self.last[1:])
        ended = [r for k, r in enumerate(runs[:-1]) if r[2] > 1 or (k == 0 and not self.first_done)]
        for _, at, n in ended:
            yield from self._ended([v[at].as_py() for v in values], n)
        key, at, n = runs[-1]
        self.last = (key, [v[at].as_py() for v in values], n)

    def _ended(self, values: list, n: int) -> Iterator[tuple[int, list, int]]:
        if not self.first_done:
            self.first_done = True
            yield _FIRST, values, n
        elif n > 1:
            yield _INNER, values, n

    def close(self) -> Iterator[tuple[int, list, int]]:
        if self.last:
            yield _LAST, self.last[1], self.last[2]


def key_runs(df: DataFrame, keys: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """``(file, block, position, in_order, keys..., n)``: per byte range the first and last run and the repeats between.

    Reads the key columns in the order they lie in the files; a plan that is no plain file scan has no such order
    and is an `AnalysisException`.
    """
    placed = df.select(*keys, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    if not all(isinstance(kinds[k], _COMPARABLE) for k in keys):
        raise AnalysisException("keys must be whole numbers, dates or times")
    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("position", T.IntegerType()),
         T.StructField("in_order", T.BooleanType()), *[T.StructField(k, kinds[k]) for k in keys], T.StructField("n", T.LongType())])
    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, None
        for batch in batches:
            columns = batch.columns
            arrow = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[c.type for c in columns[:len(keys)]], pa.int64()]

            def rows(runs, at, ordered):
                found = [(*at, position, ordered, *values, n) for position, values, n in runs]
                held = zip(*found, strict=True) if found else [()] * len(arrow)
                return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(held, arrow, strict=True)], names=names)

            file, block = (c.dictionary_encode() for c in columns[len(keys):])
            # A batch may span ranges.
            moved = np.flatnonzero(np.diff(file.indices.to_numpy()) | np.diff(block.indices.to_numpy())) + 1
            cuts = [0, *moved.tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                here = (columns[len(keys)][a].as_py(), columns[len(keys) + 1][a].as_py())
                if here != place:
                    if state:
                        yield rows(list(state.close()), place, state.sorted)
                    place, state = here, _Range()
                yield rows(list(state.add([c.slice(a, b - a) for c in columns[:len(keys)]])), place, True)
        if state:
            yield rows(list(state.close()), place, state.sorted)

    return placed.mapInArrow(scan, schema)


def in_order(runs: DataFrame, keys: Sequence[str] = (KEY, TIME)) -> bool:
    """Whether every range was sorted and no two ranges share more than a border key. Looks at two rows a range."""
    key = F.struct(*keys)
    ranges = runs.where(F.col("position") != _INNER).groupBy("file", "block").agg(
        F.min(F.when(F.col("position") == _FIRST, key)).alias("first"), F.max(F.when(F.col("position") == _LAST, key)).alias("last"),
        F.min("in_order").alias("sorted")).withColumn("first", F.coalesce("first", "last"))
    before = F.max("last").over(W.partitionBy(F.lit(0)).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1))
    return ranges.withColumn("before", before).where(~F.col("sorted") | (F.col("before") > F.col("first"))).isEmpty()


def clustered_duplicates(df: DataFrame, keys: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """`duplicate_keys` of a table that is read straight from clustered files, without shuffling its rows."""
    try:
        runs = key_runs(df, keys)
    except AnalysisException:
        return duplicate_keys(df, keys)
    runs = stage_table(runs, "key_runs")
    if not in_order(runs, keys):
        return duplicate_keys(df, keys)
    return runs.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1")
