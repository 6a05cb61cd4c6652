"""The features of GeoJSON collections, a file read by many tasks.

A collection is one JSON document, so no task can tell from its own bytes where in the document it is. The text reader cuts
a file into byte ranges and, with ``}`` as its line end, into pieces that are never split. A first scan sums up each range
for either case, that it starts outside or inside of a string: how the nesting changes and which members were
opened. These rows, one a range, give every range its place in the document; a second scan then cuts out the features. One that
spans ranges comes in parts, which are joined by file and the range it began in.

Brackets count outside of strings only, with escapes resolved, so layout, key order and braces inside of texts do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_SUMMARY = "file string, block long, size long, bytes long, odd boolean, cases array<struct<change:int,least:int,opened:map<int,string>,wanted:array<int>>>"
_PARTS = "file string, owner long, part long, feature string"


class Place(NamedTuple):
    """Where in its document a range starts: in a string?, depth of nesting, open member, range in which the open feature began."""

    inside: bool
    depth: int
    member: str | None
    owner: int | None


def _brackets(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Brackets of a stretch: place, +1 or -1, whether an odd number of quotes precedes; and whether all quotes are odd in number."""
    raw = np.frombuffer(text, np.uint8)
    quote = raw == 0x22
    slash = raw == 0x5C
    if slash.any():
        # A quote after an odd run of backslashes is escaped.
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
        quote[1:] &= (np.arange(len(raw) - 1) - plain[:-1]) % 2 == 0
    quotes = np.cumsum(quote)
    at = np.flatnonzero((raw == 0x7B) | (raw == 0x5B) | (raw == 0x7D) | (raw == 0x5D))
    sign = np.where((raw[at] == 0x7B) | (raw[at] == 0x5B), 1, -1)
    return at, sign, quotes[at] % 2 == 1, bool(len(quotes) and quotes[-1] % 2)


def _member(text: bytes, at: int) -> str | None:
    """The key of the value that opens here; a key never spans a ``}``, so it is in the same stretch."""
    found = _KEY.search(text[text.rfind(b"}", 0, at) + 1:at])
    return found and found[1].decode(errors="replace")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Consecutive pieces of the same range, with the line ends the reader took away."""
    for batch in batches:
        value, file, block, size = (c.to_pylist() for c in batch.columns)
        first = 0
        for k in range(1, len(value) + 1):
            if k == len(value) or (file[k], block[k]) != (file[first], block[first]):
                yield file[first], block[first], size[first], b"".join([x + b"}" for x in value[first:k]])
                first = k


def _summarise(batches: Iterator[pa.RecordBatch], member: str) -> Iterator[pa.RecordBatch]:
    ranges: dict[tuple[str, int], list] = {}
    named = re.compile(rb'"' + re.escape(member.encode()) + rb'"\s*:\s*[\[{]')
    for file, block, size, text in _stretches(batches):
        held = ranges.setdefault((file, block), [size, 0, False, [[0, 0, {}, set()], [0, 0, {}, set()]]])
        at, sign, after_odd, odd = _brackets(text)
        wanted = [m.end() - 1 for m in named.finditer(text)]
        for case in (0, 1):
            state = held[3][case]
            mine = after_odd == bool(case ^ held[2])
            where, steps = at[mine], sign[mine]
            depth = state[0] + np.cumsum(steps)
            if len(depth):
                opens = np.flatnonzero(steps > 0)
                for d in np.unique(depth[opens]):
                    state[2][int(d) - 1] = _member(text, int(where[opens[depth[opens] == d][-1]]))
                state[3].update((depth[np.isin(where, wanted)] - 1).tolist())
                state[0], state[1] = int(depth[-1]), min(state[1], int(depth.min()))
        held[1] += len(text)
        held[2] ^= odd
    rows = [
        {"file": f, "block": b, "size": size, "bytes": n, "odd": odd,
         "cases": [{"change": c, "least": low, "opened": list(names.items()), "wanted": sorted(w)} for c, low, names, w in cases]}
        for (f, b), (size, n, odd, cases) in ranges.items()]
    case = pa.struct([("change", pa.int32()), ("least", pa.int32()), ("opened", pa.map_(pa.int32(), pa.string())), ("wanted", pa.list_(pa.int32()))])
    yield pa.RecordBatch.from_pylist(rows, pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("odd", pa.bool_()), ("cases", pa.list_(case))]))


def places(summaries: list[Row], member: str) -> dict[tuple[str, int], Place]:
    """The place of every range out of the ranges' summaries; a broken document is an error."""
    found: dict[tuple[str, int], Place] = {}
    files: dict[str, list[Row]] = {}
    for row in sorted(summaries, key=lambda r: (r.file, r.block)):
        files.setdefault(row.file, []).append(row)
    for file, rows in files.items():
        place, seen = Place(False, 0, None, None), False
        for row in rows:
            found[file, row.block] = place
            case = row.cases[int(place.inside)]
            depth = place.depth + case.change
            opened = case.opened.get(1 - place.depth, place.member)
            seen |= 1 - place.depth in case.wanted
            began_here = place.depth + case.least <= 2
            place = Place(place.inside ^ row.odd, depth, opened, row.block if began_here else place.owner)
        # The reader's last piece may have had no line end of its own.
        unended = sum(r.bytes for r in rows) - rows[0].size
        if place.inside or place.depth != -unended:
            raise ValueError(f"{file} is no complete JSON document")
        if not seen:
            raise ValueError(f"no {member} in {file}")
    return found


def _cut(known: dict[tuple[str, int], Place], member: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, open_, first = None, None, None, False
        for file, block, _, text in _stretches(batches):
            if (file, block) != current:
                if open_:
                    yield _part(current, open_[0], b"".join(open_[1]))
                current, place = (file, block), known[file, block]
                open_ = (place.owner, []) if place.depth > 2 and place.member == member else None
            at, sign, after_odd, odd = _brackets(text)
            mine = after_odd == place.inside
            where, steps = at[mine], sign[mine]
            depth = place.depth + np.cumsum(steps)
            name, start, whole = place.member, 0, []
            turns = np.flatnonzero(((steps > 0) & (depth <= 3)) | ((steps < 0) & (depth <= 2)))
            for k, level, step in zip(where[turns].tolist(), depth[turns].tolist(), steps[turns].tolist(), strict=True):
                if step > 0 and level == 2:
                    name, start, first = _member(text, k), k + 1, True
                    if name == member and text[k:k + 1] != b"[":
                        raise ValueError(f"{member} of {file} is no array")
                elif name != member:
                    continue
                elif step > 0 and level == 3:
                    if text[k:k + 1] != b"{" or text[start:k].strip() != (b"" if first else b","):
                        raise ValueError(f"{member} of {file} holds something other than objects")
                    open_, start, first = (block, []), k, False
                elif level == 2:
                    closed = b"".join([*open_[1], text[start:k + 1]])
                    if open_[0] == block:
                        whole.append(closed)
                    else:
                        yield _part(current, open_[0], closed)
                    open_, start = None, k + 1
                elif level == 1 and text[start:k].strip():
                    raise ValueError(f"{member} of {file} holds something other than objects")
            if open_:
                open_[1].append(text[start:])
            place = Place(place.inside ^ odd, int(depth[-1]) if len(depth) else place.depth, name, None)
            n = len(whole)
            yield pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(whole, pa.binary()).cast(pa.string()),
            ], names=["file", "owner", "part", "feature"])
        if open_:
            yield _part(current, open_[0], b"".join(open_[1]))

    return cut


def _part(current: tuple[str, int], owner: int, text: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([current[0]]), pa.array([owner], pa.int64()), pa.array([current[1]], pa.int64()), pa.array([text.decode()]),
    ], names=["file", "owner", "part", "feature"])


def feature_texts(spark: SparkSession, path: str, member: str = "features") -> DataFrame:
    """``(feature)``: the JSON text of every element of the array ``member`` at the top of each document under ``path``.

    Reads the files twice. What comes to the driver is one row a byte range. A document that ends early, has no
    such array, or holds something other than objects there is an error.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    known = places(pieces.mapInArrow(lambda b: _summarise(b, member), _SUMMARY).collect(), member)
    parts = pieces.mapInArrow(_cut(known, member), _PARTS)
    joined = parts.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("part", "feature"))).alias("p"))
    spanning = joined.select(F.array_join(F.col("p.feature"), "").alias("feature"))
    return parts.where("owner IS NULL").select("feature").unionByName(spanning)
