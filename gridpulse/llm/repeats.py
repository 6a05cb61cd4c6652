"""Suffix-array dedup: remove every byte of strings of ``window`` bytes that start at two places or more, anywhere.

One suffix array of a whole corpus fits nowhere, so texts are cut into small shared problems that lose no match. Every
window has an anchor: its stretch of ``ANCHOR`` bytes with the smallest hash, the first of equals. Equal windows
have equal anchors at equal distances, so windows are compared only with windows of the same anchor. Neighbouring windows
mostly share theirs; a run of them in one text is a segment.

1. Documents are shuffled into chunks of about ``chunk_bytes``. A chunk reports each of its anchors once: how often it
   occurs, and the smallest and largest hash of its segments there.
2. Per anchor these are summed up and answered to the chunks that have it. Found once: no repeat. One segment only, several
   times: all its windows repeat. Several segments: their texts must be compared.
3. Chunks send each such segment once, with a count, to a task that owns the anchor. There the distinct segments of an anchor
   are laid end to end, ``suffixes.suffix_arrays`` sorts all their suffixes, and suffixes next to each other that agree in
   ``window`` bytes, compared as text, are repeats. One bit per window goes back.

An anchor in very many different segments (the end of a line that a third of all texts share) is no single task's
work: its segments are cut into runs of ``NARROW`` windows, or of one window, and grouped by all the bytes that the windows of a
run have in common. A task then holds segments of one text, or few. All levels read the same exchange of the texts.

Hashes only find candidates and tell whether two segments are copies (128 bits, anchor and segment); what differs is
compared by the suffix array.

Defined cases: null and empty texts have no bytes and stay; shorter texts than a window lose nothing; repeated rows
repeat each other, whatever their ids; a row without doc_id is treated like any other; texts of any length are read whole, in
slices; extra columns are ignored; an empty table gives an empty result. Kept bytes are binary: a removed run may end inside a
character.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready
from gridpulse.llm.suffixes import ragged, suffix_arrays
from gridpulse.llm.text import as_bytes, mix

WINDOW, ANCHOR, CHUNK_BYTES = 200, 64, 8 << 20
# Anchors with more segments than these are cut into narrow runs of windows, and into single windows.
MANY, VERY_MANY, NARROW = 64, 65536, 17
SLICE, LANES = 1 << 20, 2 << 20
RESULT = "doc_id long, n_bytes long, kept binary, removed array<struct<first:long,last:long>>"
_U = np.uint64
_STEP, _PLACE = 0x9E3779B97F4A7C15, _U((1 << 22) - 1)
_CODES = np.random.default_rng(20240613).integers(0, 1 << 64, 256, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    held = _powers.held.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, SLICE + 2 * WINDOW), base, _U)
        factors[0] = 1
        held = _powers.held[base] = np.multiply.accumulate(factors)
    return held[:n]


_powers.held = {}


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, from running minima to both sides within blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = np.pad(values, (0, -len(values) % width), constant_values=np.iinfo(values.dtype).max).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


class Pieces(NamedTuple):
    """Runs of windows in a chunk's bytes: the windows' first and last start, the bytes to compare them by, and their hash."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    hash: np.ndarray


def joined(parts: list[Pieces]) -> Pieces:
    kinds = (np.int64, np.int64, _U, _U)
    return Pieces(*[np.concatenate([np.empty(0, k), *[p[i] for p in parts]]) for i, k in enumerate(kinds)])


class Slice:
    """Some consecutive bytes of a chunk with hashes of any stretch of them, and the segments of their windows."""

    def __init__(self, raw: np.ndarray, valid: np.ndarray, window: int, anchor: int):
        n = len(raw)
        self.window, self.anchor = window, anchor
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_CODES[raw] * _powers(_STEP, n), out=self.sums[1:])
        self.inverse = _powers(pow(_STEP, -1, 1 << 64), n + 1)
        grams = mix((self.sums[anchor:] - self.sums[:n - anchor + 1]) * self.inverse[:n - anchor + 1])
        # The smallest hash and, in the lowest bits, its first place.
        low = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), window - anchor + 1)
        at = np.where(valid, (low & _PLACE).astype(np.int64), -1)
        edge = np.flatnonzero(np.diff(at, prepend=-2) != 0)
        last = np.append(edge[1:], len(at)) - 1
        used = at[edge] >= 0
        self.at, first, last = at[edge][used], edge[used], last[used]
        self.segments = Pieces(first, last, grams[self.at], self.hash(first, last + window))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))

    def narrowed(self, chosen: np.ndarray, width: int) -> Pieces:
        """The chosen segments cut by the windows' distance from the anchor, keyed by all bytes the windows share."""
        first, last, at = self.segments.first[chosen], self.segments.last[chosen], self.at[chosen]
        out = []
        for far in range(0, self.window - self.anchor + 1, width):
            a, b = np.maximum(first, at - far - width + 1), np.minimum(last, at - far)
            some = a <= b
            a, b, low = a[some], b[some], at[some] - far
            key = mix(self.hash(low, low - width + 1 + self.window) + _U(width))
            out.append(Pieces(a, b, key, self.hash(a, b + self.window)))
        return joined(out)


class Chunk:
    """The documents of one chunk, laid end to end."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.given, texts = table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks())
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.cumsum([0, *map(len, texts)])
        self.window, self.anchor = window, anchor

    def slices(self) -> Iterator[tuple[int, Slice]]:
        """Slices that share all but one byte of a window, so each window lies in one."""
        room = np.diff(self.offset) - self.window + 1
        for start in range(0, max(len(self.raw) - self.window + 1, 0), SLICE):
            end = min(start + SLICE, len(self.raw) - self.window + 1)
            cover = np.zeros(end - start + 1, np.int64)
            a, b = np.clip(self.offset[:-1], start, end) - start, np.clip(self.offset[:-1] + np.maximum(room, 0), start, end) - start
            np.add.at(cover, a, 1)
            np.subtract.at(cover, b, 1)
            valid = np.cumsum(cover[:-1]) > 0
            if valid.any():
                yield start, Slice(self.raw[start:end + self.window - 1], valid, self.window, self.anchor)

    def anchors(self) -> pa.Table:
        """Each anchor once: occurrences, different segments, smallest and largest segment hash."""
        found = joined([s.segments for _, s in self.slices()])
        # Spark compares the hashes as signed numbers.
        order = np.lexsort((found.hash.view(np.int64), found.key))
        key, hashed = found.key[order], found.hash[order]
        new_key = np.diff(key, prepend=~key[:1]) != 0
        head = np.flatnonzero(new_key) if len(key) else np.empty(0, np.int64)
        different = np.cumsum(new_key | (np.diff(hashed, prepend=_U(0)) != 0))
        last = np.append(head[1:], len(key))[:len(head)] - 1
        return pa.table({
            "anchor": key[head].view(np.int64), "n": last - head + 1, "segments": different[last] - different[head] + 1,
            "low": hashed[head].view(np.int64), "high": hashed[last].view(np.int64)})

    def compared(self, anchors: np.ndarray, width: np.ndarray) -> tuple[Pieces, Pieces]:
        """Segments all whose windows repeat (width 0), and the pieces of segments to be compared, by the answers per anchor."""
        whole, pieces = [], []
        widest = self.window - self.anchor + 1
        order = np.argsort(anchors)
        anchors, width = anchors[order], width[order]
        for start, part in self.slices() if len(anchors) else ():
            near = np.minimum(np.searchsorted(anchors, part.segments.key), len(anchors) - 1)
            wide = np.where(anchors[near] == part.segments.key, width[near], -1)
            for w in np.unique(wide[wide >= 0]):
                chosen = np.flatnonzero(wide == w)
                found = part.narrowed(chosen, int(w)) if 0 < w < widest else Pieces(*[x[chosen] for x in part.segments])
                found = found._replace(first=found.first + start, last=found.last + start)
                (whole if w == 0 else pieces).append(found)
        return joined(whole), joined(pieces)


def repeated_windows(texts: list[bytes], owner: np.ndarray, copies: np.ndarray, window: int) -> list[np.ndarray]:
    """Which windows of each text occur in it or in another text of the same owner more than once.

    ``owner`` ascends. A text given as several ``copies`` repeats itself.
    """
    size = np.array([len(t) for t in texts])
    out = [np.full(n - window + 1, c > 1) for n, c in zip(size, copies, strict=True)]
    head = np.flatnonzero(np.diff(owner, prepend=~owner[:1]) != 0)
    count = np.diff(head, append=len(owner))
    length = np.add.reduceat(size + 1, head) if len(head) else size
    several = np.flatnonzero(count > 1)
    several = several[np.argsort(length[several], kind="stable")]
    batch = np.cumsum(length[several]) // LANES
    for own in np.split(several, np.flatnonzero(np.diff(batch)) + 1) if len(several) else ():
        held = ragged(head[own], count[own])
        # Symbols: 0 closes an owner's string, 1 a text; a text's end is no part of a window.
        raw = np.frombuffer(b"\0".join([texts[i] for i in held]) + b"\0", np.uint8).astype(np.int64) + 2
        ends = np.cumsum(size[held] + 1) - 1
        starts = ends - size[held]
        raw[ends] = 1
        closing = ends[np.cumsum(count[own]) - 1]
        raw[closing] = 0
        order = suffix_arrays(raw, np.concatenate(([0], closing[:-1] + 1)))
        full = np.zeros(len(raw), bool)
        full[ragged(starts, size[held] - window + 1)] = True
        order = order[full[order]]
        views = np.lib.stride_tricks.sliding_window_view(raw.astype(np.uint16), window)
        same = np.zeros(len(order), bool)
        for k in range(0, len(order) - 1, 1 << 15):
            pair = order[k:k + (1 << 15) + 1]
            same[k + 1:k + len(pair)] = (views[pair[1:]] == views[pair[:-1]]).all(axis=1)
        hit = np.zeros(len(raw), bool)
        hit[order[same]] = True
        hit[order[np.flatnonzero(same) - 1]] = True
        for i, s in zip(held, starts, strict=True):
            out[i] |= hit[s:s + len(out[i])]
    return out


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES,
    many: int = MANY, very_many: int = VERY_MANY, narrow: int = NARROW,
) -> DataFrame:
    """Per row: doc_id, its number of bytes, the bytes kept, and the removed byte ranges."""
    spark = ready(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # The row's place in the table deals out rows that share an id.
    deal = F.xxhash64("doc_id", F.octet_length("text"), F.monotonically_increasing_id())
    chunked = source.withColumn("chunk", F.pmod(deal, F.lit(chunks)))
    widest = window - anchor + 1

    def report(key: tuple, table: pa.Table) -> pa.Table:
        found = Chunk(table, window, anchor).anchors()
        return found.add_column(0, "chunk", pa.array([key[0].as_py()] * found.num_rows, pa.int64()))

    reported = chunked.groupBy("chunk").applyInArrow(
        report, "chunk long, anchor long, n long, segments long, low long, high long").repartition("anchor")
    totals = reported.groupBy("anchor").agg(
        F.sum("n").alias("total"), F.sum("segments").alias("different"), F.min("low").alias("least"), F.max("high").alias("most"))
    width = (
        F.when(F.col("least") == F.col("most"), 0).when(F.col("different") <= many, widest)
        .when(F.col("different") <= very_many, min(narrow, widest)).otherwise(1))
    marks = reported.select("chunk", "anchor").join(
        totals.where("total > 1").select("anchor", width.cast("int").alias("width")), "anchor")
    answers = marks.select("chunk", F.col("anchor").alias("key"), F.lit(0).cast("long").alias("hash"), "width", F.lit(None).cast("binary").alias("bits"))

    def given_marks(given: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        width = given.column("width").to_numpy()
        return given.column("key").to_numpy()[width >= 0].view(_U), width[width >= 0]

    def offer(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        chunk = Chunk(table, window, anchor)
        _, pieces = chunk.compared(*given_marks(given))
        order = np.lexsort((pieces.hash, pieces.key))
        new = (np.diff(pieces.key[order], prepend=_U(0)) != 0) | (np.diff(pieces.hash[order], prepend=_U(0)) != 0)
        new[:1] = True
        head = np.flatnonzero(new)
        one = order[head]
        data = chunk.raw.tobytes()
        texts = [data[a:b] for a, b in zip(pieces.first[one], pieces.last[one] + window, strict=True)]
        return pa.table([
            pa.array([key[0].as_py()] * len(one), pa.int64()), pa.array(pieces.key[one].view(np.int64)), pa.array(pieces.hash[one].view(np.int64)),
            pa.array(np.diff(head, append=len(order)), pa.int64()), pa.array(texts, pa.binary()),
        ], names=["chunk", "key", "hash", "n", "text"])

    offers = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        offer, "chunk long, key long, hash long, n long, text binary")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        keys, hashes, n = (table.column(c).to_numpy() for c in ("key", "hash", "n"))
        order = np.lexsort((hashes, keys))
        new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) | np.diff(hashes[order], prepend=~hashes[order[:1]]))
        texts = table.column("text").take(pa.array(order[new])).to_pylist()
        found = repeated_windows(texts, keys[order[new]], np.add.reduceat(n[order], new), window)
        bits = [np.packbits(f).tobytes() if f.any() else None for f in found]
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(order)))
        given = table.select(["chunk", "key", "hash"]).append_column("width", pa.array(np.full(len(order), -1), pa.int32()))
        answered = given.append_column("bits", pa.array(bits, pa.binary()).take(pa.array(which)))
        return answered.filter(answered.column("bits").is_valid())

    tasks = max(1, size // chunk_bytes)
    compared = offers.groupBy(F.pmod("key", F.lit(tasks))).applyInArrow(compare, "chunk long, key long, hash long, width int, bits binary")

    def finish(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        chunk = Chunk(table, window, anchor)
        whole, pieces = chunk.compared(*given_marks(given))
        answered = given.filter(given.column("bits").is_valid())
        starts = np.concatenate((ragged(whole.first, whole.last - whole.first + 1), _answered(pieces, answered)))
        return _cut(chunk, starts)

    return chunked.groupBy("chunk").cogroup(answers.unionByName(compared).groupBy("chunk")).applyInArrow(finish, RESULT)


def _answered(pieces: Pieces, given: pa.Table) -> np.ndarray:
    """The starts of repeated windows of the pieces, out of one bit per window of each different piece."""
    if not given.num_rows or not len(pieces.key):
        return np.empty(0, np.int64)
    key, hashed = (given.column(c).to_numpy().view(_U) for c in ("key", "hash"))
    order = np.lexsort((hashed, key))
    code, wanted = (np.rec.fromarrays(x, names="key,hash") for x in ((key[order], hashed[order]), (pieces.key, pieces.hash)))
    near = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
    hit = np.flatnonzero(code[near] == wanted)
    row = order[near[hit]]
    data = [np.frombuffer(b, np.uint8) for b in given.column("bits").to_pylist()]
    first_bit = 8 * np.cumsum([0, *map(len, data)])
    bits = np.unpackbits(np.concatenate(data)).astype(bool)
    size = pieces.last[hit] - pieces.first[hit] + 1
    return ragged(pieces.first[hit], size)[bits[ragged(first_bit[row], size)]]


def _cut(chunk: Chunk, starts: np.ndarray) -> pa.Table:
    """The chunk's documents without the windows at these starts."""
    cover = np.zeros(len(chunk.raw) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.subtract.at(cover, starts + chunk.window, 1)
    gone = np.cumsum(cover[:-1]) > 0
    offset = chunk.offset
    kept = chunk.raw[~gone].tobytes()
    kept_at = np.concatenate(([0], np.cumsum(~gone)))[offset]
    # A run ends with its document.
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1]
    ends[:-1] &= ~gone[1:]
    inner = offset[(offset > 0) & (offset < len(gone))]
    begins[inner], ends[inner - 1] = gone[inner], gone[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    run_at = np.searchsorted(first, offset)
    base = np.repeat(offset[:-1], np.diff(run_at))
    runs = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], ["first", "last"])
    return pa.table([
        pa.array(chunk.given, pa.int64()), pa.array(np.diff(offset), pa.int64()),
        pa.array([kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)], pa.binary()),
        pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), runs),
    ], names=["doc_id", "n_bytes", "kept", "removed"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns out of ``remove_repeats``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
