"""Substring dedup: remove words of passages that an earlier document already has.

Level-wise doubling. Level lengths double up to the window (7 and 13 words by default; the last
doubling stops at the window). At a level every window still alive is represented by one of its
stretches of that length, the one with the smallest hash, so neighbouring windows share theirs; only
windows whose stretch occurs in a second document go on to twice the length. At the last length the
stretch is the window itself, and the smallest document id that holds it decides.

Spark's part: documents are hashed into chunks of about ``chunk_bytes`` of text. A chunk sends, per
level, its distinct stretch hashes as packed sorted arrays, divided by hash range; a range compares the arrays of
all chunks and answers each chunk with one bit per hash. A hash held by a third of all documents is
still one entry per chunk. The text is shuffled once: all levels read the same exchange.

Hashes have 64 bits per level; a window must agree on every level's hash, so a false repeat needs independent collisions.

Defined cases: null and wordless texts have no words and stay as they are; texts of fewer words than a
window lose nothing; rows with equal doc_id do not count as earlier than one another; a row without
doc_id counts as later than all others; repeated rows are judged alike; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready
from gridpulse.llm.text import WHITE_SPACE, Words, as_bytes, blocks, gram_hashes, inside, words

LATEST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, kept string, removed array<struct<first:int,last:int>>"
_U = np.uint64


def level_lengths(window: int, shortest: int = 7) -> list[int]:
    """Lengths that double up to the window, none below ``shortest`` unless the window is."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest of each ``width`` consecutive values, the first of equals; by doubling."""
    at, span = np.arange(len(values)), 1
    while span < width:
        hop = min(span, width - span)
        left, right = at[:len(at) - hop], at[hop:]
        at = np.where(values[right] < values[left], right, left)
        span += hop
    return at


def level_view(block: Words, alive: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows alive and, for each, the hash of the stretch that represents it at this length."""
    grams = gram_hashes(block.hash, length)
    at = np.flatnonzero(alive)
    return at, grams[at] if length == window else grams[sliding_argmin(grams, window - length + 1)[at]]


class Chunk:
    """The documents of one chunk, replayed up to a level with the answers of the levels before."""

    def __init__(self, table: pa.Table, window: int, lengths: list[int]):
        self.ids = np.array([LATEST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        self.given = table.column("doc_id").to_pylist()
        self.texts = as_bytes(table.column("text").combine_chunks())
        self.window, self.lengths = window, lengths
        self.blocks = []
        for first, texts in blocks(self.texts):
            block = words(texts, WHITE_SPACE)
            n = len(block.hash) - window + 1
            self.blocks.append((first, block, inside(block.offset, window, n)))

    def owners(self, first: int, block: Words, at: np.ndarray) -> np.ndarray:
        return self.ids[first + np.searchsorted(block.offset, at, "right") - 1]

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes of a level, sorted, with the smallest and the largest document id of each."""
        found, ids = [np.empty(0, _U)], [np.empty(0, np.int64)]
        for first, block, alive in self.blocks:
            if alive.any():
                at, grams = level_view(block, alive, self.lengths[level], self.window)
                found.append(grams)
                ids.append(self.owners(first, block, at))
        grams, owner = np.concatenate(found), np.concatenate(ids)
        order = np.lexsort((owner, grams)) if level == len(self.lengths) - 1 else np.argsort(grams)
        grams, owner = grams[order], owner[order]
        head = np.flatnonzero(np.diff(grams, prepend=grams[:1] ^ _U(1)) != 0) if len(grams) else np.empty(0, np.int64)
        if not len(head):
            return grams, owner, owner
        return grams[head], np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)

    def apply(self, level: int, bits: np.ndarray) -> None:
        """Keep the windows whose stretch occurs in another document."""
        keys, low, high = self.keys(level)
        hit = keys[bits | (low != high)]
        for i, (first, block, alive) in enumerate(self.blocks):
            if alive.any():
                at, grams = level_view(block, alive, self.lengths[level], self.window)
                kept = np.zeros(len(alive), bool)
                kept[at[member(grams, hit)]] = True
                self.blocks[i] = (first, block, kept)

    def covered(self, bits: np.ndarray) -> list[np.ndarray]:
        """Per block, which words lie in a window that starts in an earlier document."""
        last = len(self.lengths) - 1
        keys, low, _ = self.keys(last)
        least = np.where(bits, np.iinfo(np.int64).min, low)
        out = []
        for first, block, alive in self.blocks:
            cover = np.zeros(len(block.hash) + 1, np.int64)
            if alive.any() and len(keys):
                at, grams = level_view(block, alive, self.window, self.window)
                repeated = at[least[np.searchsorted(keys, grams)] < self.owners(first, block, at)]
                np.add.at(cover, repeated, 1)
                np.subtract.at(cover, repeated + self.window, 1)
            out.append(np.cumsum(cover[:-1]) > 0)
        return out


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def unpack(answers: pa.Table, level: int, sizes: np.ndarray) -> np.ndarray:
    """The answer bits of a level, in the order of the chunk's sorted hashes. sizes: hashes per range."""
    columns = (answers.column(c).to_pylist() for c in ("part", "level", "bits"))
    by_range = {p: bits for p, v, bits in zip(*columns, strict=True) if v == level}
    return np.concatenate([np.empty(0, bool), *[
        np.unpackbits(np.frombuffer(by_range[p], np.uint8), count=n).astype(bool) for p, n in enumerate(sizes) if n
    ]])


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """How many of the sorted hashes fall into each of the equal hash ranges."""
    cuts = np.array([(p << 64) // parts for p in range(1, parts)], _U)
    return np.diff(np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)])))


def replay(table: pa.Table, answers: pa.Table | None, window: int, lengths: list[int], level: int, parts: int) -> Chunk:
    """The chunk as the answers of the levels before ``level`` leave it."""
    chunk = Chunk(table, window, lengths)
    for k in range(level):
        chunk.apply(k, unpack(answers, k, ranges(chunk.keys(k)[0], parts)))
    return chunk


def dedup_passages(documents: DataFrame, window: int = 13, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, its number of words, the kept words joined by a space, and the removed word ranges."""
    spark = ready(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, chunks // 2)
    lengths = level_lengths(window)
    # Chunks go by id and text, so that one id on very many rows is no chunk of its own.
    chunked = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)))
    answers = None
    for level in range(len(lengths)):
        answers = _answer(chunked, answers, window, lengths, level, parts)
    last = len(lengths) - 1

    def finish(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        chunk = replay(table, given, window, lengths, last, parts)
        cover = chunk.covered(unpack(given, last, ranges(chunk.keys(last)[0], parts)))
        counts, kept, removed = [], [], []
        for (_, block, _), gone in zip(chunk.blocks, cover, strict=True):
            for a, b in zip(block.offset[:-1], block.offset[1:], strict=True):
                counts.append(int(b - a))
                own = gone[a:b]
                edge = np.diff(own.astype(np.int8), prepend=0, append=0)
                removed.append([
                    {"first": int(x), "last": int(y)}
                    for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                ])
                left = block.buffer[block.start[a]:block.end[b - 1]].split() if b > a else []
                kept.append(b" ".join(w for w, x in zip(left, own, strict=True) if not x) if own.any() else b" ".join(left))
        return pa.table([
            pa.array(chunk.given, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ], names=["doc_id", "n_words", "kept", "removed"])

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, RESULT)


def _answer(chunked: DataFrame, answers: DataFrame | None, window: int, lengths: list[int], level: int, parts: int) -> DataFrame:
    """The answers of the levels so far: (chunk, part, level, bits)."""
    last = level == len(lengths) - 1

    def offer(table: pa.Table, given: pa.Table | None, chunk_id: int) -> pa.Table:
        chunk = replay(table, given, window, lengths, level, parts)
        keys, low, _ = chunk.keys(level)
        rows, at = [], 0
        for p, n in enumerate(ranges(keys, parts)):
            if n:
                rows.append((p, keys[at:at + n].tobytes(), low[at:at + n].tobytes() if last else b""))
            at += n
        return pa.table([
            pa.array([chunk_id] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
        ], names=["chunk", "part", "keys", "low"])

    offered = "chunk long, part long, keys binary, low binary"
    if answers is None:
        offers = chunked.groupBy("chunk").applyInArrow(lambda key, t: offer(t, None, key[0].as_py()), offered)
    else:
        offers = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            lambda key, t, given: offer(t, given, key[0].as_py()), offered)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys = [np.frombuffer(k, _U) for k in table.column("keys").to_pylist()]
        joined = np.concatenate(keys)
        if last:
            low = np.concatenate([np.frombuffer(k, np.int64) for k in table.column("low").to_pylist()])
            order = np.argsort(joined)
            head = np.flatnonzero(np.diff(joined[order], prepend=joined[order][:1] ^ _U(1)) != 0)
            least = np.repeat(np.minimum.reduceat(low[order], head), np.diff(head, append=len(order)))
            flag = np.empty(len(joined), bool)
            flag[order] = least < low[order]
        else:
            order = np.argsort(joined)
            ordered = joined[order]
            same = ordered[1:] == ordered[:-1]
            flag = np.zeros(len(joined), bool)
            flag[order[1:][same]] = True
            flag[order[:-1][same]] = True
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(f).tobytes() for f in np.split(flag, ends[:-1])]
        n = table.num_rows
        return pa.table([
            table.column("chunk"), pa.array([part] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(bits, pa.binary()),
        ], names=["chunk", "part", "level", "bits"])

    new = offers.groupBy("part").applyInArrow(compare, "chunk long, part long, level int, bits binary")
    return new if answers is None else answers.unionByName(new)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns out of ``dedup_passages``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + (r["last"] - r["first"]).cast("long"))
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
