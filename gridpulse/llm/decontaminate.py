"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

A text is normalised by a byte table (A-Z lower-cased, other separators to spaces) and its words
are joined by single spaces. A pattern is ten consecutive item words between spaces, or all words
of a shorter item. Matches are found in the normalised text and mapped back to word numbers and,
through the kept byte offsets, to character spans of the original.

The automaton is bounded: patterns come in blocks of ``block_bytes`` of pattern text, one for any usual
benchmark. Driver and executors hold one block at a time; each further block is another pass over what the
one before wrote.

Defined cases: null or wordless texts have no words and no hits; items with a null or wordless text have no
windows; items without an id hit like any other and all together count as one item, which items_sha256 leaves out;
items with equal windows all count; repeated rows are judged row by row; other columns of
either table are ignored; an empty item table hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready
from gridpulse.llm.text import LETTERS_AND_DIGITS, as_bytes
from gridpulse.session import stage_table

BLOCK_BYTES = 8 << 20
SPAN = ("first", "last", "start", "end")
HITS = "array<struct<first:int,last:int,start:int,end:int>>"


def item_patterns(text: bytes, window: int) -> set[bytes]:
    """The windows of one item, each with a space on either side."""
    found = text.translate(LETTERS_AND_DIGITS).split()
    if not found:
        return set()
    size = min(window, len(found))
    return {b" %b " % b" ".join(found[i:i + size]) for i in range(len(found) - size + 1)}


def build_automaton(patterns: dict[bytes, list[str | None]]):
    """The automaton of some patterns; a match yields the pattern's length and its items."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        automaton.add_word(pattern.decode("latin-1"), (len(pattern), items))
    automaton.make_automaton()
    return automaton


def scan_text(text: bytes, automaton) -> tuple[int, set[str | None], list[tuple[int, int, int, int]]]:
    """Number of words, items found, and the hit stretches as (first word, last word, start, end).

    Start and end are code points of the original text, end exclusive.
    """
    normal = text.translate(LETTERS_AND_DIGITS)
    found = normal.split()
    if not found:
        return 0, set(), []
    items: set[str | None] = set()
    spans = []
    for end, (size, own) in automaton.iter((b" %b " % b" ".join(found)).decode("latin-1")):
        items.update(own)
        spans.append((end - size + 1, end))
    if not spans:
        return len(found), items, []
    # In the joined text word w starts right after its space, at the sum of all lengths before it.
    starts = np.cumsum([1, *[len(w) + 1 for w in found]])
    cover = np.zeros(len(found) + 1, np.int64)
    for start, end in spans:
        cover[np.searchsorted(starts, start + 1)] += 1
        cover[np.searchsorted(starts, end + 1)] -= 1
    edge = np.diff((np.cumsum(cover[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    raw = np.frombuffer(normal, np.uint8)
    bounds = np.diff((raw != 0x20).astype(np.int8), prepend=0, append=0)
    first_byte, last_byte = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return len(found), items, [
        (int(a), int(b), int(points[first_byte[a]]), int(points[last_byte[b - 1]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
    ]


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[dict[bytes, list[str | None]]]:
    """The patterns with their items, some ``block_bytes`` at a time, read by row stream from the executors."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: dict[bytes, list[str | None]] = {}
    size = 0
    for row in rows.where("text is not null").toLocalIterator():
        for pattern in item_patterns(row.text.encode(), window):
            if pattern not in block:
                size += len(pattern)
            block.setdefault(pattern, []).append(row.item_id)
        if size > block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def find_items(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, the items found and the hit stretches, in order.

    ``hits`` has word numbers (last exclusive) and code points of the original (end exclusive).
    """
    spark = ready(documents.sparkSession)
    found = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.expr("0L AS n_words"), F.expr("cast(array() AS array<string>) AS items"), F.expr(f"cast(array() AS {HITS}) AS hits"))
    passes = 0
    for patterns in pattern_blocks(benchmark, window, block_bytes):
        # A further block reads what the one before wrote, so that only one automaton is held at a time.
        found = stage_table(found, "decontamination") if passes else found
        found = found.mapInArrow(_scan(spark.sparkContext.broadcast(patterns)), found.schema)
        passes += 1
    if not passes:
        found = found.mapInArrow(_scan(spark.sparkContext.broadcast({})), found.schema)
    return found.drop("text")


def _scan(patterns: Broadcast):
    """A pass over batches of (doc_id, text, n_words, items, hits) that adds one block's findings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(patterns.value) if patterns.value else None
        for batch in batches:
            counts, items, hits = [], [], []
            for text, own, spans in zip(as_bytes(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n, more, new = scan_text(text, automaton) if automaton else (len(text.translate(LETTERS_AND_DIGITS).split()), set(), [])
                counts.append(n)
                items.append(sorted({*own, *more}, key=lambda i: (i is None, i or "")))
                hits.append([dict(zip(SPAN, s, strict=True)) for s in merged([tuple(h[k] for k in SPAN) for h in spans] + new)])
            kinds = [batch.schema.field(k).type for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip((counts, items, hits), kinds, strict=True)],
            ], names=batch.schema.names)

    return scan


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping or adjoining stretches as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], end)
        else:
            out.append((a, b, start, end))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns out of ``find_items``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["last"] - h["first"]).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without the rows whose text holds a window of an item. No shuffle; a pass per block."""
    spark = ready(documents.sparkSession)
    place = documents.columns.index("text")

    def keeper(patterns: Broadcast):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(patterns.value)
            for batch in batches:
                yield batch.filter(pa.array([not scan_text(t, automaton)[2] for t in as_bytes(batch.column(place))], pa.bool_()))

        return keep

    kept = documents
    for patterns in pattern_blocks(benchmark, window, block_bytes):
        kept = kept if kept is documents else stage_table(kept, "decontamination")
        kept = kept.mapInArrow(keeper(spark.sparkContext.broadcast(patterns)), documents.schema)
    return kept
