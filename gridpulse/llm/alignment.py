"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, over a whole corpus.

A text is cut twice into tokens, A by a byte-level BPE and B by a sentence-piece model. Both cover the same bytes.
Tokens are nodes, and a token overlaps those of the other side that share a byte with it. A group is a connected
component: the stretch between two places at which both sides end.

Groups come from pointer jumping. Every token points to its farthest-right overlapping token, which is the token of the
other side that holds its last byte; one that ends there too is the component's end, and the A token of such a
pair points to itself. Doubling the successors (``next = next[next]``) of all tokens of a batch at once reaches every
component's terminal token in as many rounds as the logarithm of the longest chain; the terminal labels the group.

Neither side has a token that goes from a letter or sign over into a space, so both sides end before every space that follows one,
and no group spans such a place. A text is therefore cut there, and each distinct stretch is aligned once a process
while it is remembered; a text's groups are its stretches' groups in turn. Where a piece model has tokens across
spaces, and for stretches that it rewrites, texts are aligned whole.

The tokens of a link are those that end together, so a group has one. Corpus-wide counts of linked id pairs are plain
groupings: a block of documents (about ``block_bytes`` of text) keeps its distinct pairs once, with counts, and its
documents refer to them by place, so a pair in every document is one row per block. The totals go back to the blocks by
a join on the pair, and a block's totals meet its documents' references in one group per block.

Defined cases: null and empty texts, and texts whose joined tokens differ from a space and the text (characters that
the piece model rewrites, such as U+2581), have no tokens: zeros and an empty digest. Texts of any length are read
whole; repeated rows count each; a null doc_id is kept; equal counts are all best; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready
from gridpulse.llm.text import blocks
from gridpulse.session import stage_table

BLOCK_BYTES, STEP_BYTES = 4 << 20, 1 << 19
# Stretches a process remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
# Splits a text before the byte-level merges; the default of byte-level BPE files, which name it only by "use_regex".
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A row is a document, or (doc_id null, counts given) the pairs of its block.
ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "refs binary, pairs array<long>, counts array<long>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side(NamedTuple):
    """What a tokenizer is here: texts to ids, and the bytes of every id."""

    encode: object
    token: list[bytes]
    length: np.ndarray


def byte_side(path: str) -> Side:
    """A byte-level BPE file. Ids follow the order of merges, so they serve as merge ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    letters = byte_letters()
    special = {t["id"] for t in given["added_tokens"]}
    vocabulary = {i: bytes(letters[c] for c in t) for t, i in given["model"]["vocab"].items() if i not in special}
    fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={t: i for i, t in vocabulary.items()}, special_tokens={})
    slow = []

    def one(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as failed:  # the pattern engine gives up on extremely long runs by a panic
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if not slow:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            slow.append(tokenizer)
        return slow[0].encode(text, add_special_tokens=False).ids

    token = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
    return Side(lambda texts: [one(" " + t) for t in texts], token, np.array([len(t) for t in token]))


def piece_side(path: str) -> Side:
    """A sentence-piece model with byte fallback; it puts the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            return b""
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    token = [of(i) for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), token, np.array([len(t) for t in token]))


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Per token, A tokens first, the terminal token of its component. Ends ascend and both sides cover the same bytes."""
    over_a = np.searchsorted(b_end, a_end)  # the B token with the last byte of each A token
    over_b = np.searchsorted(a_end, b_end)
    n = len(a_end)
    onward = np.concatenate((np.where(b_end[over_a] == a_end, np.arange(n), n + over_a), over_b))
    while True:
        further = onward[onward]
        if np.array_equal(further, onward):
            return onward
        onward = further


class Aligned(NamedTuple):
    """The tokens and groups of a batch: documents i has A tokens a_at[i]:a_at[i+1], and so on."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    links: np.ndarray  # (A token, B token) of each group's end
    link_at: np.ndarray
    label: np.ndarray  # the group's number, per A token and then per B token


def align_joined(texts: list[str], a: Side, b: Side) -> Aligned | None:
    """`align` of stretches that none of a space's tokens goes beyond, as one text; None if a side rewrites any of it."""
    text = " ".join(texts)
    ids_a, ids_b = np.array(a.encode([text])[0], np.int64), np.array(b.encode([text])[0], np.int64)
    whole = b" " + text.encode()
    if b"".join(map(a.token.__getitem__, ids_a.tolist())) != whole or b"".join(map(b.token.__getitem__, ids_b.tolist())) != whole:
        return None
    bounds = np.cumsum([0, *[len(t.encode()) + 1 for t in texts]])
    a_end, b_end = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    return _labelled(ids_a, ids_b, np.searchsorted(a_end, bounds, "right"), np.searchsorted(b_end, bounds, "right"), a_end, b_end)


def align(texts: list[str], a: Side, b: Side) -> Aligned:
    """Token ids and groups of some texts; a text without a common covering has none."""
    rows_a, rows_b = a.encode(texts), b.encode(texts)
    for i, text in enumerate(texts):
        whole = b" " + text.encode()
        if b"".join([b.token[t] for t in rows_b[i]]) != whole or b"".join([a.token[t] for t in rows_a[i]]) != whole:
            rows_a[i], rows_b[i] = [], []
    ids_a, ids_b = (np.array([t for row in rows for t in row], np.int64) for rows in (rows_a, rows_b))
    a_at, b_at = (np.cumsum([0, *map(len, rows)]) for rows in (rows_a, rows_b))
    return _labelled(ids_a, ids_b, a_at, b_at, np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b]))


def _labelled(
    ids_a: np.ndarray, ids_b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, a_end: np.ndarray, b_end: np.ndarray,
) -> Aligned:
    ends = terminals(a_end, b_end) if len(ids_a) else np.empty(0, np.int64)
    last = np.flatnonzero(ends[:len(ids_a)] == np.arange(len(ids_a)))
    links = np.column_stack((last, np.searchsorted(b_end, a_end[last])))
    return Aligned(ids_a, ids_b, a_at, b_at, links, np.searchsorted(last, a_at), np.searchsorted(last, ends))


_SHOWN: list[bytes] = []


def shown_ids(most: int) -> list[bytes]:
    """Every id below ``most`` in decimal with what may follow it: an id of the same side, the other side, a group, nothing."""
    for i in range(len(_SHOWN) // 4, most):
        _SHOWN.extend(f"{i}{after}".encode() for after in (",", "|", ";", ""))
    return _SHOWN


def group_texts(found: Aligned) -> list[bytes]:
    """Per text the ids of its groups, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    n = len(found.a)
    side = np.repeat([0, 1], [n, len(found.b)])
    order = np.lexsort((side, found.label))
    ids, label, side = np.concatenate((found.a, found.b))[order], found.label[order], side[order]
    after = np.where(np.diff(label, append=-1) != 0, 2, np.where(np.diff(side, append=-1) != 0, 1, 0))
    cut = found.a_at + found.b_at
    after[cut[1:][cut[1:] > cut[:-1]] - 1] = 3
    shown = list(map(shown_ids(int(ids.max(initial=-1)) + 1).__getitem__, (4 * ids + after).tolist()))
    ends = cut.tolist()
    return [b"".join(shown[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


# White space before a space, or at either end.
_RUN = re.compile(r"\s |^\s|\s$")


def stretches(text: str) -> list[str]:
    """A space and the text, cut before each space that follows something else; without the leading spaces."""
    if not _RUN.search(text):
        return text.split(" ")
    out, held = [], None
    for part in text.split(" "):
        if held is not None:
            part = f"{held} {part}"
        if not part or part[-1].isspace():
            held = part
        else:
            out.append(part)
            held = None
    return out if held is None else [*out, held]


class Known:
    """What a process knows of stretches: their numbers of tokens and links, link codes, and group texts."""

    def __init__(self, a: Side, b: Side, cuttable: bool | None = None):
        self.a, self.b, self.base = a, b, len(b.token)
        # A piece of other characters and a later space would cross a cut.
        self.cuttable = not any(b" " in t.lstrip(b" ") for t in b.token) if cuttable is None else cuttable
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.codes: list[bytes] = []
        self.groups: list[bytes] = []

    def learn(self, texts: list[str], joined: bool = False) -> None:
        """Remember these; ``joined`` if each begins after a space and ends in something else."""
        found = align_joined(texts, self.a, self.b) if joined and texts else None
        if found is None:
            found = align(texts, self.a, self.b)
        n = len(self.n_a)
        codes = (found.a[found.links[:, 0]] * self.base + found.b[found.links[:, 1]]).astype("<i8").tobytes()
        ends = (8 * found.link_at).tolist()
        self.n_a += np.diff(found.a_at).tolist()
        self.n_b += np.diff(found.b_at).tolist()
        self.codes += [codes[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        groups = group_texts(found)
        self.groups += groups
        # Without tokens: to be aligned as part of the whole text.
        self.at.update(zip(texts, [k if g else -1 for k, g in enumerate(groups, n)], strict=True))

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, bytes, str]]:
        """Per text: A tokens, B tokens, links, their codes, the digest of the groups."""
        parts = [stretches(t) if t and self.cuttable else [] for t in texts]
        new = set().union(*parts).difference(self.at)
        odd = [p for p in new if not p or p[-1].isspace()]
        self.learn(odd)
        self.learn([p for p in new if p and not p[-1].isspace()], joined=True)
        rows = [list(map(self.at.__getitem__, row)) for row in parts]
        whole = [i for i, row in enumerate(rows) if texts[i] and (not row or -1 in row)]
        alone = Known(self.a, self.b, self.cuttable)
        alone.learn([texts[i] for i in whole])
        place = dict(zip(whole, range(len(whole)), strict=True))
        for i, row in enumerate(rows):
            source, row = (alone, [place[i]]) if i in place else (self, row)
            groups = b";".join(map(source.groups.__getitem__, row))
            codes = b"".join(map(source.codes.__getitem__, row))
            yield (sum(map(source.n_a.__getitem__, row)), sum(map(source.n_b.__getitem__, row)), len(codes) // 8, codes,
                   hashlib.sha256(groups).hexdigest() if groups else "")
        if len(self.at) > REMEMBERED:
            self.forget()
        for p in new:
            if len(p) > LONGEST and p in self.at:
                k = self.at.pop(p)
                self.codes[k] = self.groups[k] = b""


_KNOWN: dict[tuple[str, str], Known] = {}


def known(a_path: str, b_path: str) -> Known:
    """What this process knows of two tokenizers, kept for all tasks of the process."""
    if (a_path, b_path) not in _KNOWN:
        _KNOWN[a_path, b_path] = Known(byte_side(a_path), piece_side(b_path))
    return _KNOWN[a_path, b_path]


def align_documents(documents: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its counts, digest and references to its block's distinct pairs; per block a row with those pairs."""
    ready(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = known(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, held in blocks((t.encode() for t in texts), block_bytes):
                yield _block_rows(block, ids[first:first + len(held)], texts[first:first + len(held)], memory)
                block += 1

    return source.mapInArrow(each, ALIGNED)


def _block_rows(block: int, ids: list, texts: list[str], memory: Known) -> pa.RecordBatch:
    rows = []
    # Lists of ids and their texts take many times the room of a text, so few documents at a time.
    for first, held in blocks((t.encode() for t in texts), STEP_BYTES):
        rows += memory.documents(texts[first:first + len(held)])
    n_a, n_b, n_links, codes, digests = zip(*rows, strict=True)
    pairs, ref, counts = np.unique(np.frombuffer(b"".join(codes), "<i8"), return_inverse=True, return_counts=True)
    n, ref, ends = len(ids), ref.astype("<u4"), np.cumsum(n_links)
    refs = [ref[y - k:y].tobytes() for y, k in zip(ends.tolist(), n_links, strict=True)]

    def one_list(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([None] * n + [0, len(values)], pa.int32()), pa.array(values, pa.int64()))

    return pa.RecordBatch.from_arrays([
        pa.array([block] * (n + 1), pa.int64()), pa.array([*ids, None], pa.int64()),
        *[pa.array([*x, 0], pa.int64()) for x in (n_a, n_b, n_links, n_links)], pa.array([*digests, ""]),
        pa.array([*refs, None], pa.binary()), one_list(pairs), one_list(counts),
    ], names=[c.split()[0] for c in ALIGNED.split(", ")])


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """Every linked id pair of the corpus: pair, links, and whether its B id has no pair with more."""
    counted = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = counted.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("links"))
    # One row per pair of ids: at most one vocabulary's size of rows for a B id.
    most = totals.groupBy(F.pmod("pair", F.lit(base)).alias("b")).agg(F.max("links").alias("most"))
    return totals.withColumn("b", F.pmod("pair", F.lit(base))).join(most, "b").select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_corpus(documents: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens, groups and links, how many links are their B id's best, the links' counts summed, the digest."""
    aligned = stage_table(align_documents(documents, a_path, b_path, block_bytes), "aligned")
    base = known(a_path, b_path).base
    totals = stage_table(pair_counts(aligned, base), "pairs")
    placed = aligned.where("pairs IS NOT NULL").select(
        F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    answers = placed.join(totals, "pair").select("of_block", "place", "links", "best")

    def finish(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        place = given.column("place").to_numpy()
        links, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        links[place], best[place] = given.column("links").to_numpy(), given.column("best").to_numpy()
        refs = [np.frombuffer(r, "<u4") for r in table.column("refs").to_pylist()]
        return table.drop_columns(["block", "refs", "groups_sha256"]).append_column(
            "n_best", pa.array([int(best[r].sum()) for r in refs], pa.int64())).append_column(
            "count_sum", pa.array([int(links[r].sum()) for r in refs], pa.int64())).append_column(
            "groups_sha256", table.column("groups_sha256"))

    kept = aligned.where("pairs IS NULL").drop("pairs", "counts")
    return kept.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(finish, RESULT)
