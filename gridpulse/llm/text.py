"""Words and n-gram hashes of whole texts, vectorised over blocks of documents.

A text arrives as UTF-8 bytes. A 256-entry translation table maps every separator to a space,
so words are runs of other bytes. Words hash by a rolling polynomial over a random 64-bit code
per byte; n-grams double: the hash of 2L words combines the hashes of their two halves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

BLOCK_BYTES = 1 << 20
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)

# A-Z lower-cased; digits, a-z and everything beyond ASCII stay; the rest separates.
LETTERS_AND_DIGITS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
# Words are runs of anything but white space, unchanged.
WHITE_SPACE = bytes(0x20 if b in b"\t\n\v\f\r" else b for b in range(256))


class Words(NamedTuple):
    """The words of a block: a hash and byte range each; document i has words offset[i]:offset[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    buffer: bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two adjacent stretches out of the hashes of each; order matters."""
    return mix(left * _U(0xD6E8FEB86659FD93) + (right ^ _U(0xA5A5A5A5C3C3C3C3)) * _U(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    held = _powers.held.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, 2 * BLOCK_BYTES), base, _U)
        factors[0] = 1
        held = _powers.held[base] = np.multiply.accumulate(factors)
    return held[:n]


_powers.held = {}


def words(texts: list[bytes], table: bytes) -> Words:
    """The words of some texts at once."""
    buffer = b" ".join(texts).translate(table)
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw)
    edge = np.diff((raw != 0x20).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(n + 1, _U)
    if n:
        np.cumsum(_CODES[raw] * _powers(_STEP, n), out=prefix[1:])
    inverse = _powers(_INVERSE, n + 1)
    hashed = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U))
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return Words(hashed, start, end, np.searchsorted(start, at), buffer)


def gram_hashes(word_hash: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from every position that has so many after it.

    Built by doubling: the binary digits of ``length`` say which doubled stretches follow one another.
    """
    if len(word_hash) < length:
        return np.empty(0, _U)
    n, power, covered, out = len(word_hash) - length + 1, word_hash, 0, None
    step = 1
    while step <= length:
        if length & step:
            piece = power[covered:covered + n]
            out = piece if out is None else join_hashes(out, piece)
            covered += step
        if 2 * step <= length:
            power = join_hashes(power[:-step], power[step:])
        step *= 2
    return mix(out + _U(length))


def inside(offset: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the first ``n`` positions start a stretch of ``length`` words within one document."""
    ok = np.ones(max(n, 0), bool)
    for k in range(1, length):
        cut = offset[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def blocks(texts: Iterable[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in blocks of about ``most`` bytes, each with the index of its first text.

    A longer text is a block of its own.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
