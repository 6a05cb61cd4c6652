"""Suffix arrays and the removal of repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridpulse.llm import repeats
from gridpulse.llm.suffixes import suffix_arrays

DOCS = "doc_id long, text string, chunk string, key long"


def plain(texts, window):
    """Per text: bytes, bytes removed, spans, hash of what stays."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k:k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - window + 1):
            if count[d[k:k + window]] > 1:
                gone[k:k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def run(spark, texts, ids=None, **options):
    rows = [(k if ids is None else ids[k], t, "clash", k) for k, t in enumerate(texts)]
    return [tuple(r) for r in repeats.digest(repeats.remove_repeats(spark.createDataFrame(rows, DOCS), **options)).collect()]


def by_text(texts, want, ids=None):
    return sorted((((k if ids is None else ids[k]), *w) for k, w in enumerate(want)), key=str)


def text(rng, n, letters="abcdefghij é"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_suffix_arrays_equal_sorting(letters):
    rng = random.Random(letters)
    for _ in range(150):
        strings = [[rng.randrange(1, 1 + letters) for _ in range(rng.randrange(0, 40))] + [0] for _ in range(rng.randrange(1, 6))]
        strings += [strings[0][:-1] * 3 + [0]]
        start = np.cumsum([0, *map(len, strings)])[:-1]
        got = suffix_arrays(np.concatenate(strings), start)
        for s, at in zip(strings, start):
            assert (got[at:at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


def near_copies(rng):
    base = text(rng, 900)
    line = text(rng, 150)
    texts = [base[:a] + text(rng, rng.randrange(0, 30)) + base[a + rng.randrange(0, 30):] for a in (rng.randrange(900) for _ in range(12))]
    texts += [text(rng, 200) + line + text(rng, 200) for _ in range(12)]
    texts += [None, "", "a", "x" * 40, "x" * 41, "y" * 1500, "ab" * 400, base, base, text(rng, 39), base[100:141], "é" * 300, text(rng, 3000)]
    return texts


@pytest.mark.parametrize("many, very_many, narrow", [(64, 65536, 17), (2, 65536, 5), (2, 4, 5), (1, 1, 17)])
def test_equals_brute_force(spark, many, very_many, narrow):
    texts = near_copies(random.Random(many + narrow))
    want = by_text(texts, plain(texts, 40))
    for size in (700, 8 << 20):
        got = run(spark, texts, window=40, anchor=16, chunk_bytes=size, many=many, very_many=very_many, narrow=narrow)
        assert sorted(got, key=str) == want


def test_production_window_and_slices(spark, monkeypatch):
    rng = random.Random(6)
    base = text(rng, 2000)
    texts = [base, text(rng, 300) + base[500:1100] + text(rng, 300), base[:199], base[1800:], base[700:900], base[0:200] + base[0:201]]
    want = by_text(texts, plain(texts, 200))
    assert sorted(run(spark, texts), key=str) == want
    import pyarrow as pa

    monkeypatch.setattr(repeats, "SLICE", 333)
    chunk = repeats.Chunk(pa.table({"doc_id": list(range(len(texts))), "text": texts}), 200, 64)
    whole = repeats.joined([s.segments._replace(first=s.segments.first + a, last=s.segments.last + a) for a, s in chunk.slices()])
    covered = repeats.ragged(whole.first, whole.last - whole.first + 1)
    valid = [o + k for o, t in zip(chunk.offset, texts) for k in range(len(t.encode()) - 199)]
    assert sorted(covered.tolist()) == valid


def test_ids_without_meaning_and_long_texts(spark):
    rng = random.Random(9)
    shared = text(rng, 500)
    texts = [shared + "1", shared + "2", shared, text(rng, 900), None, text(rng, 400_000) + shared]
    ids = [None, None, 7, 7, 7, 1 << 62]
    assert sorted(run(spark, texts, ids, chunk_bytes=2000), key=str) == by_text(texts, plain(texts, 200), ids)


def test_one_id_on_half_of_the_rows_is_spread(spark):
    rng = random.Random(3)
    texts = [text(rng, 210) for _ in range(300)]
    found = repeats.remove_repeats(spark.createDataFrame([(5, t, "", 0) for t in texts], DOCS), chunk_bytes=4000)
    assert {len(r.kept) == r.n_bytes for r in found.collect()} == {True} and found.count() == 300


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [None, ""]) and repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
