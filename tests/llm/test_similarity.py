"""SimHash and the Jaccard join against brute force on small frames."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np

from gridpulse.llm import jaccard, simhash
from gridpulse.llm.text import LETTERS_AND_DIGITS, gram_hashes, inside, words
from tests.llm.test_text_passes import prose, words_of

ROW = "doc_id long, text string, component long, node long"


def frame_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], ROW)


def test_gram_hashes_tell_word_runs_apart():
    texts = [b"a b c d e f g", b"", b"b c d e f", b" a  b ", b"c,B,c,d"]
    block = words(texts, LETTERS_AND_DIGITS)
    split = [words_of(t.decode()) for t in texts]
    assert list(np.diff(block.offset)) == [len(s) for s in split]
    flat = [w for s in split for w in s]
    for n in range(1, 8):
        grams = gram_hashes(block.hash, n)
        keys = [tuple(flat[i:i + n]) for i in range(len(flat) - n + 1)]
        assert len(grams) == len(keys) and len(set(grams.tolist())) == len(set(keys))
        assert len(set(zip(grams.tolist(), keys, strict=True))) == len(set(keys))
        starts = np.cumsum([0, *map(len, split)])
        owner = [int(np.searchsorted(starts, i, "right")) for i in range(len(flat))]
        assert inside(block.offset, n, len(grams)).tolist() == [owner[i] == owner[i + n - 1] for i in range(len(keys))]


def shingles(text):
    w = words_of(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def links_by_hand(rows):
    """class_id, copy_of and n_links of each id; rows of one id are one document."""
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None and shingles(t):
            sets[d].add(shingles(t))
    by_set = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            by_set[s].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    count = defaultdict(int)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                count[a] += 1
                count[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = []
    for d, t in rows:
        s = shingles(t)
        if d is None or not s:
            out.append((d, d, d, 0))
        else:
            out.append((d, find(d), by_set[s][0], count[d]))
    return out


def near_copies(rng, vocabulary, n, size=60, changes=3):
    base = [rng.choice(vocabulary) + str(rng.randrange(99)) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        texts += near_copies(rng, vocabulary, rng.randint(1, 6))
    texts += near_copies(rng, vocabulary, 70, 80, 6) + ["one two", "One, two!", "one", "", None, "..."]
    texts += texts[:5]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [*zip(order, texts, strict=True), (None, texts[0]), (None, None)]
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)  # several block pairs in the large group
    got = sorted((tuple(r) for r in jaccard.link_documents(frame_of(spark, rows)).collect()), key=repr)
    assert got == sorted(links_by_hand(rows), key=repr)
    kept = jaccard.one_per_group(frame_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "component", "node"]
    want = [d for d, c, _, _ in links_by_hand(rows) if d == c]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z u v w")]
    got = sorted(tuple(r) for r in jaccard.link_documents(frame_of(spark, rows)).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 0)]
    assert jaccard.link_documents(frame_of(spark, rows).limit(0)).count() == 0
    assert jaccard.one_per_group(frame_of(spark, rows).limit(0)).count() == 0
    clashing = frame_of(spark, rows).withColumnsRenamed({"component": "dropped", "node": "forest"})
    assert sorted(r.doc_id for r in jaccard.one_per_group(clashing).collect()) == [1, 1, 3]


def test_components_follow_long_chains(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rng.shuffle(edges)
    found = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == root and len(found) == len(root)


def test_prefix_depth_reaches_the_target():
    depth = jaccard.prefix_depth(0.8, 32, 8, 0.99999)
    chance = lambda k: 1 - (1 - 0.8**k) ** 32
    assert chance(depth) >= 0.99999 > chance(depth + 1)


def test_simhash_edits_by_hand(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_IDS", 7)  # several id ranges
    rng = random.Random(9)
    vocabulary = [f"w{k}é" for k in range(200)]
    ids = rng.sample(range(-50, 10**6), 60)
    texts = {d: prose(rng, vocabulary, rng.randint(0, 60)) for d in ids}
    texts |= {ids[0]: None, ids[1]: "", ids[2]: "\U0001F600 x y", ids[3]: " \n ", ids[5]: texts[ids[4]]}
    rows = [*texts.items(), (ids[4], texts[ids[4]]), (None, "no id here")]
    got = simhash.fingerprint_documents(frame_of(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(ids, reverse=True)
    prints = {r.doc_id: r for r in got}
    for k, d in enumerate(order):
        text, following = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = prints[d]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        near = 1 - bin(int(row.fingerprint, 16) ^ int(prints[order[(k + 1) % len(order)]].fingerprint, 16)).count("1") / 128
        assert abs(row.near_next - near) < 1e-12
        assert abs(row.near_edited - (1 - bin(int(row.fingerprint, 16) ^ int(row.edited_fingerprint, 16)).count("1") / 128)) < 1e-12
        if edited == text:
            assert row.near_edited == 1
    assert prints[ids[4]].fingerprint == prints[ids[5]].fingerprint and prints[ids[1]].fingerprint == "0" * 32
    assert simhash.fingerprint_documents(frame_of(spark, rows).limit(0)).count() == 0
    (alone,) = simhash.fingerprint_documents(frame_of(spark, [(1, "abcdef")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1


def test_votes_equal_a_count_by_hand(spark):
    text = "alpha beta beta gamma-delta x"
    terms = text.split()
    df = frame_of(spark, [(1, text)])
    (row,) = simhash.vote(df.select("doc_id", "text"), ["doc_id"]).collect()
    hashed = {r.t: (r.a, r.b) for r in spark.createDataFrame([(t,) for t in terms], "t string").selectExpr("t", "xxhash64(t, 0) a", "xxhash64(t, 1) b").collect()}
    for k in range(2):
        want = 0
        for bit in range(64):
            votes = sum(len(t) for t in terms if hashed[t][k] >> bit & 1)
            want |= (2 * votes > sum(map(len, terms))) << bit
        assert (row.fp0, row.fp1)[k] % (1 << 64) == want


def test_fingerprints_within_a_radius(spark):
    rng = random.Random(10)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), n)) for v in values[:20] for n in (1, 3, 4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.within_radius(spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fp long"), 3).collect()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3}
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_fingerprints_of_two_words_within_a_radius(spark):
    rng = random.Random(11)
    values = [rng.getrandbits(128) for _ in range(30)] + [0, 1, (1 << 128) - 1, 1 << 64]
    values += [v ^ sum(1 << b for b in rng.sample(range(128), n)) for v in values[:20] for n in (1, 2, 3, 3, 4)]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    rows = [(signed(v % (1 << 64)), signed(v >> 64)) for v in values]
    df = spark.createDataFrame([*rows, rows[0], (None, 1)], "x long, y long")
    for radius in (1, 2, 3, 4):
        near = {(p, q): bin(v ^ w).count("1") for p, v in zip(rows, values, strict=True) for q, w in zip(rows, values, strict=True) if v != w}
        near = {pair: d for pair, d in near.items() if d <= radius}
        found = simhash.within_radius(df, radius, ("x", "y")).collect()
        assert {((r.a0, r.a1), (r.b0, r.b1)): r.distance for r in found} == {(p, q): d for (p, q), d in near.items() if p < q}
        assert len(found) == sum(p < q for p, q in near)
        counts = {(r.x, r.y): r.n_near for r in simhash.near_counts(df, radius, ("x", "y")).collect()}
        assert counts == {p: sum(a == p for a, _ in near) for p in {a for a, _ in near}}


def test_documents_have_their_near_fingerprints(spark):
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(300)]
    texts = [t for _ in range(10) for t in near_copies(rng, vocabulary, 8, 400, 4)] + [None, "", "one"]
    rows = [*enumerate(texts), (1000, texts[0]), (None, texts[1])]
    got = simhash.fingerprint_documents(frame_of(spark, rows)).collect()
    prints = {int(r.fingerprint, 16) for r in got}
    assert len(got) == len(rows) and any(r.n_near for r in got)
    for r in got:
        assert r.n_near == sum(0 < bin(int(r.fingerprint, 16) ^ p).count("1") <= simhash.RADIUS for p in prints)
