"""Centroid clustering against a plain version, and its defined cases."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from gridpulse.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, clusters, rounds, components):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    middle = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(middle)]
    placed = [(i, *near(v)) for i, v in kept]
    total = {k: sum(d for _, d, c in placed if c == k) for k in range(len(middle))}
    return sorted(
        ((i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest())
         for i, d, k in placed), key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    got = centroids.cluster_vectors(frame, **options).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in middles[0 if k % 3 == 0 else k % 4]]) for k in range(300)]
    rows = [(i, [float(x) for x in v]) for i, v in spark.createDataFrame(rows, "i long, v array<float>").collect()]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (301, None), (302, []), (303, [1.0] * 5), (304, [1.0] * 7),
             (305, [None] * 6), (306, [float("nan")] * 6), (307, [float("inf")] * 6), (308, [-0.0] * 6), (309, [-1e-9] * 6)]
    assert run(spark, rows, clusters=5, components=6) == plain(rows, 5, 3, 6)


def test_ties_few_vectors_and_empty_clusters(spark):
    same = [(k, [0.5, -0.5]) for k in range(20)]
    assert run(spark, same, clusters=4, components=2) == plain(same, 4, 3, 2)  # all go to cluster 0, the rest stay empty
    few = [(1, [0.0, 1.0]), (2, [1.0, 0.0])]
    assert run(spark, few, clusters=16, components=2) == plain(few, 16, 3, 2)
    between = [(k, [float(k), 0.0]) for k in range(9)]
    assert run(spark, between, clusters=3, rounds=0, components=2) == plain(between, 3, 0, 2)


def test_no_vectors_and_components_beyond_the_range(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [3e6, 0.0])], components=2)
    edge = [(1, [2.0e6, -2.0e6]), (2, [-2.0e6, 2.0e6]), (3, [0.0, 0.0])]
    assert run(spark, edge, clusters=2, components=2) == plain(edge, 2, 3, 2)
