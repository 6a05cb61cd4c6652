"""Centroid clustering in exact integers, on built-in expressions only.

A component x becomes floor(64 * x), so distances and sums are whole numbers: no result depends on the order in
which rows are summed, on partitions or on a lost executor. Centroids are literals of the plan. Per vector
``zip_with`` and ``aggregate`` compute the squared distance to each literal, ``array_min`` over (distance, number)
structs chooses the cluster, and a round's update is one grouping with one sum per component, combined before the
shuffle. What leaves the executors per round is one row per cluster: its count and sums.

The first centroids are the vectors with the smallest hash of their id, found by a top-k that keeps k rows a task.

Defined cases: a vector that is null, of another length, or with a null, NaN or infinite component is left out; a
null vec_id is kept and hashes like no number, after all others; equal hashes (repeated ids) go by the smaller vector;
equal distances go to the smaller number; repeated rows each count; fewer vectors than clusters give as many
clusters as there are vectors; a cluster that loses all its vectors keeps its centroid; extra columns are ignored;
an empty table gives an empty result. Distances are 64-bit: they are exact while every component's size is below
2**21 (32768 times what normalised vectors hold); larger components are an error, never a wrong number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready
from gridpulse.session import stage_table

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 21


def usable(vector: str, components: int) -> Column:
    """Whether a vector has the right length and only finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """The components as whole numbers."""
    def floored(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < LARGEST, F.floor(x * F.lit(float(scale)))).otherwise(
            F.raise_error(F.lit("a component is too large for 64-bit distances")).cast("long"))

    return F.transform(vector, floored)


def _literal(centroid: list[int]) -> Column:
    return F.lit(centroid).cast("array<bigint>")


def nearest(vector: str, centroids: list[list[int]]) -> Column:
    """The struct (distance, cluster) of the nearest centroid, the smaller number of equally near ones."""
    def distance(centroid: list[int]) -> Column:
        apart = F.zip_with(vector, _literal(centroid), lambda x, c: x - c)
        return F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)

    return F.array_min(F.array(*[
        F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("hash"), "whole").orderBy(F.asc_nulls_last("hash"), "whole").limit(clusters)
    return [r.whole for r in rows.collect()]


def update(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid replaced by the floored mean of its vectors; one without vectors stays."""
    assigned = vectors.select(nearest("whole", centroids)["cluster"].alias("cluster"), "whole")
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("whole")[i]).alias(f"sum_{i}") for i in range(len(centroids[0]))])
    moved = list(centroids)
    for row in sums.collect():  # a row per cluster
        moved[row.cluster] = [row[f"sum_{i}"] // row.n for i in range(len(centroids[0]))]
    return moved


def cluster_vectors(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS,
    scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    ready(embeddings.sparkSession)
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    vectors = given.where(usable("vector", components)).select("vec_id", whole("vector", scale).alias("whole"))
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = update(vectors, centroids)
    found = nearest("whole", centroids or [[0] * components])
    assigned = stage_table(
        vectors.select("vec_id", found.alias("near")).select("vec_id", "near.cluster", "near.distance"), "clusters")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.lit(values or [None]).cast(f"array<{kind}>"), F.col("cluster") + 1)

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster([inertia.get(k, 0) for k in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(hashes, "string").alias("centroid_sha256"))
