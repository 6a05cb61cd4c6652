"""N-gram Jaccard join by a MinHash LSH forest, and the groups it links.

Every document gets ``trees`` short MinHash signatures of its five-word shingles. A tree is the
sorted list of its signatures, a prefix trie in which documents that share a longer prefix stand
together. Prefixes are matched at full depth first and shortened step by step until the chance that a
pair at the threshold shares a prefix in some tree reaches the target recall; shorter prefixes
contain the longer ones' matches. Documents under one prefix are linked to the smallest id there, a
number of candidate links linear in the documents.

Candidate links make components. Every linked pair lies in one, so shingle sets are then compared
exactly inside components: a component of up to ``block_docs`` documents in one block, a larger one in
pairs of blocks, as one product of incidence matrices each. A block pair returns, per
document, its number of links and its local component, never its pairs. Documents with
equal shingle sets are one class with a weight from the start.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; a text
of fewer than five words, but not none, has one shingle of them all.

Defined cases: null and wordless texts link to nothing and are groups of their own, as are rows
without doc_id; rows with one doc_id are one document, linked if any of its texts is; repeated rows
return repeated result rows; extra columns are ignored or, in ``one_per_group``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import cut, ready
from gridpulse.llm.text import LETTERS_AND_DIGITS, Words, as_bytes, blocks, gram_hashes, inside, mix, words

WORDS, THRESHOLD, TREES, LONGEST_PREFIX, TARGET_RECALL = 5, 0.8, 32, 8, 0.99999
BLOCK_DOCS = 1024
_U = np.uint64


def prefix_depth(threshold: float, trees: int, longest: int, target: float) -> int:
    """The deepest prefix at which a pair at the threshold still meets in some tree with the target chance."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def shingle_sets(block: Words, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a block, and where each document's begin."""
    n = len(block.offset) - 1
    grams = gram_hashes(block.hash, length)
    at = np.flatnonzero(inside(block.offset, length, len(grams)))
    owner = np.searchsorted(block.offset, at, "right") - 1
    values = grams[at]
    sizes = np.diff(block.offset)
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    whole = [gram_hashes(block.hash[block.offset[i]:block.offset[i + 1]], int(sizes[i])) for i in short]
    values, owner = np.concatenate([values, *whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1))


def signatures(values: np.ndarray, offset: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Per document and tree, one hash of the ``depth`` minima of that tree. Documents must not be empty."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)
    low = (values >> _U(32)).astype(np.uint32)
    out = np.zeros((len(offset) - 1, trees), _U)
    for t in range(trees):
        for k in range(t * depth, (t + 1) * depth):
            scrambled = (low * factors[k]) ^ shifts[k]
            scrambled ^= scrambled >> np.uint32(15)
            scrambled *= np.uint32(0x2C1B3C6D)
            out[:, t] = mix(out[:, t] + np.minimum.reduceat(scrambled, offset[:-1]).astype(_U) + _U(1))
        out[:, t] = mix(out[:, t] ^ _U(t))
    return out


def sign_documents(documents: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, two 64-bit keys of the shingle set (null for an empty one) and the trees' signatures."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_a, key_b, forest = [], [], []
            for _, texts in blocks(as_bytes(batch.column(1))):
                values, offset = shingle_sets(words(texts, LETTERS_AND_DIGITS))
                full = np.flatnonzero(np.diff(offset))
                starts = np.append(offset[full], len(values))
                marks = signatures(values, starts, trees, depth) if len(full) else np.zeros((0, trees), _U)
                a, b, f = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if len(full):
                    sums = [np.add.reduceat(mix(values ^ _U(salt)), starts[:-1]).view(np.int64).tolist() for salt in (11, 12)]
                    for i, x, y, m in zip(full.tolist(), *sums, marks, strict=True):
                        a[i], b[i], f[i] = x, y, m.view(np.int64).tolist()
                key_a, key_b, forest = key_a + a, key_b + b, forest + f
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), pa.array(forest, pa.list_(pa.int64())),
            ], names=["doc_id", "key_a", "key_b", "forest"])

    return source.mapInArrow(sign, "doc_id long, key_a long, key_b long, forest array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over ``edges`` (a, b), for every node with an edge.

    Alternates two star contractions, each an aggregate and a join, until nothing changes; the number
    of rounds grows with the logarithm of the nodes. No node's links meet in one task.
    """
    graph = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        graph = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        seen = graph.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(graph.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def link_block(node: np.ndarray, weight: np.ndarray, side: np.ndarray | None, values: np.ndarray, offset: np.ndarray, threshold: float):
    """Exact links of one block pair: (node, links, root) rows. side is None inside a block, else 0 or 1."""
    n = len(node)
    sizes = np.diff(offset)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values)
    ordered, owner = values[order], owner[order]
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    at = np.cumsum(head) - 1
    shared = np.bincount(at) > 1
    keep = shared[at]
    column, owner = (np.cumsum(shared) - 1)[at[keep]], owner[keep]
    left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    place = np.zeros(n, np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        own, col = owner[a:b], column[a:b] - low
        rows = np.zeros((n, width), np.float32)
        rows[own, col] = 1
        common += rows[left] @ rows[right].T if side is not None else rows @ rows.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * union - 1e-6
    linked &= node[left][:, None] != node[right][None, :]
    links = np.zeros(n, np.int64)
    np.add.at(links, left, linked @ weight[right])
    if side is not None:
        np.add.at(links, right, linked.T @ weight[left])
    # Local components: the smallest label spreads over links until it stands still.
    label = node.copy()
    while True:
        spread = label.copy()
        big = np.iinfo(np.int64).max
        if linked.any():
            np.minimum.at(spread, left, np.where(linked, label[right][None, :], big).min(axis=1, initial=big))
            np.minimum.at(spread, right, np.where(linked, label[left][:, None], big).min(axis=0, initial=big))
        if (spread == label).all():
            return links, label
        label = spread


def link_documents(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """Per row of ``documents``: doc_id, class_id, copy_of and n_links.

    class_id is the smallest doc_id of the group that links make; copy_of the smallest doc_id with
    the same shingle set; n_links the number of other documents at the threshold or above, copies included.
    """
    ready(documents.sparkSession)
    depth = prefix_depth(threshold, trees, LONGEST_PREFIX, target)
    signed = cut(sign_documents(documents, trees, depth))
    classes = cut(signed.where("doc_id is not null and key_a is not null").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("copy_of"), F.count_distinct("doc_id").alias("weight"), F.min("forest").alias("forest")))
    leaves = classes.select("copy_of", F.posexplode("forest").alias("tree", "prefix"))
    trie = leaves.groupBy("tree", "prefix").agg(F.min("copy_of").alias("hub"), F.max("copy_of").alias("most")).where("hub < most")
    candidates = leaves.join(trie.drop("most"), ["tree", "prefix"]).select(F.col("copy_of").alias("a"), F.col("hub").alias("b"))
    drawn = cut(components(candidates))
    checked = cut(_exact_links(documents, classes, drawn, threshold))
    edges = checked.select(F.col("node").alias("a"), F.col("root").alias("b"))
    groups = components(edges)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("key_a", "key_b", "copy_of", "weight").join(
        links.withColumnRenamed("node", "copy_of"), "copy_of", "left").join(
        groups.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    answer = joined.select(
        "key_a", "key_b", "copy_of", F.coalesce("component", "copy_of").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return signed.select("doc_id", "key_a", "key_b").join(answer, ["key_a", "key_b"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _exact_links(documents: DataFrame, classes: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of every class in a candidate component, one row per block pair."""
    sizes = drawn.groupBy("component").agg(F.count("*").alias("members")).withColumn(
        "n_blocks", F.ceil(F.col("members") / F.lit(BLOCK_DOCS)))
    weights = classes.groupBy(F.col("copy_of").alias("node")).agg(F.max("weight").alias("weight"))
    members = cut(drawn.join(sizes, "component").join(weights, "node"))
    bundles = max(1, -(-members.count() // BLOCK_DOCS))
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "node", "component", "weight", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(
            F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))).alias("bundle"))
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = texts.join(placed, "node")

    def compare(table: pa.Table) -> pa.Table:
        out = []
        texts = as_bytes(table.column("text").combine_chunks())
        column = {c: table.column(c).to_numpy() for c in ("node", "component", "weight", "own", "i", "j")}
        order = np.lexsort((column["j"], column["i"], column["component"]))
        keys = np.stack([column[c][order] for c in ("component", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        values, offset = [np.empty(0, _U)], [0]
        for _, part in blocks([texts[k] for k in order]):
            v, o = shingle_sets(words(part, LETTERS_AND_DIGITS))
            offset += (o[1:] + offset[-1]).tolist()
            values.append(v)
        values, offset = np.concatenate(values), np.array(offset)
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            rows = order[a:b]
            i, j = keys[1, a], keys[2, a]
            side = None if i == j else (column["own"][rows] == j).astype(int)
            links, root = link_block(
                column["node"][rows], column["weight"][rows], side, values[offset[a]:offset[b]], offset[a:b + 1] - offset[a], threshold)
            out.append((column["node"][rows], links, root))
        held = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(x, pa.int64()) for x in held], names=["node", "links", "root"])

    return sets.groupBy("bundle").applyInArrow(compare, "node long, links long, root long")


def one_per_group(documents: DataFrame, **parameters) -> DataFrame:
    """``documents`` with the smallest doc_id of each group; rows that share that id are one document and all stay.

    Rows without doc_id, and texts without words, are groups of their own and stay.
    """
    name = "dropped"
    while name in documents.columns:
        name += "_"
    dropped = link_documents(documents, **parameters).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(dropped, F.col("doc_id") == F.col(name), "left_anti")
