"""Nearest vectors by inner product with a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import durable

#: vectors that the tree is fitted on, children of a node and least levels of nodes
SAMPLE = 8000
BRANCH = 8
LEVELS = 2
#: queries for calibration and the recall they must reach
CALIBRATION = 128
RECALL = 0.97
#: vectors of one leaf that are searched at once; larger leaves are cut into blocks
BLOCK = 2000
#: queries that meet such a block at once
QUERIES = 2000
NEAREST = 20


@dataclass
class Node:
    centre: np.ndarray
    #: largest distance of a sample vector of the node from its centre
    radius: float
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: down the tree to the nearest centre."""
        out = np.zeros(len(x), np.int64)

        def down(node: Node, rows: np.ndarray) -> None:
            if not node.children:
                out[rows] = node.leaf
                return
            near = _nearest(x[rows], np.stack([c.centre for c in node.children]))
            for i, child in enumerate(node.children):
                if (near == i).any():
                    down(child, rows[near == i])

        down(self.root, np.arange(len(x)))
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first traversal.

        A priority queue holds the nodes not yet opened, by the largest inner product that a vector of the node
        may have with the query: centre product plus the query's norm times the node's radius, damped by
        ``_SPREAD`` as few vectors lie in the query's direction.
        """
        size = float(np.linalg.norm(query)) * _SPREAD
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        order, number = [], 1
        while queue and len(order) < most:
            node = heapq.heappop(queue)[2]
            if not node.children:
                order.append(node.leaf)
                continue
            for child in node.children:
                heapq.heappush(queue, (-float(child.centre @ query) - size * child.radius, number, child))
                number += 1
        return order


_SPREAD = 0.2


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = np.unique(x, axis=0)
    if len(centres) > k:
        centres = centres[rng.choice(len(centres), k, replace=False)]
        for _ in range(rounds):
            near = _nearest(x, centres)
            held = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(held[:, None] > 0, sums / np.maximum(1, held)[:, None], centres)
    return centres


def grow(x: np.ndarray, branch: int = BRANCH, levels: int = LEVELS, seed: int = 5) -> Tree:
    """k-means of k-means: ``branch`` children a node, ``levels`` deep; equal vectors are not split."""
    rng, leaves = np.random.default_rng(seed), [0]

    def build(rows: np.ndarray, depth: int) -> Node:
        centre = rows.mean(axis=0) if len(rows) else np.zeros(x.shape[1] if x.ndim == 2 else 1)
        node = Node(centre, float(np.sqrt(((rows - centre) ** 2).sum(1).max(initial=0.0))) if len(rows) else 0.0)
        if depth < levels and len(rows) > branch:
            centres = _means(rows, branch, rng)
            if len(centres) > 1:
                near = _nearest(rows, centres)
                node.children = [build(rows[near == i], depth + 1) for i in range(len(centres)) if (near == i).any()]
                return node
        node.leaf = leaves[0]
        leaves[0] += 1
        return node

    return Tree(build(x, 0), leaves[0])


def levels_for(vectors: int) -> int:
    """Levels with which an average leaf is one block; the sample bounds how far nodes are split."""
    levels = LEVELS
    while BRANCH**levels * BLOCK < vectors and BRANCH**levels < SAMPLE:
        levels += 1
    return levels


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has finite components only, and is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added from left to right."""
    return np.cumsum(q * x, axis=1)[:, -1]


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, vec_id and exact score of the nearest vectors of one block for each query, not itself."""
    at, found, scores = [], [], []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = part @ x.T
        rough[query_ids[lo : lo + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > nearest:
            kth = -np.partition(-rough, nearest - 1, axis=1)[:, nearest - 1]
        else:
            kth = np.full(len(part), -np.inf)
        # rounding of the quick product must not decide between near ties
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1, where=np.isfinite(rough), initial=0.0))
        i, j = np.nonzero((rough >= (kth - slack)[:, None]) & np.isfinite(rough))
        exact = np.concatenate([np.zeros(0), *(_products(part[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536))])
        by = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[by], j[by], exact[by]
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[: len(i)]
        rank = np.arange(len(i)) - np.repeat(heads, np.diff(np.r_[heads, len(i)]))
        keep = rank < nearest
        at.append(i[keep] + lo)
        found.append(ids[j[keep]])
        scores.append(exact[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *found]), np.concatenate([np.zeros(0), *scores])


def _exact(vectors: DataFrame, query_ids: np.ndarray, q: np.ndarray, nearest: int) -> DataFrame:
    """Nearest vectors of a bounded set of queries among all rows, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, scores = best_of(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding")), query_ids, q, nearest)
            leaf = dict(zip(batch.column("vec_id").to_pylist(), batch.column("leaf").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(found), pa.array(scores), pa.array([leaf[v] for v in found.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    hits = vectors.mapInArrow(run, "query_id long, vec_id long, score double, leaf int")
    return _cut(hits, nearest)


def _cut(hits: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


def calibrated(tree: Tree, queries: list[tuple[np.ndarray, list[int]]], recall: float = RECALL) -> int:
    """Fewest leaf visits with which the queries' true neighbours' leaves are reached to this share."""
    reached = np.zeros(tree.leaves + 1)
    total = 0
    for query, leaves in queries:
        place = {leaf: i for i, leaf in enumerate(tree.visits(query, tree.leaves))}
        for leaf in leaves:
            reached[place[leaf] + 1] += 1
            total += 1
    enough = np.flatnonzero(np.cumsum(reached) >= recall * total)
    return max(1, int(enough[0])) if total else 1


def search(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of every row whose id is divisible by ``every``.

    The tree is fitted on at most ``SAMPLE`` vectors, those with the smallest hashes; every vector is placed in
    a leaf. A bounded set of queries is compared with all rows to find how many leaves reach ``RECALL``. Then each query
    meets the blocks of its leaves, and each block gives its nearest rows. Null ids, and vectors that
    are null, zero or not finite, take no part, nor do vectors whose length differs from the most common one.
    Of rows that repeat an id the one with the smallest vector counts. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("embedding") == sizes["size"])
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    tree = grow(np.array([r["embedding"] for r in drawn]), levels=levels_for(sizes["n"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.place(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "leaf"])

    indexed = durable(rows.mapInArrow(place, "vec_id long, embedding array<double>, leaf int"), "leaves")
    queries = indexed.where(F.col("vec_id") % every == 0)
    probe = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    ids, q = np.array([r["vec_id"] for r in probe], np.int64), np.array([r["embedding"] for r in probe]).reshape(len(probe), -1)
    true: dict[int, list[int]] = {int(i): [] for i in ids}
    if len(ids):
        for r in _exact(indexed, ids, q, nearest).collect():
            true[r["query_id"]].append(r["leaf"])
    visits = calibrated(tree, [(v, true[int(i)]) for i, v in zip(ids, q)])

    # a leaf with many rows is searched block by block; a leaf number per block count is all that the driver sees
    blocks = {r["leaf"]: -(-r["n"] // BLOCK) for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [[n for n in tree.visits(query, visits) if n in blocks] for query in _matrix(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves"])

    asked = queries.select("vec_id", "embedding").mapInArrow(ask, "vec_id long, embedding array<double>, leaves array<int>")
    asked = durable(asked, "asked").withColumn("leaf", F.explode("leaves")).drop("leaves")
    # the queries of a leaf are cut too; each of their parts meets each block once
    parts = {r["leaf"]: -(-r["n"] // QUERIES) for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    if not parts:
        return spark.createDataFrame([], result)

    def number(of: dict[int, int]) -> Column:
        return F.create_map(*[x for n, b in of.items() for x in (F.lit(n), F.lit(b))])[F.col("leaf")]

    def dealt(rows: DataFrame, own: str, into: dict[int, int], other: str, among: dict[int, int]) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), number(into)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), number(among) - 1)))

    asked = dealt(asked, "part", parts, "block", blocks)
    held = dealt(indexed.where(number(parts).isNotNull()), "block", blocks, "part", parts)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = left.combine_chunks(), right.combine_chunks()
        query_ids = a.column("vec_id").to_numpy()
        at, found, scores = best_of(b.column("vec_id").to_numpy(), _matrix(b.column("embedding").combine_chunks()), query_ids, _matrix(a.column("embedding").combine_chunks()), nearest)
        return pa.table({"query_id": query_ids[at], "vec_id": found, "score": scores})

    hits = (
        asked.select("leaf", "block", "part", "vec_id", "embedding")
        .groupBy("leaf", "block", "part")
        .cogroup(held.select("leaf", "block", "part", "vec_id", "embedding").groupBy("leaf", "block", "part"))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    return _cut(hits, nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
