"""Approximate nearest neighbours by inner product: a forest of random-projection trees with one priority queue a query.

Vectors get one more component that brings them all to the largest norm, so the largest inner product is the smallest
angle. The trees are fitted on a bounded sample and split at its medians along differences of random pairs; every vector
is put into its leaf of every tree. A query walks all trees through one queue ordered by the distance to the planes it
would cross, and its first leaves meet their vectors in blocks, where exact inner products in double precision pick the
best of each leaf; then the best over all leaves are ranked. A query whose leaves hold fewer than k candidates meets all
leaves of one tree instead. Blocks are made from the leaves' real sizes, and a leaf too large for a task is dealt in slices
that its queries all meet, so that no task's memory grows with the corpus or with a lopsided tree.

Equal vectors are one class in the index, with its smallest ids: no leaf grows with the copies of one vector, and no copy
that could be among the k nearest is lost.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without id and
vectors of another length than the usual one; of rows with one id, the one whose vector has the smallest hash counts, once; a
query's own id is never returned; ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The most vectors that fit the trees; they are those with the smallest hashes.
SAMPLE = 20_000
LEAF, TREES = 512, 6
#: The recall that the number of leaves a query visits is chosen for, on queries from the sample against the sample.
RECALL, TRIED = 0.96, 100
#: Bytes of vectors, in double precision, that the leaves of one block hold, and queries that meet them at once.
BLOCK_BYTES, BLOCK_QUERIES = 48_000_000, 50_000


@dataclass
class Tree:
    """A full binary tree of planes; node i has children 2i + 1 and 2i + 2, leaves are numbered from 0."""

    depth: int
    normals: np.ndarray
    offsets: np.ndarray

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            right = np.einsum("nd,nd->n", rows, self.normals[node]) > self.offsets[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def plant(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    normals, offsets = np.zeros((2**depth, sample.shape[1]), np.float32), np.zeros(2**depth, np.float32)
    members = [np.arange(len(sample))]
    for node in range(2**depth - 1):
        own = members[node]
        if len(own) > 1:
            a, b = sample[rng.choice(own, (2, 4))].mean(1)
            normal = a - b
            normal = normal / (np.linalg.norm(normal) or 1)
        else:
            normal = rng.normal(size=sample.shape[1])
            normal /= np.linalg.norm(normal)
        at = sample[own] @ normal
        normals[node], offsets[node] = normal, np.median(at) if len(own) else 0
        right = at > offsets[node]
        members += [own[~right], own[right]]
    return Tree(depth, normals, offsets)


def probe(query: np.ndarray, forest: list[Tree], most: int) -> list[tuple[int, int]]:
    """The first leaves, as (tree, leaf), in order of the sum of squares of the distances to the planes crossed on the way."""
    margins = [t.normals @ query - t.offsets for t in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < most:
        far, t, node = heapq.heappop(queue)
        inner = 2 ** forest[t].depth - 1
        while node < inner:
            m = float(margins[t][node])
            near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (far + m * m, t, other))
            node = near
        found.append((t, node - inner))
    return found


def calibrated(points: np.ndarray, rows: np.ndarray, forest: list[Tree], k: int, rng: np.random.Generator) -> int:
    """How many leaves queries from the sample need to find RECALL of their k nearest in the sample (rows: lifted points).

    Of a larger corpus the nearest are nearer than those of its sample, and found in fewer leaves."""
    at = np.array([t.leaves(rows) for t in forest])
    needed = []
    for i in rng.choice(len(points), min(TRIED, len(points)), replace=False):
        near = points @ points[i]
        near[i] = -np.inf
        best = np.argsort(-near)[: min(k, len(points) - 1)]
        query = np.append(rows[i][:-1], 0).astype(np.float32)
        turn = {leaf: n for n, leaf in enumerate(probe(query, forest, len(forest) * 2 ** forest[0].depth), 1)}
        needed += [min(turn[t, int(leaf)] for t, leaf in enumerate(column)) for column in at[:, best].T]
    return int(np.quantile(needed, RECALL, method="higher")) if needed else 1


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from first to last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, v, vkey: the vectors that take part, each once; floats stay floats, other numbers become doubles."""
    kind = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    v = F.transform(vector, lambda x: x.cast(kind))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    # Zeros of either sign are one vector.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("vkey"), "v")).alias("r"))
    return stored(one.select("r.vkey", "vec_id", "r.v"), "neighbours-vectors")


def search(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of vectors that is_query (over vec_id) names."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector)
    # The k + 1 smallest ids of each class; Spark keeps no more of them in each task before it shuffles.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vkey", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = stored(few.groupBy("vkey", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.get("ids", F.lit(0))), "neighbours-classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, most_norm = classes.agg(F.count("*"), F.max(norm)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    # A fifth more than asked for passes the filter on hashes, from all of the table; the order makes it those with the smallest.
    order = F.shiftrightunsigned(F.xxhash64("cid"), 11)
    share = int(min(1.0, 1.2 * sample / n) * 2**53)
    picked = classes.select("v", "cid", order.alias("h")).where(F.col("h") < share).orderBy("h", "cid").limit(sample).select("v").collect()

    def lifted(x: np.ndarray) -> np.ndarray:
        """With the component that brings all to the largest norm, scaled to 1."""
        x = x / most_norm
        return np.column_stack((x, np.sqrt(np.clip(1 - (x * x).sum(1), 0, None)))).astype(np.float32)

    points = np.array([r["v"] for r in picked], np.float64)
    depth = 0
    while n / 2**depth > leaf and len(points) / 2 ** (depth + 1) >= 4:
        depth += 1
    rng = np.random.default_rng(seed)
    rows_of = lifted(points)
    forest = [plant(rows_of, depth, rng) for _ in range(trees if depth else 1)]
    probes = calibrated(points, rows_of, forest, k, rng)

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(forest), 2**depth), np.int64)
        for b in batches:
            if b.num_rows:
                x = lifted(matrix(b.column("v")))
                for t, tree in enumerate(forest):
                    found[t] += np.bincount(tree.leaves(x), minlength=2**depth)
        t, at = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"tree": pa.array(t), "leaf": pa.array(at), "n": pa.array(found[t, at])})

    # Bounded by the leaves of the forest, which the sample bounds.
    held = np.zeros((len(forest), 2**depth), np.int64)
    for r in classes.select("v").mapInArrow(sizes, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        held[r["tree"], r["leaf"]] = r["n"]
    # Leaves that lie together are one block while it fits a task; a larger leaf is a block of several slices.
    fits = max(1, block_bytes // (points.shape[1] * 8))
    block_of, slices = np.zeros((len(forest), 2**depth), np.int64), []
    for t in range(len(forest)):
        block, used = -1, fits + 1
        for at, size in enumerate(held[t].tolist()):
            if used + size > fits:
                block, used = len(slices), 0
                slices.append(1)
            block_of[t, at], used = block, used + size
            slices[block] = -(-max(used, 1) // fits)
    slices = np.array(slices)
    parts = 1 + rows.where(is_query).count() // BLOCK_QUERIES

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = lifted(matrix(b.column("v")))
                cid = b.column("cid").to_numpy().astype(np.uint64)
                for t, tree in enumerate(forest):
                    at = tree.leaves(x)
                    block = block_of[t, at]
                    piece = (cid * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices[block]
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(piece), pa.array(at), b.column("cid"), b.column("v")], ["block", "slice", "leaf", "cid", "v"])

    def ask(batches: Iterator[pa.RecordBatch], most: int, asked_trees: list[Tree]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v")) / most_norm
                blocks: dict[tuple[int, int, int], list[int]] = {}
                for i, q in enumerate(x):
                    for t, leaf_no in probe(np.append(q, 0.0).astype(np.float32), asked_trees, most):
                        for piece in range(slices[block_of[t, leaf_no]]):
                            blocks.setdefault((i, int(block_of[t, leaf_no]), piece), []).append(leaf_no)
                at, block, piece = np.array(list(blocks), np.int64).T
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(piece), pa.array(blocks.values(), pa.list_(pa.int64())), b.column("vec_id").take(at), b.column("v").take(at)], ["block", "slice", "leaves", "query_id", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    indexed = classes.select("cid", "v").mapInArrow(index, f"block long, slice long, leaf long, cid long, v {kind}")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, qid = matrix(left["v"]), left["query_id"].to_numpy()
            cid = right["cid"].to_numpy()
            by_id = np.argsort(cid, kind="stable")
            v, vl, cid = matrix(right["v"])[by_id], right["leaf"].to_numpy()[by_id], cid[by_id]
            own = left["leaves"].combine_chunks()
            base = min(vl.min(), own.flatten().to_numpy().min())
            visits = np.zeros((len(q), max(vl.max(), own.flatten().to_numpy().max()) - base + 1), bool)
            visits[np.repeat(np.arange(len(q)), own.value_lengths().to_numpy()), own.flatten().to_numpy() - base] = True
            for part in np.array_split(np.arange(len(q)), 1 + len(q) * len(v) // 4_000_000):
                near = np.where(visits[part][:, vl - base], q[part] @ v.T, -np.inf)
                # Ids are in order, so a stable sort breaks ties by id; rounding here is far below what the spare places leave.
                top = np.argsort(-near, axis=1, kind="stable")[:, : k + 5]
                met = np.take_along_axis(near, top, 1).ravel() > -np.inf
                a, c = np.repeat(part, top.shape[1])[met], top.ravel()[met]
                out.append((qid[a], cid[c], dot(q[a], v[c])))
        a, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": a, "cid": c, "score": s})

    # Queries are dealt in parts so that no block meets too many at once; each part reads its leaves.
    indexed = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    key = ("block", "slice", "part")

    def nearest(queries: DataFrame, most: int, asked_trees: list[Tree]) -> DataFrame:
        """query_id, score, vec_id: the best candidates in the first leaves of each query."""
        asked = queries.mapInArrow(lambda b: ask(b, most, asked_trees), f"block long, slice long, leaves array<long>, query_id long, v {kind}")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        met = asked.groupBy(*key).cogroup(indexed.groupBy(*key)).applyInArrow(meet, "query_id long, cid long, score double")
        # The same class comes from several trees with the same score.
        best = met.groupBy("query_id", "cid").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
        best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        return best.join(classes.select("cid", "ids"), "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")

    queries = rows.where(is_query).select("vec_id", "v")
    ids = stored(nearest(queries, probes, forest), "neighbours-found")
    # At least k of all other rows, where there are so many.
    enough = ids.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, rows.count() - 1)).select(F.col("query_id").alias("vec_id"))
    few = stored(queries.join(enough, "vec_id", "left_anti"), "neighbours-few")
    if not few.isEmpty():
        ids = ids.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(nearest(few, 2**depth, forest[:1]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ids.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
