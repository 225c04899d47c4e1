"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are grown on a bounded sample (``SAMPLE`` vectors, smallest hashes of their
ids): every node splits at the median of a random projection. All vectors are routed to
one leaf per tree. A query walks all trees through one shared priority queue, ordered by
the squared distance to the half-spaces it would have to cross, until the leaves met hold
``visit`` times as many vectors as there are and those of one tree more than ``k`` different
ones (or all there are); their vectors are then scored exactly, in double precision.

Leaves are scored in blocks, candidates by at most about ``BLOCK`` and queries by about
``ASKED``, dealt out by hashes of their ids, so neither a leaf nor the queries that meet it
have to fit a task. Equal vectors are one candidate that stands for its smallest ids, as
many as a result can use; so copies, however many, fill no leaf. Vectors are scaled by a
power of two, which leaves cosines as they are and squares within the range of doubles.

Defined results: null and zero vectors, vectors with null or non-finite components or with
a null id take no part, neither as queries nor as candidates; vectors of each length are
searched among their own, with a forest for each length; rows of one id are never
neighbours of each other; fewer candidates than ``k`` give fewer rows; an empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oligo_engine.llm.common import checkpoint, list_column

TREES, DEPTH, SAMPLE = 4, 6, 8192
BLOCK, QUERIES, ASKED = 4096, 512, 8192


def grow(sample: np.ndarray, trees: int, depth: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directions, thresholds) per tree; node i has the children 2i + 1 and 2i + 2."""
    source, dims = np.random.default_rng(seed), sample.shape[1]
    forest = []
    for _ in range(trees):
        directions = source.standard_normal((2**depth - 1, dims))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        thresholds = np.zeros(2**depth - 1)
        node = np.zeros(len(sample), np.int64)
        for _ in range(depth):
            side = np.einsum("ij,ij->i", sample, directions[node])
            for n in np.unique(node):
                thresholds[n] = np.median(side[node == n])
            node = 2 * node + 1 + (side > thresholds[node])
        forest.append((directions, thresholds))
    return forest


def route(unit: np.ndarray, directions: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Leaf number of every vector."""
    node = np.zeros(len(unit), np.int64)
    while len(node) and node[0] < len(thresholds):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, directions[node]) > thresholds[node])
    return node - len(thresholds)


def walk(unit: np.ndarray, forest, sizes: dict[tuple[int, int], int], enough: float, least: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) of one query, nearest first over all trees, until they hold enough,
    and those of one tree, which share no vector, at least ``least``."""
    sides = [d @ unit - t for d, t in forest]
    queue, found, held = [(0.0, tree, 0) for tree in range(len(forest))], [], 0
    own = [0] * len(forest)
    while queue and (held < enough or max(own) < least):
        cost, tree, node = heapq.heappop(queue)
        inner = len(sides[tree])
        if node >= inner:
            found.append((tree, node - inner))
            met = sizes.get(found[-1], 0)
            held, own[tree] = held + met, own[tree] + met
            continue
        side = sides[tree][node]
        near = 2 * node + 1 + (side > 0)
        heapq.heappush(queue, (cost, tree, near))
        heapq.heappush(queue, (cost + side * side, tree, 4 * node + 3 - near))
    return found


def matrix_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their vectors as doubles, the largest component between 1/2 and 1)."""
    rows, vectors = [], []
    for i, value in enumerate(column.to_pylist()):
        if value is not None and len(value) == dims and None not in value:
            vector = np.array(value, np.float64)
            largest = float(np.abs(vector).max(initial=0.0))
            if np.isfinite(largest) and largest > 0:  # a NaN is the maximum of its vector
                rows.append(i)
                vectors.append(np.ldexp(vector, -int(np.frexp(largest)[1])))
    return np.array(rows, np.int64), np.array(vectors).reshape(len(rows), dims)


def scored(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of each query's best ``k`` candidates, ties to smaller ids."""
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    c = candidates / np.linalg.norm(candidates, axis=1, keepdims=True)
    near = q @ c.T
    if near.shape[1] > 4 * k:  # all that can be among the best, rounding allowed for
        bar = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] - 1e-9
    else:
        bar = np.full((len(q), 1), -2.0)
    places, cosines = [], []
    for i in range(len(q)):
        at = np.flatnonzero(near[i] >= bar[i])
        exact = cosine(queries[i], candidates[at])
        best = np.lexsort((ids[at], -exact))[:k]
        places.append(at[best])
        cosines.append(exact[best])
    return places, cosines


def cosine(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The exact measure, each pair summed by itself so that equal pairs agree."""
    dots = (candidates * query).sum(axis=1)
    return dots / (np.sqrt((candidates * candidates).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    visit: float = 1.5,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` has vec_id and embedding."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).filter(
        "vec_id IS NOT NULL AND embedding IS NOT NULL"
    )
    lengths = (
        rows.filter(F.size("embedding") > 0)
        .groupBy(F.size("embedding").alias("dims"))
        .agg(F.count_if("asks").alias("asked"))
        .filter("asked > 0")
        .orderBy("dims")
        .collect()
    )
    met = spark.createDataFrame([], "query_id long, score double, ids array<long>")
    for dims, asked in lengths:
        met = met.unionByName(_met(rows.filter(F.size("embedding") == dims), dims, asked, k, visit, trees, depth, seed))
    pairs = (
        met.select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(rows: DataFrame, dims: int, n_queries: int, k: int, visit: float, trees: int, depth: int, seed: int) -> DataFrame:
    """query_id, score, ids: the best k + 1 vectors of every block of leaves a query meets.
    ``rows`` has vec_id, embedding (``dims`` long) and asks, true in ``n_queries`` rows."""
    spark = rows.sparkSession
    copies = W.partitionBy("embedding").orderBy("vec_id")
    distinct = checkpoint(
        rows.withColumn("_n", F.row_number().over(copies))
        .filter(F.col("_n") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "ids", "embedding")
    )
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    taken = [matrix_of(chunk, dims)[1] for chunk in sample.column(0).chunks]
    units = np.concatenate(taken) if taken else np.zeros((0, dims))
    if not len(units):
        units = np.zeros((1, dims))
    else:
        units = units / np.linalg.norm(units, axis=1, keepdims=True)
    forest = spark.sparkContext.broadcast(grow(units, trees, depth, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = matrix_of(batch.column(2), dims)
            if not len(rows):
                continue
            unit = found / np.linalg.norm(found, axis=1, keepdims=True)
            kept, scaled = batch.take(pa.array(rows)), list_column(found.ravel(), np.full(len(rows), dims))
            for tree, (directions, thresholds) in enumerate(forest.value):
                yield pa.record_batch(
                    [pa.array(np.full(len(rows), tree), pa.int32()), pa.array(route(unit, directions, thresholds), pa.int32()), kept.column(0), kept.column(1), scaled],
                    ["tree", "leaf", "id", "ids", "embedding"],
                )

    index = distinct.mapInArrow(place, "tree int, leaf int, id long, ids array<long>, embedding array<double>")
    held = {(r["tree"], r["leaf"]): r["count"] for r in index.groupBy("tree", "leaf").count().collect()}
    total = sum(n for (tree, _), n in held.items() if tree == 0)
    blocks = {leaf: -(-n // BLOCK) for leaf, n in held.items()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = matrix_of(batch.column(1), dims)
            for i, vector in zip(rows.tolist(), found):
                leaves = walk(vector / np.linalg.norm(vector), forest.value, held, visit * total, min(total, k + 1))
                met = [(t, leaf, b) for t, leaf in leaves for b in range(blocks.get((t, leaf), 0))]
                yield pa.RecordBatch.from_pylist(
                    [{"tree": t, "leaf": leaf, "block": b, "query_id": batch.column(0)[i].as_py(), "query": vector.tolist()} for t, leaf, b in met],
                    pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("query", pa.list_(pa.float64()))]),
                )

    parts = -(-n_queries // ASKED)
    probes = rows.filter("asks").select("vec_id", "embedding").mapInArrow(
        probe, "tree int, leaf int, block int, query_id long, query array<double>"
    ).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    count = F.create_map(*[x for (t, leaf), n in blocks.items() for x in (F.lit(t * 2**depth + leaf), F.lit(n))]) if blocks else F.create_map(F.lit(-1), F.lit(1))
    many = count[F.col("tree") * F.lit(2**depth) + F.col("leaf")]
    filled = index.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "score": [], "ids": []}
        if left.num_rows and right.num_rows:
            vectors_here = np.array(left.column("embedding").combine_chunks().flatten()).reshape(left.num_rows, dims)
            ids, lists = left.column("id").to_numpy(), left.column("ids").to_pylist()
            asked = np.array(right.column("query").combine_chunks().flatten()).reshape(right.num_rows, dims)
            names = right.column("query_id").to_pylist()
            for a in range(0, len(asked), QUERIES):
                places, cosines = scored(asked[a : a + QUERIES], vectors_here, ids, k + 1)
                for name, at, near in zip(names[a:], places, cosines):
                    out["query_id"] += [name] * len(at)
                    out["score"] += near.tolist()
                    out["ids"] += [lists[j] for j in at.tolist()]
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    keys = ["tree", "leaf", "block", "part"]
    return filled.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(score, "query_id long, score double, ids array<long>")
