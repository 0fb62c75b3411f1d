"""Operator 11, exact Lloyd clustering of integer vectors by filtering partition-local ball trees.

Each task cuts its rows into blocks of at most `integer_vectors.BLOCK_ROWS` and builds one
metric tree a block: a node is a contiguous slice of the block's points, halved at the median of
its widest component down to leaves of `LEAF` points, and keeps its radius, its count and its
integer component sums.  The trees are built once, and saved where all executors find them.

A round sends the centroids (k of them, k a parameter) to the trees.  At a node whose ball
has radius r, a centroid at distance d from its middle is the nearest or may be only if
d - r <= nearest d + r; the triangle inequality drops the others.  A ball left with one
centroid goes to it as a whole, by its count and sum; else its halves are asked with the
centroids that are left, down to the leaves, whose points are held exactly, in integers,
against what is left.  The comparison is strict with a margin for rounding, so that ties
always come down to the leaves, where the smaller number wins.  A task adds up its blocks,
so a round shuffles k rows a task, and the driver sees k rows.

Defined cases: vectors that are null, of another length than `dimension` or hold null or non-finite
components take no part and are not returned; rows with a null vec_id are clustered but
start no centroid; repeated rows count each (equal vec_ids start centroids in the order of
their components); with fewer vectors than k there are fewer centroids; an empty table gives no
rows; a component beyond 2 ** 27 after scaling is an error.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.integer_vectors import blocks, finite, floor_means, integers, points, squared, summed
from cadenza.llm.storage import saved

SCALE, DIMENSION, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Points of a leaf, at most.
LEAF = 16
TREE = "ids binary, known binary, points binary, first binary, last binary, radius binary, sums binary"
#: Relative and absolute margin for the rounding of distances in doubles.
MARGIN, LEAST_MARGIN = 1e-9, 1e-6


def grow(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and of each node, in heap order, first and last point (end exclusive), radius and sums; a node without points ends where it begins."""
    order = np.arange(len(x))
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
    nodes = (2 << depth) - 1
    first, last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    last[0] = len(x)
    radius, sums = np.zeros(nodes), np.zeros((nodes, x.shape[1]), np.int64)
    for i in range(nodes):
        a, b = first[i], last[i]
        if a == b:
            continue
        mine = x[order[a:b]]
        sums[i] = mine.sum(axis=0)
        middle = sums[i] / (b - a)
        radius[i] = np.sqrt(((mine - middle) ** 2).sum(axis=1).max())
        if 2 * i + 2 < nodes:
            half = (a + b) // 2
            if b - a > leaf and radius[i] > 0:
                wide = int((mine.max(axis=0) - mine.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argpartition(mine[:, wide], half - a)]
            else:
                half = b  # stays whole, one level down
            first[2 * i + 1], last[2 * i + 1], first[2 * i + 2], last[2 * i + 2] = a, half, half, b
    return order, first, last, radius, sums


def plant(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) rows to one row a block, a tree with its points in tree order."""
    for block in blocks(batches):
        x = points(block.column(1), scale)
        order, first, last, radius, sums = grow(x)
        ids = block.column(0)
        known = np.asarray(ids.is_valid())[order]
        parts = [np.asarray(ids.fill_null(0))[order], known, x[order].astype(np.int32), first.astype(np.int32), last.astype(np.int32), radius, sums]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [c.split()[0] for c in TREE.split(", ")])
    textkit.let_go()


def owned(x: np.ndarray, first: np.ndarray, last: np.ndarray, radius: np.ndarray, sums: np.ndarray, c: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """(node, centroid) of the balls that go whole, and (points, their centroids) of the leaves that were looked into."""
    whole: list[tuple[int, int]] = []
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    todo, left = np.array([0]), np.ones((1, len(c)), bool)
    while len(todo):
        filled = last[todo] > first[todo]
        todo, left = todo[filled], left[filled]
        if not len(todo):
            break
        middle = sums[todo] / (last[todo] - first[todo])[:, None]
        d = np.sqrt(np.maximum(((middle[:, None, :] - c[None]) ** 2).sum(axis=2), 0))
        d[~left] = np.inf
        reach = d.min(axis=1) + 2 * radius[todo]
        left = d <= (reach * (1 + MARGIN) + LEAST_MARGIN)[:, None]
        one = left.sum(axis=1) == 1
        whole += zip(todo[one].tolist(), left[one].argmax(axis=1).tolist())
        todo, left = todo[~one], left[~one]
        bottom = 2 * todo + 1 >= len(first)
        for node, may in zip(todo[bottom], left[bottom]):
            at = np.arange(first[node], last[node])
            among = np.flatnonzero(may)
            leaves.append((at, among[squared(x[at], c[among]).argmin(axis=1)]))  # the first of equals
        todo, left = todo[~bottom], left[~bottom]
        todo, left = np.concatenate([2 * todo + 1, 2 * todo + 2]), np.concatenate([left, left])
    return whole, leaves


def read(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, known, points, first, last, radius, sums of each tree of a batch."""
    kinds = (np.int64, bool, np.int32, np.int32, np.int32, np.float64, np.int64)
    for i in range(batch.num_rows):
        ids, known, x, first, last, radius, sums = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds))
        yield ids, known, x.reshape(-1, dimension).astype(np.int64), first, last, radius, sums.reshape(-1, dimension)


def total(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cluster, n, sums of all trees of a task."""
    n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    for batch in batches:
        for _, _, x, first, last, radius, sums in read(batch, c.shape[1]):
            whole, leaves = owned(x, first, last, radius, sums, c)
            for node, k in whole:
                n[k] += last[node] - first[node]
                s[k] += sums[node]
            if leaves:
                at, own = (np.concatenate(v) for v in zip(*leaves))
                n += np.bincount(own, minlength=len(c))
                for k in np.unique(own):
                    s[k] += x[at[own == k]].sum(axis=0)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    textkit.let_go()


def assign(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, cluster, distance of every point."""
    for batch in batches:
        for ids, known, x, first, last, radius, sums in read(batch, c.shape[1]):
            own = np.zeros(len(x), np.int32)
            whole, leaves = owned(x, first, last, radius, sums, c)
            for node, k in whole:
                own[first[node] : last[node]] = k
            for at, k in leaves:
                own[at] = k
            distance = ((x - c[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])
    textkit.let_go()


def trees(vectors: DataFrame, scale: int = SCALE, dimension: int = DIMENSION) -> DataFrame:
    """One row a block of at most BLOCK_ROWS vectors, saved."""
    good = finite(F.col("embedding")) & (F.size("embedding") == dimension)
    rows = vectors.filter(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return saved(rows.mapInArrow(lambda batches: plant(batches, scale), TREE))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 1, scale: int = SCALE, dimension: int = DIMENSION) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    good = F.col("vec_id").isNotNull() & finite(F.col("embedding")) & (F.size("embedding") == dimension)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("bigint").cast("string")), 256)
    picked = vectors.filter(good).select(order.alias("hash"), integers(F.col("embedding"), scale).alias("x")).orderBy("hash", "x").limit(k).collect()
    return np.array([r.x for r in picked], np.int64).reshape(-1, dimension)


def lloyd(grown: DataFrame, c: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after some rounds over the trees; a round is one job that returns a row a centroid."""
    for _ in range(rounds if len(c) else 0):
        parts = grown.mapInArrow(lambda batches, c=c: total(batches, c), "cluster int, n bigint, sums array<bigint>")
        found = {r.cluster: r for r in summed(parts, ["cluster"], c.shape[1])}
        counts = [found[k].n if k in found else 0 for k in range(len(c))]
        c = floor_means([found[k].sums if k in found else [] for k in range(len(c))], counts, c)
    return c


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, dimension: int = DIMENSION) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector that takes part (saved), and the final centroids."""
    grown = trees(vectors, scale, dimension)
    c = lloyd(grown, first_centroids(vectors, k, seed, scale, dimension), rounds)
    rows = grown.mapInArrow(lambda batches: assign(batches, c), "vec_id bigint, cluster int, distance bigint")
    return (saved(rows) if len(c) else rows.limit(0)), c


def with_inertia(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """cluster() rows with cluster_inertia, inertia and centroid_sha256, from one row a centroid."""
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    about = [(k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for k, x in enumerate(c.tolist())]
    named = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
