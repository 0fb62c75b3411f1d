"""A robust-pruned neighbour graph over overlapping shards of a block, and searches in it, many at a time, in NumPy.

Vectors are unit rows of doubles; similarity is the dot product.
"""

from __future__ import annotations

import numpy as np


def pruned(vectors: np.ndarray, degree: int = 16, candidates: int = 48, alpha: float = 1.2) -> np.ndarray:
    """[n, degree] neighbours of each vector of a shard by robust pruning of its nearest `candidates`, -1 where there are fewer.

    The nearest candidate left becomes a neighbour, and those that it is alpha times nearer to than the vector is go.
    """
    n = len(vectors)
    k = min(candidates, n - 1)
    out = np.full((n, degree), -1, np.int32)
    if k <= 0:
        return out
    apart = 2 - 2 * (vectors @ vectors.T)  # squared distances
    np.fill_diagonal(apart, np.inf)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    away = np.take_along_axis(apart, near, 1)
    order = np.argsort(away, axis=1, kind="stable")
    near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
    alive = np.ones((n, k), bool)
    for r in range(degree):
        first = alive.argmax(axis=1)
        some = np.flatnonzero(alive[np.arange(n), first])
        if len(some) == 0:
            break
        chosen = near[some, first[some]]
        out[some, r] = chosen
        alive[some, first[some]] = False
        alive[some] &= ~(alpha**2 * apart[chosen[:, None], near[some]] < away[some])
    return out


def shards(vectors: np.ndarray, rows: int = 384, overlap: int = 2) -> list[np.ndarray]:
    """Row numbers of overlapping cluster shards: a vector is in those of its `overlap` nearest centroids.

    A cluster with more than twice as many as `rows` is cut by similarity to its centroid.
    """
    n = len(vectors)
    count = -(-n * overlap // rows)
    if n <= rows:
        return [np.arange(n)]
    c = vectors[np.linspace(0, n - 1, count).astype(int)]
    for _ in range(4):
        own = (vectors @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    near = vectors @ c.T
    nearest = np.argpartition(-near, min(overlap, count) - 1, axis=1)[:, :overlap]
    out = []
    for j in range(count):
        mine = np.flatnonzero((nearest == j).any(axis=1))
        mine = mine[np.argsort(-near[mine, j], kind="stable")]
        out += np.array_split(mine, -(-len(mine) // (2 * rows))) if len(mine) else []
    return out


def united(vectors: np.ndarray, degree: int = 16, rows: int = 384, overlap: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """One graph of the lists of all overlapping shards, edges in both directions: neighbours, and each node's first index."""
    lists: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    for own in shards(vectors, rows, overlap):
        found = pruned(vectors[own], degree)
        at, col = np.nonzero(found >= 0)
        lists.append(own[at])
        ends.append(own[found[at, col]])
    return undirected(len(vectors), np.concatenate(lists), np.concatenate(ends))


def undirected(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists with every edge (a, b) in both directions, once: neighbours, and each node's first index (len + 1)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    return key % max(n, 1), np.searchsorted(key // max(n, 1), np.arange(n + 1))


def medoids(vectors: np.ndarray, count: int = 8) -> np.ndarray:
    """The vector nearest to the mean, and those nearest to the means of parts around far apart vectors."""
    start = int((vectors @ vectors.mean(axis=0)).argmax())
    chosen, near = [start], vectors @ vectors[start]
    for _ in range(min(count, len(vectors)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    part = (vectors @ vectors[chosen].T).argmax(axis=1)
    found = {start}
    for c in range(len(chosen)):
        own = np.flatnonzero(part == c)
        if len(own):
            found.add(int(own[(vectors[own] @ vectors[own].mean(axis=0)).argmax()]))
    return np.array(sorted(found))


def expand(pairs_q: np.ndarray, pairs_node: np.ndarray, neighbours: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for all neighbours of each (query, node)."""
    left = first[pairs_node]
    count = first[pairs_node + 1] - left
    at = np.repeat(left, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(pairs_q, count), neighbours[at]


def range_search(queries: np.ndarray, vectors: np.ndarray, neighbours: np.ndarray, first: np.ndarray, starts: np.ndarray, least: float, beam: int = 16, slack: float = 0.04) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with similarity >= least that a greedy search finds.

    Best-first search from the medoids keeps a beam of nodes; then every node in range, or `slack` short of it,
    is expanded until no new one turns up.
    """
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n), bool)
    every = np.arange(q)
    ids = np.tile(starts, (q, 1))
    sims = queries @ vectors[starts].T
    seen[:, starts] = True
    opened = np.zeros(ids.shape, bool)
    hits_q, hits_n, hits_s = [np.repeat(every, len(starts))], [ids.ravel()], [sims.ravel()]
    while True:
        best = np.where(opened, -np.inf, sims)
        at = best.argmax(axis=1)
        todo = np.flatnonzero(best[every, at] > -np.inf)
        if len(todo) == 0:
            break
        opened[todo, at[todo]] = True
        qs, ns = expand(todo, ids[todo, at[todo]], neighbours, first)
        new = ~seen[qs, ns]
        qs, ns = qs[new], ns[new]
        if len(qs) == 0:
            continue
        seen[qs, ns] = True
        s = np.einsum("id,id->i", queries[qs], vectors[ns])
        near = s >= least - slack
        hits_q.append(qs[near])
        hits_n.append(ns[near])
        hits_s.append(s[near])
        # new nodes stand beside the beam, and the best of both stay
        order = np.lexsort((-s, qs))
        qs, ns, s = qs[order], ns[order], s[order]
        rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
        width = int(rank.max()) + 1
        more_ids, more_sims = np.zeros((q, width), ids.dtype), np.full((q, width), -np.inf)
        more_ids[qs, rank], more_sims[qs, rank] = ns, s
        ids, sims = np.concatenate([ids, more_ids], axis=1), np.concatenate([sims, more_sims], axis=1)
        opened = np.concatenate([opened, np.isinf(more_sims)], axis=1)
        if ids.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, opened = (np.take_along_axis(x, top, 1) for x in (ids, sims, opened))
    hit_q, hit_n, hit_s = np.concatenate(hits_q), np.concatenate(hits_n), np.concatenate(hits_s)
    near = hit_s >= least - slack
    hit_q, hit_n, hit_s = hit_q[near], hit_n[near], hit_s[near]
    front_q, front_n = hit_q, hit_n
    while len(front_q):
        qs, ns = expand(front_q, front_n, neighbours, first)
        new = ~seen[qs, ns]
        qs, ns = qs[new], ns[new]
        if len(qs) == 0:
            break
        key = np.unique(qs * n + ns)
        qs, ns = key // n, key % n
        seen[qs, ns] = True
        s = np.einsum("id,id->i", queries[qs], vectors[ns])
        near = s >= least - slack
        front_q, front_n = qs[near], ns[near]
        hit_q, hit_n, hit_s = np.concatenate([hit_q, front_q]), np.concatenate([hit_n, front_n]), np.concatenate([hit_s, s[near]])
    good = hit_s >= least
    return hit_q[good], hit_n[good]


def exact_search(queries: np.ndarray, vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) pairs with similarity >= least."""
    return np.nonzero(queries @ vectors.T >= least)


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label in the component of each of n nodes with links (a, b)."""
    label = label.copy()
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    return label
