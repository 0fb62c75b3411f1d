"""Operator 3, near-duplicate embeddings with a robust-pruned flat graph.

Vectors with one label and dimension are clustered by centroids of a bounded
sample into cells of about `CELL_ROWS`.  A vector is indexed in the cell of its nearest
centroid and asks in every cell that can hold a vector in range: x lies in the cell of c
only if x.(h - c) <= 0 for every other centroid h, and a vector y within the angle t
of x has then y.(h - c) <= sin(t) |h - c|, with h the nearest centroid of y.  That bound
holds for every x.  The difference of two vectors in range points anywhere in the d
dimensions that the label's vectors fill, so its part along h - c is within `REACH`
standard deviations of sin(t) / sqrt(d); cells beyond that are left out at first.

In a cell, vectors stand in overlapping shards of about 400 (those of their two nearest
local centroids).  Each shard builds robust-pruned neighbour lists, and the lists united
are one flat graph of the cell.  Greedy search from its medoids, expanded through all
nodes in range, answers the vectors that ask, with cosine verified in double precision.

Cells and the vectors that ask in them are split by hash into parts of at most about
`SHARD_CAP`, which meet in blocks.  Each block audits its recall on `AUDIT` of its
queries by brute force; where that is below `LEAST_RECALL`, it is answered by brute
force.  About `AUDIT_ROWS` vectors are then compared with all vectors of their label;
if one label's recall is below `LEAST_RECALL`, every vector asks in all cells that the
bound allows, and all blocks are answered by brute force, which loses no link.

Exact copies (one label, equal components) are searched once and counted by their
number.  Components join over the tasks' local ones (see graph.py).

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite
component link with nothing, nor do rows with a null label or vec_id; such a row
is its own component (null for a null vec_id) and kept; vectors of different
lengths don't link; repeated rows are vectors of their own; an empty table gives
no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import flat_graph, textkit
from cadenza.llm.graph import components
from cadenza.llm.storage import saved

U = np.uint64
LEAST = 0.98
#: Vectors that centroids are fitted on, at most; vectors a cell should have, and sampled ones behind a centroid, at least.
SAMPLE_ROWS, CELL_ROWS, SUPPORT = 20_000, 3000, 4
SHARD_CAP = 4096
#: Standard deviations of a link's part along the line of two centroids within which a cell is asked.
REACH = 4.0
#: Queries that a block audits; queries that are audited against their whole label; share of links to be found.
AUDIT, AUDIT_ROWS, LEAST_RECALL = 32, 1024, 0.995


def unit(column: pa.Array, rows: int) -> np.ndarray:
    """[rows, dimension] unit vectors of a list column without nulls and of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(np.float64).reshape(rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding as doubles, h1 and h2 of its components; the hashes are null for what can't link."""
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))  # -0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), plain.alias("embedding"))
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))
    return rows.withColumns({"h1": F.when(good, F.xxhash64(F.size(x), x)), "h2": F.when(good, F.xxhash64(F.lit(43), F.reverse(x)))})


def groups(vectors: DataFrame) -> DataFrame:
    """label, h1, h2 (of the components), rep, copies, embedding: one row for equal vectors that can link."""
    rows = keyed(vectors).filter("h1 is not null")
    return rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))


def sampled(rows: DataFrame, total: int, sample: int, seed: int) -> list:
    """label, rep, embedding of about 0.9 * sample of the rows, by hash of rep."""
    part = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(min(1.0, 0.9 * sample / max(1, total)) * (1 << 40)))
    return rows.filter(part).select("label", "rep", "embedding").limit(sample).collect()  # the limit is never met but for chance


def clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors, in slices of bounded size."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    step = max(1, (1 << 22) // k)
    for _ in range(rounds if k > 1 else 0):
        own = np.concatenate([(x[a : a + step] @ c.T).argmax(axis=1) for a in range(0, len(x), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def dimensions(x: np.ndarray) -> float:
    """How many dimensions the vectors fill: (sum of variances) ** 2 / sum of their squares, along the principal axes."""
    v = np.linalg.eigvalsh(np.cov(x.T).reshape(x.shape[1], x.shape[1])) if len(x) > 1 else np.ones(1)
    return float(v.sum() ** 2 / max((v**2).sum(), 1e-300)) or 1.0


def centroids(rows: DataFrame, sample: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> dict[tuple, tuple[int, np.ndarray, float]]:
    """{(label, dimension): (number of its first cell, centroids, share of the bound to ask within)} from a sample by hash of rep."""
    total = rows.count()
    picked = sampled(rows, total, sample, 47)
    by: dict[tuple, list] = {}
    for r in sorted(picked, key=lambda r: r.rep):
        by.setdefault((r.label, len(r.embedding)), []).append(r.embedding)
    out, number = {}, 0
    for key in sorted(by, key=str):
        x = np.array(by[key], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = max(1, min(len(x) // SUPPORT, round(total * len(x) / max(1, len(picked)) / cell_rows)))
        out[key] = (number, clustered(x, k), min(1.0, REACH / max(1.0, dimensions(x)) ** 0.5))
        number += k
    return out


def reached(x: np.ndarray, c: np.ndarray, least: float = LEAST, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each unit vector, and [rows, centroids] whether a cell can hold a vector in range (within that share of the bound)."""
    near = x @ c.T
    home = near.argmax(axis=1)
    square = (c**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[home][:, None] + square - 2 * c[home] @ c.T, 0))
    return home, near[np.arange(len(x)), home][:, None] - near <= share * np.sqrt(1 - least**2) * apart + 1e-6  # for rounding


def assigned(rows: DataFrame, fitted: dict, least: float = LEAST, whole: bool = False) -> DataFrame:
    """rep, copies, embedding, home (the cell that has it), asks array<bigint> (the cells it asks; with `whole`, all that the bound allows).

    Labels that the sample missed have one cell each, by hash, below 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        labels, lists = part.column(0).to_pylist(), part.column(3)
        home = np.zeros(part.num_rows, np.int64)
        asks: list = [None] * part.num_rows
        sizes = np.asarray(lists.value_lengths())
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(labels, sizes.tolist())):
            by.setdefault(key, []).append(i)
        for key, at in by.items():
            if key in shared.value:
                base, c, share = shared.value[key]
                x = unit(lists.take(pa.array(at)), len(at))
                step = max(1, (1 << 22) // len(c))
                for a in range(0, len(at), step):
                    nearest, can = reached(x[a : a + step], c, least, 1.0 if whole else share)
                    home[at[a : a + step]] = nearest + base
                    for i, row in zip(at[a : a + step], can):
                        asks[i] = (np.flatnonzero(row) + base).tolist()
            else:
                low = -1 - zlib.crc32(str(key).encode())
                home[at] = low
                for i in at:
                    asks[i] = [low]
        return pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists, pa.array(home), pa.array(asks, pa.list_(pa.int64()))], ["rep", "copies", "embedding", "home", "asks"])

    schema = "rep bigint, copies bigint, embedding array<double>, home bigint, asks array<bigint>"
    return rows.select("label", "rep", "copies", "embedding").mapInArrow(lambda batches: (run(b) for b in batches if b.num_rows), schema)


def search(table: pa.Table, least: float = LEAST, audit: int = AUDIT, exact: bool = False) -> pa.Table:
    """Links of a block's asking vectors among its indexed ones: rep, links, low (the smallest rep of the local component), of those that have any."""
    asks = np.asarray(table["asks"])
    reps, copies = np.asarray(table["rep"]), np.asarray(table["copies"])
    x = unit(table["embedding"], table.num_rows)
    indexed, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])
    if len(indexed) == 0 or len(asking) == 0:
        return schema.empty_table()
    step = max(64, (1 << 22) // max(1, len(indexed)))
    if not exact:
        q, n = (np.concatenate(p) for p in zip(*_by_graph(x[asking], x[indexed], step, least)))
        sample = np.argsort(textkit.mix(reps[asking].view(U)))[:audit]
        true_q, true_n = flat_graph.exact_search(x[asking[sample]], x[indexed], least)
        exact = np.isin(sample[true_q] * len(indexed) + true_n, q * len(indexed) + n).sum() < LEAST_RECALL * len(true_q)
    if exact:
        parts = [flat_graph.exact_search(x[asking[a : a + step]], x[indexed], least) for a in range(0, len(asking), step)]
        q, n = np.concatenate([p[0] + a * step for a, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])
    nodes, node = np.unique(reps, return_inverse=True)
    a, b = node[asking[q]], node[indexed[n]]
    other = a != b
    a, b, n = a[other], b[other], n[other]
    links = np.bincount(a, copies[indexed[n]], len(nodes)).astype(np.int64)
    low = flat_graph.local_components(len(nodes), a, b, nodes)
    some = np.flatnonzero((links > 0) | (low != nodes))
    return pa.table([pa.array(nodes[some]), pa.array(links[some]), pa.array(low[some])], schema=schema)


def _by_graph(queries: np.ndarray, vectors: np.ndarray, step: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) pairs in range that searches in the graph of the vectors find, for each step of the queries."""
    neighbours, first = flat_graph.united(vectors)
    starts = flat_graph.medoids(vectors)
    out = []
    for a in range(0, len(queries), step):
        q, n = flat_graph.range_search(queries[a : a + step], vectors, neighbours, first, starts, least)
        out.append((q + a, n))
    return out


def blocks(rows: DataFrame, cap: int = SHARD_CAP) -> DataFrame:
    """shard, i, j, asks, rep, copies, embedding: part i of the vectors that ask in a shard, and part j of those that it has, for all i and j."""
    # a shard that nobody has answers nothing
    asked = rows.select(F.explode("asks").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / cap).cast("int").alias("askers"))
    had = rows.groupBy(F.col("home").alias("shard")).agg(F.ceil(F.count("*") / cap).cast("int").alias("parts"))
    sizes = had.join(asked, "shard")

    def placed(each: DataFrame, asks: bool) -> DataFrame:
        own, other = ("askers", "parts") if asks else ("parts", "askers")
        mine, all_ = F.pmod(F.xxhash64("rep", F.lit(53)), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (mine, all_) if asks else (all_, mine)
        return each.join(sizes, "shard").select("shard", i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"), "rep", "copies", "embedding")

    columns = ["rep", "copies", "embedding"]
    has = placed(rows.select(F.col("home").alias("shard"), *columns), False)
    return has.unionByName(placed(rows.select(F.explode("asks").alias("shard"), *columns), True))


def link(vectors: DataFrame, least: float = LEAST, cap: int = SHARD_CAP) -> tuple[DataFrame, DataFrame]:
    """(groups of equal vectors, their links: rep, links, low of a block)."""
    found = saved(groups(vectors))
    fitted = centroids(found)

    def searched(exact: bool) -> DataFrame:
        rows = saved(assigned(found, fitted, least, whole=exact))
        return saved(blocks(rows, cap).groupBy("shard", "i", "j").applyInArrow(lambda t: search(t, least, exact=exact), "rep bigint, links bigint, low bigint"))

    links = searched(False)
    if audit(found, links, least) < LEAST_RECALL:
        links = searched(True)
    return found, links


def audit(found: DataFrame, links: DataFrame, least: float = LEAST, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of sampled vectors with all vectors of their label that were found, in the worst label (1 without links)."""
    by: dict[tuple, list] = {}
    for r in sampled(found, found.count(), rows, 59):
        by.setdefault((r.label, len(r.embedding)), []).append(r)
    sample = {}
    for key, picked in by.items():
        x = np.array([r.embedding for r in picked], float)
        sample[key] = np.array([r.rep for r in picked], np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(sample)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        reps, copies, lists = np.asarray(part.column(1)), np.asarray(part.column(2)), part.column(3)
        places: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(part.column(0).to_pylist(), lists.value_lengths().to_pylist())):
            places.setdefault(key, []).append(i)
        out, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key in places.keys() & shared.value.keys():
            at = np.array(places[key])
            own, x = shared.value[key]
            near = (x @ unit(lists.take(pa.array(at)), len(at)).T >= least) & (own[:, None] != reps[at])
            out.append(own)
            counts.append((near * copies[at]).sum(axis=1))
        ids, count = np.concatenate(out), np.concatenate(counts)
        return pa.RecordBatch.from_arrays([pa.array(ids[count > 0]), pa.array(count[count > 0])], ["rep", "links"])

    every = found.select("label", "rep", "copies", "embedding").mapInArrow(lambda batches: (run(b) for b in batches if b.num_rows), "rep bigint, links bigint")
    true = dict(every.groupBy("rep").agg(F.sum("links")).collect())
    if not true:
        return 1.0
    chosen = spark.createDataFrame([(r,) for r in true], "rep bigint")
    got = dict(links.join(F.broadcast(chosen), "rep").groupBy("rep").agg(F.sum("links")).collect())
    shares = []
    for reps, _ in sample.values():
        asked = sum(true.get(int(r), 0) for r in reps)
        shares.append(sum(min(true.get(int(r), 0), got.get(int(r), 0)) for r in reps) / asked if asked else 1.0)
    return min(shares)


def near_duplicates(vectors: DataFrame, least: float = LEAST, cap: int = SHARD_CAP) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    found, links = link(vectors, least, cap)
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("rep").alias("u"), F.col("low").alias("v")).filter("u <> v")).withColumnRenamed("node", "rep")
    known = found.join(counts, "rep", "left").join(joined, "rep", "left").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed(vectors).select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
