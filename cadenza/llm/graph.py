"""Connected components of links, by alternating large and small stars.

Both steps are joins and distinct aggregations over rows of two ids, so no
component, however large, meets in one task: the rows of a hub are spread by the
join's skew handling and the minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.storage import compact, saved


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For edges (u, v) of bigint ids: node, component (its smallest id), for every node that has an edge."""
    plain = edges.filter("u is not null and v is not null")
    alone = plain.filter("u = v").select(F.col("u").alias("node"))
    edges, n = compact(saved(plain.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    before = _digest(edges)
    for _ in range(rounds):
        if not n:
            break
        pieces = max(1, -(-n // 50_000))  # what n edges need
        # large star: the larger neighbours of u go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * pieces)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(2 * pieces).distinct().coalesce(pieces)
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).coalesce(pieces)
        edges, n = compact(saved(small.distinct()))
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
