"""What the two exact Lloyd operators share: integer vectors, blocks of rows, nearest centroids, checked sums.

A component x becomes floor(scale * x) as an integer of at most `MOST` either way, so that
squared distances, their sums over 64 components and products of such sums fit into 64 bits;
a larger one is an error that names it, since its distances have no exact value in a bigint.
Where a matrix product of doubles is exact (all partial sums below 2 ** 53) it is used; other
values take the way over differences of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest component.
MOST = 1 << 27
#: Rows of a block, at most.
BLOCK_ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as array<bigint>, in double precision."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def points(column: pa.Array, scale: int) -> np.ndarray:
    """[rows, dimension] integers of a column of finite vectors of one length."""
    x = np.floor(np.asarray(column.flatten()).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"component {x[np.abs(x).argmax()]:.0f} (times {scale}) is beyond {MOST}: its squared distances don't fit into a bigint")
    return x.astype(np.int64).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of `rows` (the last one smaller)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[rows, centroids] exact squared distances as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * 4 * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def floor_means(sums: list[list[int]], counts: list[int], old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every non-empty group; an empty one keeps what it had."""
    return np.array([[s // n for s in row] if n else list(was) for row, n, was in zip(sums, counts, old)], np.int64).reshape(old.shape)


def summed(parts: DataFrame, keys: list[str], width: int) -> list:
    """Rows of `keys`, n and sums (array), added up over all rows with equal keys; the keys are few by contract."""
    sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width)))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), sums.alias("sums")).collect()
