"""Order-dependent folds: over sorted arrays in the JVM, or along sorted rows with a small state.

A fold's rows are those of one key of one recording, or of one chain of near rows of
a recording: gaps that no state of the fold reaches across split it before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows by hash of some columns in all of the session's shuffle partitions.

    Adaptive execution joins small partitions by their bytes; in front of work that
    costs much a byte it would leave one task with all of a small table.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of a table that is broadcast after it was counted, at most.
BESIDE_ROWS = 200_000


def beside(rows: DataFrame, small: DataFrame, *by: str, how: str = "left") -> DataFrame:
    """rows joined with a table of one row a key: broadcast where it is counted as small, shuffled beyond; small is read twice, so it is a checkpoint or cheap."""
    return rows.join(F.broadcast(small) if small.count() <= BESIDE_ROWS else small, [*by], how)


def chains(rows: DataFrame, at: str, gap_us: int, by: tuple[str, ...] = ("recording_id",), ties: tuple[str, ...] = (), name: str = "__chain") -> DataFrame:
    """rows with the number of their chain (0, 1, ...): a new one begins where `at` is more than gap_us behind the row before."""
    w = Window.partitionBy(*by).orderBy(at, *ties)
    apart = F.coalesce(F.col(at) - F.lag(at).over(w) > gap_us, F.lit(False)).cast("bigint")
    return rows.withColumn(name, apart).withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def anchored_groups(rows: DataFrame, at: str, window_us: int, key: str, by: tuple[str, ...] = ("recording_id",), ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with group_no (1, 2, ...): a group holds the rows up to window_us behind its first one.

    A chain of near rows is not one group: distance counts from the anchor.  A gap of
    more than window_us begins a group whatever the anchor, so chains are folded apart.
    """
    near = chains(rows.select(*dict.fromkeys([*by, at, *ties, key])), at, window_us, by, (*ties, key))

    def step(state, t):
        anchor, no = state
        anchor, t = (None if x is None or x != x else x for x in (anchor, t))
        new = anchor is None or (t is not None and t - anchor > window_us)
        state = (t, no + 1) if new else (anchor, no)
        return state, (state[1],)

    found = carried(near, (*by, "__chain"), (at, *ties, key), (key,), (at,), lambda: (None, 0), step, "no bigint")
    # groups of the chains before
    sizes = found.groupBy(*by, "__chain").agg(F.max("no").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__chain").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    found = found.join(sizes, [*by, "__chain"]).select(*by, key, (F.col("no") + F.col("__before")).alias("group_no"))
    return rows.join(found, [*by, key])


def carried(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], keep: tuple[str, ...], given: tuple[str, ...], start: Callable, step: Callable, out: str) -> DataFrame:
    """by, keep and out of rows: step(state, *given) gives the next state and a row's values, from start() on for each key.

    A task reads its keys sorted, a batch at a time, and carries only the state on: time
    is linear in the rows of a key, and memory does not grow with them.
    """
    kinds = dict(rows.dtypes)
    names = [*by, *keep, *(c.strip().split(" ")[0].strip("`") for c in out.split(","))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, *keep)), out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            found = []
            for row in zip(zip(*(pdf[c] for c in by)), zip(*(pdf[c] for c in given))):
                if row[0] != current:
                    current, state = row[0], start()
                state, values = step(state, *row[1])
                found.append(values)
            columns = {c: pdf[c] for c in (*by, *keep)} | {c: pd.Series(list(x), index=pdf.index, dtype=object) for c, x in zip(names[len(by) + len(keep) :], zip(*found))}
            yield pd.DataFrame(columns, columns=names)

    needed = dict.fromkeys([*by, *order, *keep, *given])
    return rows.select(*needed).transform(lambda r: spread(r, *by)).sortWithinPartitions(*by, *order).select(*dict.fromkeys([*by, *keep, *given])).mapInPandas(run, schema)


#: Elements that an inner fold takes; the result is the same with any.
BLOCK = 128


def emitted(values: Column, start: Column, step: Callable, kind: str, finish: Callable | None = None, size: int = BLOCK) -> Column:
    """What a fold along an array gives out: step(state, x) is the next state and a value of type `kind`, or null for none; finish(state) is one more.

    aggregate() copies all that it has gathered at every step.  So a first pass carries the
    state alone and notes it where each block of `size` elements begins, and a second
    folds each block from there into an array of its own: no more than a block's
    values, or a state for each block, are ever copied.  A null array is an empty one.
    """
    n = F.floor((F.size(values) + size - 1) / size)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.slice(values, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array())
    none = F.expr(f"cast(array() as array<{kind}>)")

    def carry(acc: Column, xs: Column) -> Column:
        after = F.aggregate(xs, acc["state"], lambda state, x: step(state, x)[0])
        return F.struct(after.alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

    def one(acc: Column, x: Column) -> Column:
        state, given = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(given.isNotNull(), F.concat(acc["out"], F.array(given))).otherwise(acc["out"]).alias("out"))

    def gathered(carried: Column) -> Column:
        each = F.transform(blocks, lambda xs, i: F.aggregate(xs, F.struct(F.get(carried["starts"], i).alias("state"), none.alias("out")), one, lambda acc: acc["out"]))
        out = F.flatten(each)
        return out if finish is None else F.concat(out, F.filter(F.array(finish(carried["state"])), lambda x: x.isNotNull()))

    first = F.aggregate(blocks, F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("starts")), carry)
    # an array of one, so that the first pass is named and computed once
    return F.element_at(F.transform(F.array(first), gathered), 1)


def spaced(values: Column, gap_us: int) -> Column:
    """The values of an ascending array that are at least gap_us behind the last one kept."""

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        far = last.isNull() | (x - last >= gap_us)
        return F.when(far, x).otherwise(last), F.when(far, x)

    return emitted(values, F.lit(None).cast("bigint"), step, "bigint")
