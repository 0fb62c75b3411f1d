"""Operator 8, benchmark decontamination by size-partitioned MinHash containment search.

Test items (short) are looked for inside documents (of any length).  Items are
partitioned by size: class L holds items of L/2 < q <= L distinct five-word
shingles.  For each class, a document is a sequence of windows of 3/2 L
consecutive shingles, L/2 apart, so that a passage of up to L shingles lies whole
in one of them; at containment t the Jaccard index of item and window is then at
least t q / (3/2 L + (1 - t) q), whatever the document's length.  The number of
MinHash registers of a class follows from that bound, so that a window with
containment t shares no register's minimum with its item with probability below
`MISS`.  Every shared minimum is a candidate, and each candidate is verified by
exact containment: the share of the item's distinct shingles that the document has.

Every task gets one block of items (`ITEMS_IN_BLOCK` at most, so of bounded size)
and reads its documents once per block: a stated query set against all rows, in
blocks, without a shuffle of texts.

Defined cases: null and empty texts of either table match nothing; an item of
fewer than five words has one shingle of all its words and is found in documents
that consist of just those; items with equal texts are all reported; null ids are
left out; an item with several texts is found by each of them; repeated documents and
items with one id give one row, with the largest containment; an empty table
gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit

U = np.uint64
WORDS = 5
#: Probability that a window with the wanted containment is no candidate.
MISS = 1e-5
ITEMS_IN_BLOCK = 50_000
_BITS = 16
SCHEMA = "item_id bigint, doc_id bigint, containment double"


@dataclass
class SizeClass:
    """Items of L / 2 < q <= L shingles: their minima by register, sorted, and which items have each."""

    half: int  # L / 2 shingles, the length of a block
    factors: np.ndarray  # one odd multiplier a register
    maybe: list[np.ndarray]  # a register's table of 2 ** _BITS flags
    minima: list[np.ndarray]
    items: list[np.ndarray]


@dataclass
class Index:
    ids: np.ndarray
    sets: list[np.ndarray]  # sorted distinct shingles of each item
    classes: list[SizeClass]
    threshold: float


def build(ids: list[int], texts: list[str], threshold: float = 0.8, words: int = WORDS, miss: float = MISS) -> Index:
    shingle, first = textkit.set_words(pa.array(texts, pa.string()), words)
    sets = [np.unique(shingle[first[i] : first[i + 1]]) for i in range(len(texts))]
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            groups.setdefault(1 << max(1, math.ceil(math.log2(len(s)))), []).append(i)
    classes = []
    for size, members in sorted(groups.items()):
        q = size / 2 + 1
        jaccard = threshold * q / (1.5 * size + (1 - threshold) * q)
        registers = math.ceil(math.log(miss) / math.log(1 - jaccard))
        factors = textkit.mix(np.arange(1, registers + 1, dtype=U) + U(size << 20)) | U(1)
        c = SizeClass(size // 2, factors, [], [], [])
        for a in factors:
            low = np.array([(sets[i] * a).min() for i in members], U)
            order = np.argsort(low, kind="stable")
            flags = np.zeros(1 << _BITS, bool)
            flags[_slot(low)] = True
            c.maybe.append(flags)
            c.minima.append(low[order])
            c.items.append(np.array(members)[order])
        classes.append(c)
    return Index(np.array(ids, np.int64), sets, classes, threshold)


def _slot(x: np.ndarray) -> np.ndarray:
    return ((x >> U(8)) & U((1 << _BITS) - 1)).astype(np.int64)


def candidates(index: Index, shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct (document, item) rows whose window and item share a register's minimum."""
    found = []
    lengths = np.diff(first)
    for c in index.classes:
        blocks = -(-lengths // c.half)
        begin = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(lengths)), blocks)
        if len(owner) == 0:
            continue
        start = first[:-1][owner] + (np.arange(len(owner)) - begin[owner]) * c.half
        last = np.zeros(len(owner), bool)
        last[begin[1:][blocks > 0] - 1] = True
        after = np.flatnonzero(~last[:-1]) if len(last) > 1 else np.zeros(0, np.int64)
        for r, a in enumerate(c.factors):
            low = np.minimum.reduceat(shingle * a, start)
            two = low.copy()  # a window is a block and the two behind it, within the document
            two[after] = np.minimum(low[after], low[after + 1])
            window = low.copy()
            window[after] = np.minimum(low[after], two[after + 1])
            hit = np.flatnonzero(c.maybe[r][_slot(window)])
            if len(hit) == 0:
                continue
            left = np.searchsorted(c.minima[r], window[hit], "left")
            right = np.searchsorted(c.minima[r], window[hit], "right")
            count = right - left
            if count.sum():
                at = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found.append(np.stack([np.repeat(owner[hit], count), c.items[r][at]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def search(index: Index, column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a text column, items and containments of all verified pairs."""
    shingle, first = textkit.set_words(column, words)
    pairs = candidates(index, shingle, first)
    docs, items, values = [], [], []
    for d in np.unique(pairs[:, 0]):
        own = shingle[first[d] : first[d + 1]]
        own = np.unique(own)
        for i in pairs[pairs[:, 0] == d, 1]:
            share = np.isin(index.sets[i], own, assume_unique=True).mean()
            if share >= index.threshold:
                docs.append(d)
                items.append(i)
                values.append(share)
    return np.array(docs, np.int64), np.array(items, np.int64), np.array(values, float)


def item_blocks(benchmark: DataFrame, size: int = ITEMS_IN_BLOCK):
    """(ids, texts) of the items, in blocks of about `size` rows by a hash; an id with several texts is several rows."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    blocks = max(1, math.ceil(items.count() / (0.8 * size)))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows.sort()
        yield [r.item_id for r in rows], [r.text for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = WORDS, block: int = ITEMS_IN_BLOCK) -> DataFrame:
    """item_id, doc_id, containment of every pair with containment >= threshold."""
    spark = docs.sparkSession
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for ids, texts in item_blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(build(ids, texts, threshold, words))

        def run(part: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            at, item, share = search(index, part.column(1), words)
            return pa.RecordBatch.from_arrays([pa.array(index.ids[item]), part.column(0).take(pa.array(at)), pa.array(share)], ["item_id", "doc_id", "containment"])

        found = rows.mapInArrow(textkit.mapper(run), SCHEMA)
        out = found if out is None else out.unionByName(found)
    # an id whose document is repeated is one row; the pairs are few, the texts stay where they are
    return out.groupBy("item_id", "doc_id").agg(F.max("containment").alias("containment"))
