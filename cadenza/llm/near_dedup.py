"""Operator 6, near-duplicate documents by ProbMinHash.

A document is its five-word shingles with their counts as weights.  Each element
of weight w sends arrivals at the times of a Poisson process of rate w, each to
one of `REGISTERS` registers; a register keeps its earliest arrival's element.
Generation stops once no arrival can still change a register: times beyond a
bound that fills all registers of nearly every document are not generated, and
the few documents with an empty register go on to twice the bound.  Two
documents agree in a register with the probability Jaccard index

    J_P = sum over common i of 1 / (sum over j of max(a_j / a_i, b_j / b_i)),

which is the Jaccard index where no shingle repeats.  Registers are banded, and
links are verified by the exact index of the texts.

1. Exact copies (same words in the same order) collapse to their smallest doc_id.
2. In every bucket of a band the members are candidates with the smallest member:
   a star, not all pairs.  Candidates whose registers agree enough (`SLACK` below
   the threshold) are verified; links give components.
3. Buckets that still hold members of more than one component get further stars
   around random members, as long as those join components; then they are completed:
   members of different components are candidates, found by comparing registers in
   blocks and verified inside the tasks, which only links leave.  So every pair in a common bucket is linked, or verified, or
   joined through other links, and the classes are those of all pairs.

Result: one row a document with its class, the smallest doc_id of its component.

Defined cases: null and empty texts, and texts of white space, are classes of
their own; a text of fewer than five words is one shingle of all its words;
repeated rows are copies; a null doc_id has a null class; an empty table gives no
rows.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.graph import components
from cadenza.llm.storage import compact, saved

U = np.uint64
WORDS, THRESHOLD = 5, 0.8
#: 20 bands of 5 registers: a pair at 0.8 shares no bucket with probability 0.0004.
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Registers estimate J_P with a standard error of 0.04 at 0.8; four of these below the threshold are not verified.
SLACK = 0.16
#: Rounds of stars around random members of the buckets that are still mixed; they end once fewer than a fifth of the members outside join.
ROUNDS, LEADERS, SHRINK = 8, 4, 0.8
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 1024
#: Ids that are broadcast to pick rows of documents, at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def counted(shingle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, and each row's first index."""
    own = textkit.owners(first)
    order = np.lexsort((shingle, own)) if len(first) > 1 << 15 else np.argsort((own.astype(U) << U(49)) | (shingle >> U(15)), kind="stable")
    shingle, own = shingle[order], own[order]
    start = np.ones(len(shingle), bool)
    start[1:] = (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(start)
    return shingle[at], np.diff(np.append(at, len(shingle))), np.searchsorted(own[at], np.arange(len(first)))


def signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """[rows, registers] elements with the earliest arrivals; rows without elements stay 0."""
    rows = len(first) - 1
    best = np.full(rows * registers, np.inf)
    out = np.zeros(rows * registers, U)
    own = textkit.owners(first)
    total = textkit.row_sums(weight, first)
    bound = registers * (np.log(registers) + 4) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(rows, bool)
        chosen[todo] = True
        active = np.flatnonzero(chosen[own])
        seed, when = element[active], np.zeros(len(active))
        cells, times, which = [], [], []
        while len(active):
            seed = seed + U(0x9E3779B97F4A7C15)
            draw = textkit.mix(seed)
            when = when - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
            alive = when <= bound[own[active]]
            active, seed, when, draw = active[alive], seed[alive], when[alive], draw[alive]
            register = (textkit.mix(draw ^ U(0xA0761D6478BD642F)) % U(registers)).astype(np.int64)
            cells.append(own[active] * registers + register)
            times.append(when)
            which.append(active)
        cell, time, at = np.concatenate(cells), np.concatenate(times), np.concatenate(which)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        out[cell[won]] = element[at[won]]
        empty = np.isinf(best.reshape(rows, registers)[todo]).any(axis=1)
        todo = todo[empty]  # their earlier arrivals come again, the same ones
        bound[todo] *= 2
    return out.reshape(rows, registers)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, fp (of the words in order), bands array<bigint>, sig (16 bits a register); null bands for texts without words."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, words = textkit.word_hashes(part.column(1))
        at = np.arange(len(hashes)).astype(U) - np.repeat(words[:-1].astype(U), np.diff(words))
        has = np.diff(words) > 0
        prints = []
        for k in (1, 2):
            mixed = textkit.mix(hashes * (textkit.mix(at + U(k << 40)) | U(1)))
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed, dtype=U)])
            prints.append(sums[words[1:]] - sums[words[:-1]])
        fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(has), [None, pa.py_buffer(np.stack(prints, axis=1).tobytes())]).cast(pa.binary())
        sig = signatures(*counted(*textkit.shingles(hashes, words, WORDS)))
        band = textkit.mix(np.arange(1, BANDS + 1, dtype=U))
        for r in range(ROWS):
            band = textkit.mix(band + sig[:, r::ROWS] * U(2 * r + 3))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(band.ravel().view(np.int64)), mask=pa.array(~has))
        short = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(has), [None, pa.py_buffer((sig >> U(48)).astype(np.uint16).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([part.column(0), fp, lists, short], ["doc_id", "fp", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(textkit.mapper(run), "doc_id bigint, fp binary, bands array<bigint>, sig binary")


def agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose registers agree in a share of at least `least`."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
        good = pa.array((a == b).mean(axis=1) >= least)
        return pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    sig = reps.select("rep", "sig")
    rows = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return rows.mapInArrow(lambda batches: (run(x) for x in batches if x.num_rows), "a bigint, b bigint")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two (sorted distinct elements, weights)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, both = x[order], y[order], ratio[order], both[order]
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(y)])
    at = np.searchsorted(ratio, ratio[both], "right")  # the first with a larger ratio
    return float((1 / (above[at] / x[both] + below[at] / y[both])).sum())


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows of docs with an id in ids (distinct doc_id): by broadcast if they are few, else by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have J_P >= threshold."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for i in (2, 3):
            codes = part.column(i).dictionary_encode()  # a text stands in many pairs
            shingle, weight, first = counted(*textkit.set_words(codes.dictionary, WORDS))
            at = codes.indices.to_numpy(zero_copy_only=False)
            sides.append([(shingle[first[k] : first[k + 1]], weight[first[k] : first[k + 1]]) for k in at])
        good = pa.array([similarity(a, b) >= threshold - 1e-12 for a, b in zip(*sides)], pa.bool_())
        return pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = pick(docs, ids)
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(textkit.mapper(run, 2), "a bigint, b bigint")


def mixed(inside: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, b, component, low of the buckets whose members are in several components (low is the smallest)."""
    named = inside.select("bucket", "b").join(found.toDF("b", "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket", "low")
    return compact(saved(named.join(several, "bucket")))[0]


def likely(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (a, b) and agreement of the pairs of a block that are in different components, agree enough, and meet first in this bucket."""
    parts, names = np.asarray(table["part"]), np.asarray(table["component"])
    bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    i, j, bucket = (table[c][0].as_py() for c in ("i", "j", "bucket"))
    x, y = np.flatnonzero(parts == i), np.flatnonzero(parts == j)
    agree = np.zeros((len(x), len(y)), np.uint8)
    for r in range(REGISTERS):
        agree += sig[x, r][:, None] == sig[y, r][None, :]
    good = (agree >= least * REGISTERS) & (names[x][:, None] != names[y][None, :])
    if i == j:
        good = np.triu(good, 1)
    a, b = np.nonzero(good)
    agree = agree[a, b]
    a, b = x[a], y[b]
    same = bands[a] == bands[b]
    first = bands[a, same.argmax(axis=1)] == bucket if len(a) else np.zeros(0, bool)
    order = np.argsort(-agree[first].astype(int), kind="stable")
    return a[first][order], b[first][order], agree[first][order]


def completed(open_: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all components whose members have a link and a common bucket.

    Registers are compared in blocks of at most `block` by `block` members.  Texts
    follow only for members with a likely pair, and the pairs are verified inside
    the task; of those, links that join what other links of the block have joined
    already are not needed, so no more links leave a block than it has members.
    """
    keys = "bucket bigint, i int, j int, b bigint, component bigint, part int, bands array<bigint>, sig binary"

    def narrow(table: pa.Table) -> pa.Table:
        a, b, _ = likely(table, threshold - slack)
        return table.select(["bucket", "i", "j", "b", "component", "part", "bands", "sig"]).take(pa.array(np.unique(np.concatenate([a, b]))))

    def verify(table: pa.Table) -> pa.Table:
        a, b, _ = likely(table, threshold - slack)
        shingle, weight, first = counted(*textkit.set_words(table["text"].combine_chunks(), WORDS))
        ids = np.asarray(table["b"])
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            if p == q:
                continue
            sides = [(shingle[first[k] : first[k + 1]], weight[first[k] : first[k + 1]]) for k in (x, y)]
            if similarity(*sides) >= threshold - 1e-12:
                root[max(p, q)] = min(p, q)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    sizes = open_.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = open_.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("b", F.lit(59)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("bucket", "b", "component", "part", other.alias("o")).select("bucket", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "b", "component", "part")
    rows = rows.join(reps.select(F.col("rep").alias("b"), "bands", "sig"), "b")
    rows, _ = compact(saved(rows.groupBy("bucket", "i", "j").applyInArrow(narrow, keys)), 5000)
    texts = pick(docs, rows.select(F.col("b").alias("doc_id")).distinct())
    return rows.join(texts.toDF("b", "text"), "b").groupBy("bucket", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (doc_id is class_id) of every row of docs."""
    rows = saved(sketch(docs))
    known = rows.filter("bands is not null and doc_id is not null")
    reps = saved(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sig", "doc_id").alias("sig")))

    members = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("bucket", "a")
    inside, _ = compact(saved(members.join(shared, "bucket").select("bucket", "a", F.col("rep").alias("b"))))
    stars, _ = compact(saved(inside.filter("a < b").select("a", "b").distinct()))
    near, _ = compact(saved(agreeing(stars, reps, threshold - SLACK)))
    links, _ = compact(saved(verified(near, docs, threshold)))
    found = components(links.toDF("u", "v"))

    # buckets that hold members of several components: stars around a few random members, while that joins components
    tested, before = stars, None
    for seed in range(ROUNDS):
        open_ = mixed(inside, found)
        rest = open_.filter("component <> low").count()
        if not rest or (before is not None and rest > SHRINK * before):
            break
        before = rest
        leaders = open_.groupBy("bucket").agg(F.array(*(F.min_by(F.struct("b", "component"), F.xxhash64("b", F.lit(100 * seed + i))) for i in range(LEADERS))).alias("leaders"))
        more = open_.join(leaders.select("bucket", F.explode("leaders").alias("l")), "bucket").filter("component <> l.component").select(F.least("b", "l.b").alias("a"), F.greatest("b", "l.b").alias("b"))
        more, _ = compact(saved(more.distinct().join(tested, ["a", "b"], "left_anti")))
        near, _ = compact(saved(agreeing(more, reps, threshold - SLACK)))
        links, _ = compact(saved(links.unionByName(verified(near, docs, threshold))))
        found = components(links.toDF("u", "v"))
        tested = tested.unionByName(more)
    # what is left is tested in full
    more, n = compact(saved(completed(mixed(inside, found), reps, docs, threshold)))
    if n:
        found = components(links.unionByName(more).toDF("u", "v"))
    ids = reps.select("fp", "rep").join(found.toDF("rep", "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("fp")).alias("fp")).join(ids, "fp", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
