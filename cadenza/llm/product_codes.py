"""Operator 12, product codes of vectors by Lloyd rounds with Hamerly's two bounds.

Vectors are cut into `PARTS` equal parts, and each part position has a codebook of `ENTRIES`
entries.  Per part the state is the entry it has, one upper bound of the distance to it and one
lower bound of the distance to the second nearest entry.  After an update the upper bound grows
by how far the own entry moved, and the lower bound shrinks by how far any other did.  A part
whose upper bound is strictly below its lower bound, or below half the distance from its entry
to the next one, keeps its entry without a distance being computed; where that fails, the upper
bound is made exact, and where it fails again, all entries are held against the part in exact
integers and the lower of equal indexes wins.  Bounds are floats rounded outwards, so rounding
can only cause a scan.

Rows travel in blocks of at most `integer_vectors.BLOCK_ROWS`.  A round is one pass over the blocks that
writes the next state with the block's sums to the shared folder; the sums, a column of their
own, are read back and added up to PARTS * ENTRIES rows; the state before it is removed.

Defined cases: vectors that are null or hold null or non-finite components are not returned; the length
of the codes is that of the vector with the smallest vec_id, and vectors of another length, or
all of them if it can't be cut into equal parts, come back with a null code and a null error; rows with a null
vec_id are coded but start no entry; repeated rows count each (equal vec_ids start entries in the
order of their components); with fewer vectors than entries there are fewer entries; an
empty table gives no rows; a component beyond 2 ** 27 after scaling is an error.  Null labels
are one label.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.integer_vectors import blocks, finite, floor_means, integers, points, squared, summed
from cadenza.llm.storage import removed, saved, shared_folder

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels whose sums are broadcast, at most; more are joined by a shuffle, each label dealt over SALTS keys.
BROADCAST_LABELS, SALTS = 1_000_000, 64
BLOCK = "ids binary, known binary, labels binary, points binary, own binary, upper binary, lower binary"
STATE = f"{BLOCK}, sums array<bigint>, counts array<bigint>, scans bigint"
KINDS = (np.int32, np.uint8, np.float32, np.float32)


@dataclass
class Books:
    """Codebooks [parts, entries, width], and how far each entry moved at the last update."""

    entries: np.ndarray
    moved: np.ndarray

    def halves(self) -> np.ndarray:
        """[parts, entries]: half the distance to the nearest other entry (0 where two are equal)."""
        out = np.full(self.entries.shape[:2], np.inf)
        for p, c in enumerate(self.entries):
            d = np.sqrt(squared(c, c).astype(np.float64))
            np.fill_diagonal(d, np.inf)
            out[p] = d.min(axis=1) / 2
        return out


def up(x: np.ndarray) -> np.ndarray:
    """Floats not below x."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Floats not above x."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals), upper bound and lower bound of the second nearest, from exact distances."""
    d = squared(x, c)
    own = d.argmin(axis=1)
    least = d[np.arange(len(x)), own].astype(np.float64)
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    second = d.min(axis=1).astype(np.float64) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return own.astype(np.uint8), up(np.sqrt(least)), down(np.sqrt(second))


def assigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A part's next state after its entries moved to c, and how many rows were scanned."""
    others = np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(c))])
    upper, lower = up(upper.astype(np.float64) + moved[own]), down(lower.astype(np.float64) - others[own])
    own = own.copy()
    open_ = np.flatnonzero(~(upper < np.maximum(lower, down(half)[own])))
    if len(open_):
        exact = ((x[open_] - c[own[open_]]) ** 2).sum(axis=1).astype(np.float64)
        upper[open_] = up(np.sqrt(exact))
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], down(half)[own[open_]]))]
    if len(open_):
        own[open_], upper[open_], lower[open_] = scan(x[open_], c)
    return own, upper, lower, len(open_)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) rows to blocks without a state."""
    for block in blocks(batches):
        ids, labels = block.column(0), block.column(1)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("label", labels.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([labels], ["label"]))
        none = b""
        values = [np.asarray(ids.fill_null(0)).tobytes(), np.asarray(ids.is_valid()).tobytes(), sink.getvalue().to_pybytes(), points(block.column(2), SCALE).astype(np.int32).tobytes(), none, none, none]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], [c.split()[0] for c in BLOCK.split(", ")])
    textkit.let_go()


def advance(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """Blocks to blocks with every part assigned to its codebook's nearest entry, and their sums and counts."""
    parts, entries, width = books.entries.shape
    half = books.halves()
    for batch in batches:
        for i in range(batch.num_rows):
            x, own, upper, lower = (np.frombuffer(batch.column(3 + j)[i].as_buffer(), kind) for j, kind in enumerate(KINDS))
            x = x.reshape(-1, parts, width).astype(np.int64)
            begun = len(own) > 0
            own, upper, lower = (v.reshape(-1, parts).copy() if begun else np.zeros(x.shape[:2], v.dtype) for v in (own, upper, lower))
            sums, counts, scans = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64), 0
            for p in range(parts):
                if begun:
                    own[:, p], upper[:, p], lower[:, p], looked = assigned(x[:, p], own[:, p], upper[:, p], lower[:, p], books.entries[p], books.moved[p], half[p])
                else:
                    own[:, p], upper[:, p], lower[:, p] = scan(x[:, p], books.entries[p])
                    looked = len(x)
                scans += looked
                counts[p] = np.bincount(own[:, p], minlength=entries)
                for k in np.flatnonzero(counts[p]):
                    sums[p, k] = x[own[:, p] == k, p].sum(axis=0)
            state = [pa.array([v.tobytes()], pa.binary()) for v in (own, upper, lower)]
            lists = [pa.array([v.ravel().tolist()], pa.list_(pa.int64())) for v in (sums, counts)]
            same = [batch.column(j).slice(i, 1) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*same, *state, *lists, pa.array([scans], pa.int64())], [c.split()[0] for c in STATE.split(", ")])
    textkit.let_go()


def coded(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code, error of every row of the blocks."""
    parts, _, width = books.entries.shape
    for batch in batches:
        for i in range(batch.num_rows):
            ids, known = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.int64, bool)))
            label = pa.ipc.open_stream(batch.column(2)[i].as_buffer()).read_all().column(0).combine_chunks()
            x, own = (np.frombuffer(batch.column(3 + j)[i].as_buffer(), kind) for j, kind in enumerate(KINDS[:2]))
            x, own = x.reshape(-1, parts, width).astype(np.int64), own.reshape(-1, parts)
            error = ((x - books.entries[np.arange(parts), own]) ** 2).sum(axis=(1, 2))
            code = own.tobytes().hex()
            digits = 2 * parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), label, pa.array([code[at : at + digits] for at in range(0, len(code), digits)]), pa.array(error)], ["vec_id", "label", "code", "error"])
    textkit.let_go()


def first_books(good: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """[parts, entries, width] of the vectors with the smallest vec_ids; None if their length can't be cut into equal parts."""
    named = good.filter("vec_id is not null").select("vec_id", integers(F.col("embedding"), SCALE).alias("x"))
    top = named.orderBy("vec_id", "x").limit(1).collect()
    if not top or not top[0].x or len(top[0].x) % parts:
        return None
    picked = named.filter(F.size("x") == len(top[0].x)).orderBy("vec_id", "x").limit(entries).collect()
    return np.array([r.x for r in picked], np.int64).reshape(len(picked), parts, -1).swapaxes(0, 1)


def updated(state: DataFrame, books: Books) -> Books:
    """The codebooks after one update, from the blocks' sums."""
    parts, entries, width = books.entries.shape
    per = state.select(F.posexplode("counts").alias("at", "n"), "sums").filter("n > 0").select("at", "n", F.slice("sums", F.col("at") * width + 1, width).alias("sums"))
    found = {r.at: r for r in summed(per, ["at"], width)}
    at = range(parts * entries)
    flat = floor_means([list(found[k].sums) if k in found else [] for k in at], [found[k].n if k in found else 0 for k in at], books.entries.reshape(-1, width))
    flat = flat.reshape(books.entries.shape)
    return Books(flat, np.sqrt(((flat - books.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12))


def compress(vectors: DataFrame, rounds: int = ROUNDS, label: str = "label") -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """vec_id, label, code, error (saved), the final codebooks [parts, entries, width], and how many parts each assignment scanned."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).alias("label"), "embedding").filter(finite(F.col("embedding")))
    kind = dict(good.dtypes)["label"]
    first = first_books(good)
    without = good.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), "embedding")
    if first is None:
        return without.drop("embedding"), None, []
    books = Books(first, np.zeros(first.shape[:2]))
    length = first.shape[0] * first.shape[2]
    place = f"{shared_folder(spark).rstrip('/')}/codes-{uuid.uuid4()}"
    state = good.filter(F.size("embedding") == length).mapInArrow(pack, BLOCK)
    scans: list[int] = []
    for step in range(rounds + 1):
        state.mapInArrow(lambda batches, b=books: advance(batches, b), STATE).write.parquet(f"{place}/{step}")
        if step:
            removed(spark, f"{place}/{step - 1}")
        written = spark.read.schema(STATE).parquet(f"{place}/{step}")
        scans.append(written.agg(F.coalesce(F.sum("scans"), F.lit(0)).alias("n")).first().n)
        state = written.select(*(c.split()[0] for c in BLOCK.split(", ")))
        if step < rounds:
            books = updated(written, books)
    rows = saved(state.mapInArrow(lambda batches: coded(batches, books), f"vec_id bigint, label {kind}, code string, error bigint"))
    removed(spark, place)
    return rows.unionByName(without.filter(F.size("embedding") != length).drop("embedding")), books.entries, scans


def with_label_error(rows: DataFrame) -> DataFrame:
    """compress() rows with label_error, the error summed over equal labels."""
    sums = saved(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), same).drop("of")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    every = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(every, same & (F.col("salt") == F.col("of_salt"))).drop("of", "salt", "of_salt")


def digest(books: np.ndarray | None) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
