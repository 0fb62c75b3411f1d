"""Operator 4, toxicity by class-conditional Kneser-Ney models.

Two bigram models, c = 1 of toxic and c = 0 of ordinary labelled text, interpolate
down to continuation counts that both share:

    P_c(w|u) = max(C_c(uw) - E_c(uw), 0) / C_c(u.) + b_c(u) P_c(w)
    P_c(w)   = max(N_c(.w) - D_c(w), 0) / N_c      + b_c    P(w)
    P(w)     = max(N(.w) - d, 0) / N               + b      / (types + 1)

C_c(uw) is the number of the class's documents that hold the bigram, N_c(.w) the
number of different words before w in the class (so copies of a document are no
evidence), N(.w) the same over both classes, and the b are what discounting takes,
so that each distribution sums to one; an unknown word has the uniform share.

The discounts are what the shared counts explain, and a constant besides:

    D_c(w)  = DISCOUNT r_c      + EXPECTED N_c N(.w) / N
    E_c(uw) = PAIR_DISCOUNT r_c + EXPECTED C_c(u.) C(uw) / C(u.)

with r_c the size of class c by that of the smaller one.  A class keeps its own
count of an expression only as far as it exceeds EXPECTED times its share of the
shared count; the rest, and every rarer expression, backs off to the shared counts,
which do not tell the classes apart.  (Discounts from counts of counts, below 1,
leave each class the language mix and the rare words of its own documents: on the
driver's sf0.1 the area under the curve of held-out documents is 0.64 with them and
0.97 with these, by the same mean log-likelihood.)

A text's log-likelihood ratio is the sum over its words of log P_1 / P_0, which
splits into one term a word, one a preceding word and one a bigram.  Expressions
without a class count of their own have the same term, so the model is the table of
all others, and it grows with the corpus.  Its `MODEL_NGRAMS` most frequent entries
go to every task, and what they don't hold is joined by key (`rest`).

A document's score is a logistic function of the ratio a word and of its squashed
sum, fitted on labelled rows that the counts leave out.  Words are lower-cased runs
of letters, as 47-bit hashes: of a hundred million different words some forty pairs
fall together.

Defined cases: null and empty texts, and texts without letters, score as the
prior; very long texts are scored whole; repeated label rows of a document count
once, as toxic if any says so; null labels and ids teach nothing; without labels of
both classes every score is the share of toxic labels (0 without any); repeated
documents are scored one by one; an empty table gives no rows.  Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.language_id import held_out
from cadenza.llm.storage import saved

U = np.uint64
#: Different preceding words (for a bigram: documents) that a class's evidence is discounted by, and times of the shared expectation.
DISCOUNT, PAIR_DISCOUNT, EXPECTED = 3.0, 6.0, 2.0
#: The discount of the shared continuation counts.
SHARED_DISCOUNT = 0.75
#: Entries of the model that every task gets; more are joined by key.
MODEL_NGRAMS = 1 << 20
#: Labels are broadcast up to this many; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Rows for the two weights and the bias of the score, at most.
CALIBRATION_ROWS = 4000
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, llr double"
#: A task's counts leave it whenever so many bigrams are gathered.
FLUSH = 1 << 21
WORD, HEAD, PAIR = 0, 1, 2
SUMS = ["a0", "a1", "a", "h0", "h1"]


@dataclass
class Model:
    """Terms of log P_1 / P_0 by (kind, u, w); `table` finds the ones that every task has, `rest` holds the others."""

    table: textkit.Table
    terms: np.ndarray  # of the table's keys, and 0 at the end
    rest: DataFrame | None
    every_word: float  # the term of every word, on top of its own
    prior: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of the mean, of the sum (squashed), bias
    known: bool = True  # labels of both classes

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}  # tasks get the rest by a join


def keys(kind: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textkit.mix(textkit.mix(u + U(kind + 1)) * U(0x9E3779B97F4A7C15) + w)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words w (of 48 bits, the last one set), the word u before each (0 at a row's start), and each row's first index."""
    w, first = textkit.letter_words(column)
    w = (w >> U(16)) | U(1)  # 0 is no word
    u = np.zeros_like(w)
    u[1:] = w[:-1]
    begins = first[:-1]
    u[begins[begins < len(w)]] = 0
    return w, u, first


def packed(u: np.ndarray, w: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    """Two words in 12 bytes (k1, k2), and two counts in one number whose halves add up apart."""
    k1 = (u << U(16)) | (w >> U(32))
    k2 = w.astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2), pa.array((n << 32) + toxic)], ["k1", "k2", "counts"])


def unpacked(rows: DataFrame) -> DataFrame:
    """u, w, n, n1 (toxic) of packed() rows."""
    k1, k2, low = F.col("k1"), F.col("k2").cast("bigint"), F.lit(0xFFFFFFFF)
    w = F.shiftleft(k1.bitwiseAND(F.lit(0xFFFF)), 32).bitwiseOR(k2.bitwiseAND(low))
    return rows.select(F.shiftrightunsigned(k1, 16).alias("u"), w.alias("w"), F.shiftright("counts", 32).alias("n"), F.col("counts").bitwiseAND(low).alias("n1"))


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to packed(u, w, n, toxic) rows: documents with the bigram, added up before they leave the task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        u, w, toxic = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((u, w))
        u, w, toxic = u[order], w[order], toxic[order]
        at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        n = np.diff(np.append(at, len(u)))
        held.clear()
        return packed(u[at], w[at], n, np.add.reduceat(toxic.astype(np.int64), at))

    for batch in batches:
        for part in textkit.slices(batch, 1):
            w, u, first = words(part.column(1))
            flag = np.repeat((np.asarray(part.column(0)) > 0).astype(np.int8), np.diff(first))
            _, once = np.unique(keys(PAIR, u, w) + textkit.owners(first).astype(U) * U(0x9E3779B97F4A7C15), return_index=True)
            if len(once):
                held.append((u[once], w[once], flag[once]))
                size += len(once)
            if size >= FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


def labelled(docs: DataFrame, labels: DataFrame, column: str, parts: int, part: int) -> DataFrame:
    """doc_id, label, text of the rows that may teach; labels are broadcast if few, else joined by a shuffle."""
    marks = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label"))
    marks = marks.filter(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id").select("doc_id", "label", "text")


def counted(rows: DataFrame) -> DataFrame:
    """kind, u, w, a0, a1, a, h0, h1: of a word w its preceding words in each class and in both, and the documents of what it precedes; of a pair its documents.

    Bigrams meet once, by both words; from there the words' sums go on added up.  A
    pair that no class can hold beyond its discount ends here.
    """
    pairs = rows.select("label", "text").mapInArrow(count, "k1 bigint, k2 int, counts bigint")
    pairs = unpacked(pairs.groupBy("k1", "k2").agg(F.sum("counts").alias("counts"))).withColumn("n0", F.col("n") - F.col("n1"))
    zero = F.lit(0)

    def row(kind: int, u: Column, w: Column, *sums: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), u.cast("bigint").alias("u"), w.alias("w"), *(x.cast("bigint").alias(c) for c, x in zip(SUMS, sums)))

    n, n0, n1, u, w = (F.col(c) for c in ("n", "n0", "n1", "u", "w"))
    word = row(WORD, zero, w, F.least(n0, F.lit(1)), F.least(n1, F.lit(1)), F.lit(1), zero, zero)
    both = F.array(word, row(WORD, zero, u, zero, zero, zero, n0, n1))
    tagged = pairs.select(F.explode(F.when(n > PAIR_DISCOUNT, F.array_append(both, row(PAIR, u, w, n0, n1, n, zero, zero))).otherwise(both)).alias("x")).select("x.*")
    return saved(tagged.groupBy("kind", "u", "w").agg(*(F.sum(c).alias(c) for c in SUMS)))


def over(count_: Column, discount: Column) -> Column:
    return F.greatest(count_ - discount, F.lit(0.0))


def estimated(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, float] | None:
    """All words (w, a, p, p0, p1), heads with a pair of their own (u, a, b0, b1), such pairs (u, w, a, p0, p1), and b_0, b_1; None without both classes."""
    every = counts.filter(F.col("kind") == WORD)
    totals = every.agg(*(F.sum(c).alias(c) for c in SUMS), F.count_if(F.col("a") > 0).alias("types")).first()
    if not totals["a0"] or not totals["a1"]:
        return None
    n, types = totals["a"], totals["types"]
    size, documents = [totals["a0"], totals["a1"]], [totals["h0"], totals["h1"]]
    shared = over(F.col("a"), F.lit(SHARED_DISCOUNT)) / n + SHARED_DISCOUNT * types / n / (types + 1)
    words_ = every.filter(F.col("a") > 0).withColumn("p", shared)
    for c in (0, 1):
        words_ = words_.withColumn(f"s{c}", over(F.col(f"a{c}"), DISCOUNT * size[c] / min(size) + EXPECTED * size[c] * F.col("a") / n) / size[c])
    b = [1 - x for x in words_.agg(F.sum("s0"), F.sum("s1")).first()]
    words_ = words_.select("w", "a", "p", *((F.col(f"s{c}") + b[c] * F.col("p")).alias(f"p{c}") for c in (0, 1)), ((F.col("s0") > 0) | (F.col("s1") > 0)).alias("own"))
    heads = every.select(F.col("w").alias("u"), "h0", "h1", (F.col("h0") + F.col("h1")).alias("h"))
    pairs = counts.filter(F.col("kind") == PAIR).select("u", "w", "a", "a0", "a1").join(heads, "u")
    for c in (0, 1):
        discount = PAIR_DISCOUNT * documents[c] / min(documents) + EXPECTED * F.col(f"h{c}") * F.col("a") / F.col("h")
        pairs = pairs.withColumn(f"s{c}", F.coalesce(over(F.col(f"a{c}"), discount) / F.when(F.col(f"h{c}") > 0, F.col(f"h{c}")), F.lit(0.0)))
    pairs = saved(pairs.filter("s0 > 0 or s1 > 0").select("u", "w", "a", "h", "s0", "s1"))
    heads = pairs.groupBy("u").agg(F.max("h").alias("a"), (1 - F.sum("s0")).alias("b0"), (1 - F.sum("s1")).alias("b1"))
    joined = pairs.join(heads.select("u", "b0", "b1"), "u").join(words_.select("w", "p0", "p1"), "w")
    pairs = joined.select("u", "w", "a", *((F.col(f"s{c}") + F.col(f"b{c}") * F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)), "b0", "b1", (F.log("p1") - F.log("p0")).alias("word"))
    return words_, heads, pairs, b[0], b[1]


def entries(counts: DataFrame) -> tuple[DataFrame, float] | None:
    """(kind, u, w, term, a) of every expression with a class count of its own, and the term of every word."""
    found = estimated(counts)
    if found is None:
        return None
    words_, heads, pairs, b0, b1 = found
    every = float(np.log(b1) - np.log(b0))
    zero = F.lit(0).cast("bigint")
    own = words_.filter("own").select(F.lit(WORD).alias("kind"), zero.alias("u"), "w", (F.log("p1") - F.log("p0") - every).alias("term"), "a")
    back = F.log("b1") - F.log("b0")
    out = own.unionByName(heads.select(F.lit(HEAD).alias("kind"), "u", zero.alias("w"), back.alias("term"), "a"))
    return saved(out.unionByName(pairs.select(F.lit(PAIR).alias("kind"), "u", "w", (F.log("p1") - F.log("p0") - back - F.col("word")).alias("term"), "a"))), every


def frequent(found: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with the highest counts a, at most `most` of them, and the others (None if there are none)."""
    sizes = found.groupBy(F.least("a", F.lit(1 << 16)).alias("a")).count().collect()
    total, cut = 0, 1 << 62
    for n, c in sorted(((r["a"], r["count"]) for r in sizes), reverse=True):
        if total + c > most:
            break
        total, cut = total + c, n
    if total == sum(r["count"] for r in sizes):
        return found, None
    return found.filter(F.col("a") >= cut), found.filter(F.col("a") < cut)


def fit(docs: DataFrame, labels: DataFrame, most: int = MODEL_NGRAMS) -> Model:
    """Counts all labelled rows (but those for the calibration), and fits the score's weights on a bounded part."""
    rows = labelled(docs, labels, "toxic", 5, 0)
    apart = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(10)) == 0
    marks = {int(r["label"] > 0): r["count"] for r in rows.groupBy("label").count().collect()}
    prior = marks.get(1, 0) / max(1, sum(marks.values()))
    found = entries(counted(rows.filter(~apart)))
    if found is None:
        return Model(textkit.Table(np.zeros(0, U)), np.zeros(1), None, 0.0, prior, known=False)
    top, rest = frequent(found[0], most)
    top = top.toPandas()
    kind, u, w = (top[c].to_numpy().astype(np.int64) for c in ("kind", "u", "w"))
    key = np.zeros(len(top), U)
    for k in (WORD, HEAD, PAIR):
        key[kind == k] = keys(k, u[kind == k].view(U), w[kind == k].view(U))
    model = Model(textkit.Table(key), np.append(top["term"].to_numpy(), 0.0), rest, found[1], prior)
    calibrate(model, rows.filter(apart), prior)
    return model


def gathered(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the sum of the terms that the task's table holds, of each text."""
    w, u, first = words(column)
    zero = np.zeros(1, U)
    total = model.terms[model.table.find(keys(WORD, zero, w))] + model.terms[model.table.find(keys(HEAD, u, zero))] + model.terms[model.table.find(keys(PAIR, u, w))]
    return np.diff(first), textkit.row_sums(total, first)


def unfound(model: Model, ids: np.ndarray, column: pa.Array) -> pa.RecordBatch:
    """(id, kind, u, w, n) of the expressions that the task's table lacks, n times in the row with that id."""
    w, u, first = words(column)
    own, zero = textkit.owners(first), np.zeros(len(w), U)
    out = []
    for k, a, b in ((WORD, zero, w), (HEAD, u, zero), (PAIR, u, w)):
        lost = np.flatnonzero(model.table.find(keys(k, a, b)) < 0)
        _, at, n = np.unique(keys(k, a, b)[lost] + own[lost].astype(U) * U(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        at = lost[at]
        out.append((ids[own[at]], np.full(len(at), k, np.int32), a[at].view(np.int64), b[at].view(np.int64), n))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["row", "kind", "u", "w", "n"])


def likelihoods(model: Model, rows: DataFrame) -> DataFrame:
    """rows (any columns and text, without row, n, total) with n words and total, the log-likelihood ratio of the text."""
    plain = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in plain) + ", n bigint, total double"
    if model.rest is not None:  # rows are told apart by a number that a later reading of them gives again
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
        schema, plain = "row bigint, " + schema, ["row", *plain]
    text = rows.columns.index("text")
    at = [rows.columns.index(c) for c in plain]

    def sums(part: pa.RecordBatch) -> pa.RecordBatch:
        n, total = gathered(shared.value, part.column(text))
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in at), pa.array(n), pa.array(total + n * shared.value.every_word)], [*plain, "n", "total"])

    found = rows.mapInArrow(textkit.mapper(sums, text), schema)
    if model.rest is None:
        return found
    lost = rows.select("row", "text").mapInArrow(textkit.mapper(lambda part: unfound(shared.value, np.asarray(part.column(0)), part.column(1))), "row bigint, kind int, u bigint, w bigint, n bigint")
    more = lost.join(model.rest.select("kind", "u", "w", "term"), ["kind", "u", "w"]).groupBy("row").agg(F.sum(F.col("n") * F.col("term")).alias("more"))
    return found.join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("row", "more")


def design(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([total / np.maximum(n, 1), np.tanh(total / 20) * np.sqrt(n / (n + 50.0)), np.ones(len(n))])


def calibrate(model: Model, rows: DataFrame, prior: float) -> None:
    """Logistic regression on two features over a bounded number of rows, by hash of doc_id; few rows of a class fall back on the mean alone."""
    picked = rows.select(F.xxhash64("doc_id", F.lit(19)).alias("h"), "doc_id").orderBy("h", "doc_id").limit(CALIBRATION_ROWS).select("doc_id")
    found = likelihoods(model, rows.join(F.broadcast(picked), "doc_id").select("label", "text")).toPandas()
    y = (found["label"].to_numpy() > 0).astype(float)
    x = design(found["n"].to_numpy(), found["total"].to_numpy())
    w = np.array([20.0, 0.0, np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))])
    if min(y.sum(), len(y) - y.sum()) >= 3:
        ridge = np.diag([1e-4, 1e-2, 1e-4])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)) @ x.T + ridge, x @ (y - p) - ridge @ w)
            w = w + np.clip(step, -25, 25)
            if np.abs(step).max() < 1e-6:
                break
    model.weights = w


def detect(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, llr (a word) of every row of docs."""
    model = model or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    if not model.known:
        plain = rows.select("doc_id", "held_out", F.lit(model.prior).alias("score"))
        return plain.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), F.lit(0.0).alias("llr"))
    n, total = F.col("n"), F.col("total")
    mean = total / F.greatest(n, F.lit(1))
    a, b, c = (F.lit(float(x)) for x in model.weights)
    logit = a * mean + b * F.tanh(total / 20) * F.sqrt(n / (n + 50.0)) + c
    score = F.when(n > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), logit))))).otherwise(F.lit(model.prior))
    out = likelihoods(model, rows).select("doc_id", "held_out", score.alias("score"), mean.alias("llr"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "llr")
