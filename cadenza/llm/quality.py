"""Operator 5, quality by logistic regression on hashed word n-grams, trained with FTRL-Proximal.

Tokens are lower-cased runs of letters and runs of any other characters but
white space; a run of two or more capitals and a word equal to one of the two tokens
before become one token each (`<upper>`, `<again>`), since the words of shouted and of
looping text differ from text to text.  Unigrams and bigrams of tokens are hashed
into 2 ** `BITS` features whose value is their share of the document's n-grams.

The model is fitted on a bounded sample of labelled rows, dealt by hash into
`SHARDS` groups that train in parallel; the weights are the groups' mean.  Every
text is then scored in one pass over the table by gathers and sums per row.

Defined cases: null and empty texts score as the share of label 1; repeated label
rows of a document count once, as their largest label; null labels and ids teach
nothing; without any label every score is 0.5; repeated documents are scored one
by one; very long texts are scored whole; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.language_id import held_out
from cadenza.llm.toxicity import labelled

U = np.uint64
BITS = 18
#: Labelled rows that the model is fitted on, at most, and how they are dealt.
SAMPLE_ROWS, SHARDS, EPOCHS = 8192, 8, 4
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.002, 0.002
#: Shares are small numbers; this factor brings them near 1.
SCALE = 24.0
UPPER, AGAIN = U(0x5555555555555555), U(0x3333333333333333)
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and each row's first index."""
    data, offsets = textkit.flat(column)
    kind = np.where(textkit.SPACE[data], 0, np.where(textkit.LETTER[data] == 1, 1, 2)).astype(np.uint8)
    starts, ends, first = textkit.runs(kind, offsets)
    hashes = textkit.span_hashes(textkit.fold_case(data), starts, ends)
    if len(starts):
        capital = (data >= 65) & (data <= 90)
        # the second byte of a two-byte capital of Latin-1 counts too; its lead byte is no letter of its own
        lead = data == 0xC3
        high = np.zeros(len(data), bool)
        high[1:] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        sums = np.concatenate([[0], np.cumsum((capital | high | lead).view(np.uint8), dtype=np.int64)])
        size = ends - starts
        shout = (kind[starts] == 1) & (sums[ends] - sums[starts] == size) & (size >= 2)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (kind[starts[1:]] == 1)
        same[2:] |= (hashes[2:] == hashes[:-2]) & (kind[starts[2:]] == 1)  # as in "so. so. so."
        begins = first[:-1]
        same[begins[begins < len(same)]] = False
        begins = (first[:-1] + 1)[np.diff(first) > 1]
        same[begins] &= hashes[begins] == hashes[begins - 1]
        hashes = np.where(same, AGAIN, np.where(shout, UPPER, hashes))
    return hashes, first


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each token, feature of each token with the one before (-1 for a row's first), each row's first index."""
    hashes, first = tokens(column)
    shift = U(64 - bits)
    single = (textkit.mix(hashes) >> shift).astype(np.int64)
    double = np.full(len(hashes), -1, np.int64)
    double[1:] = (textkit.mix(hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:] + U(1)) >> shift).astype(np.int64)
    begins = first[:-1]
    double[begins[begins < len(double)]] = -1
    return single, double, first


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS, prior: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias after some passes over (features, values, label) rows; the last feature is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    z[-1] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        shrink = np.where(i == size - 1, 0.0, L1)
        pull = np.where(i == size - 1, 0.0, L2)
        return np.where(np.abs(z[i]) <= shrink, 0.0, (np.sign(z[i]) * shrink - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + pull))

    for _ in range(epochs):
        for index, value, label in rows:
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - label) * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
    whole = weights(np.arange(size))
    return whole[:-1], float(whole[-1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `sample` labelled rows, picked and dealt by hashes of doc_id."""
    marks = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias(column))
    picked = marks.filter(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max(column).alias(column))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(sample)
    rows = labelled(docs, picked, column, 4, 2).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(SHARDS)).cast("int"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", key=lambda x: textkit.mix(x.to_numpy().astype(np.int64).view(U)))
        single, double, first = features(pa.array(pdf["text"], pa.string()))
        examples = []
        for d, label in enumerate(pdf["label"]):
            both = np.concatenate([single[first[d] : first[d + 1]], double[first[d] : first[d + 1]]])
            both = both[both >= 0]
            index, count = np.unique(both, return_counts=True)
            examples.append((np.append(index, 1 << BITS), np.append(count / max(1, len(both)) * SCALE, 1.0), float(label > 0)))
        weights, bias = ftrl(examples)
        return pd.DataFrame({"weights": [weights.astype(np.float64).tobytes()], "bias": [bias], "n": [len(pdf)], "ones": [int((pdf["label"] > 0).sum())]})

    parts = rows.groupBy("shard").applyInPandas(train, "weights binary, bias double, n bigint, ones bigint").collect()  # SHARDS rows
    n, ones = sum(p.n for p in parts), sum(p.ones for p in parts)
    if not n:
        return Model(np.zeros(1 << BITS), 0.0, 0.5)
    weights = sum(np.frombuffer(p.weights) * p.n for p in sorted(parts, key=lambda p: (p.n, p.bias))) / n
    return Model(weights, sum(p.bias * p.n for p in parts) / n, ones / n)


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    single, double, first = features(column)
    padded = np.append(model.weights, 0.0)  # -1: no bigram
    total = textkit.row_sums(padded[single] + padded[double], first)
    n = np.diff(first)
    logit = SCALE * total / np.maximum(2 * n - 1, 1) + model.bias
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))), model.prior)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        p = score_texts(shared.value, part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return rows.mapInArrow(textkit.mapper(run), SCHEMA)
