"""Operator 10, mixing to target weights with soft membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives each document posterior probabilities p_k of the domains.
With n tokens a document and a rate r >= 0 for it, the expected tokens of domain
k are S_k = sum of r n p_k over all documents.  The rates minimise the sum of
(S_k - T_k)^2 / B_k for targets T and initial totals B.  They are one projected
gradient step from 1 in the metric of the n, of length 1 / e, whose gradient is
taken where the step arrives:

    r = max(0, 1 - sum over k of p_k y_k),  y_k = (S_k(r) - T_k) / (e B_k)

The smaller e, the nearer the least squares; of all rates with the same totals these are
the nearest to 1.  The K numbers y are found by Newton steps on the convex function whose
gradient is the difference of both sides, e falling thirtyfold whenever they agree well
enough.  A step is one aggregation over the table of memberships (written once, a few
numbers a row), which tries twelve step lengths together.  The totals of any y give a
lower bound of the least squares by duality, so the search ends when the targets are met to
1e-7 or when the bound proves that no rates come nearer than a millionth; only then does a
warning say that the targets are out of reach.

Tokens are white-space words.  Defined cases: null and empty texts have 0 tokens,
the prior as posterior, and count for nothing in the totals; a domain with no
tokens is left out of the fit; rows with a null label teach nothing; without any
label there is one domain `all`; repeated rows are fitted one by one; an empty
table gives no rows; very long texts count whole; of equal posteriors the domain that
sorts first is named.  Weights are scaled to sum to 1; a domain without a weight
gets 0 (the default is equal weights).  Other columns are not looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.language_id import sample_pieces
from cadenza.llm.storage import saved

U = np.uint64
BITS = 16
#: Pieces of labelled text a domain, at most, and characters of one.
SAMPLE_ROWS, PIECE_CHARS = 256, 1024
#: Words of one text are not independent: n of them count as n * EVIDENCE_WORDS / (n + EVIDENCE_WORDS).
EVIDENCE_WORDS = 16
#: Jobs of a fit, at most (some 20 are needed); share of all tokens that a target may be missed by; share of the least squares that the bound may be below.
STEPS, TOLERANCE, GAP = 100, 1e-7, 1e-6
#: By what e falls, how well both sides agree before, and the lengths of a step that are tried.
FALL, AGREE = 30.0, 0.1
LENGTHS = (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.12, 0.06, 0.03, 0.01, 0.003, 0.001)


@dataclass
class Model:
    domains: list[str]
    log_p: np.ndarray  # [domains, 2 ** BITS]


def build(texts: dict[str, list[str]]) -> Model:
    domains = sorted(texts) or ["all"]
    counts = np.ones((len(domains), 1 << BITS)) * 0.05
    for k, name in enumerate(domains):
        hashes, _ = textkit.letter_words(pa.array(texts.get(name, []), pa.string()))
        counts[k] += np.bincount((hashes >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return Model(domains, np.log(counts / counts.sum(axis=1, keepdims=True)))


def posteriors(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """White-space words and [rows, domains] posteriors of each text."""
    data, offsets = textkit.flat(column)
    _, _, first = textkit.words(data, offsets)
    hashes, own = textkit.letter_words(column)
    at = (hashes >> U(64 - BITS)).astype(np.int64)
    n = np.diff(own)
    scale = EVIDENCE_WORDS / (n + EVIDENCE_WORDS)
    logit = np.stack([textkit.row_sums(model.log_p[k][at], own) * scale for k in range(len(model.domains))], axis=1)
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    return np.diff(first), p / p.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> Model:
    """Learns from a bounded sample of a table with doc_id, text and a label."""
    return build(sample_pieces(labelled.select("doc_id", label, "text"), label, rows, chars))


def memberships(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, posterior array<double> (in the order of the model's domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n, p = posteriors(shared.value, part.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(np.round(p, 9).ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], ["doc_id", "n_tokens", "posterior"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(textkit.mapper(run), "doc_id bigint, n_tokens bigint, posterior array<double>")


def rate(history: list[list[float]]) -> Column:
    """A row's rate after the steps so far, from its posterior and the steps' K-vectors."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in h)) for h in history))

    def step(r: Column, h: Column) -> Column:
        pull = F.aggregate(F.zip_with("posterior", h, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), r - pull)

    return F.aggregate(steps, F.lit(1.0), step)


def evaluated(members: DataFrame, tried: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """In one job, for each y that is tried: sum of n r^2, totals S, sum of n p p^T where r > 0; and the least p . pull of all rows."""
    m, k = tried.shape
    width = m * (1 + k + k * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros((m, 1 + k + k * k)), np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.asarray(batch.column(0)).astype(np.float64)
            p = np.asarray(batch.column(1).flatten()).reshape(len(n), k)
            p, n = p[n > 0], n[n > 0]
            if not len(n):
                continue
            least = min(least, float((p @ pull).min()))
            r = np.maximum(0.0, 1.0 - p @ tried.T)
            for i in range(m):
                on = p[r[:, i] > 0]
                total[i, 0] += (n * r[:, i] ** 2).sum()
                total[i, 1 : 1 + k] += (n * r[:, i]) @ p
                total[i, 1 + k :] += ((on * n[r[:, i] > 0, None]).T @ on).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([least])], ["sums", "least"])

    parts = members.select("n_tokens", "posterior").mapInArrow(run, "sums array<double>, least double")
    whole = parts.select(F.posexplode("sums").alias("at", "s"), "least").groupBy("at").agg(F.sum("s").alias("s"), F.min("least").alias("least")).collect()  # width rows
    sums = np.zeros(width)
    for r in whole:
        sums[r.at] = r.s
    sums = sums.reshape(m, -1)
    return sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k :].reshape(m, k, k), min((r.least for r in whole), default=np.inf)


@dataclass
class Fit:
    """y of the rates, their totals, the targets, the sum of squares over B (halved) and a proven lower bound of it, and the jobs taken."""

    y: list[float]
    reached: list[float]
    wanted: list[float]
    value: float
    bound: float
    jobs: int


def fitted(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None, budget: float | None = None, steps: int = STEPS) -> Fit:
    """The rates' y for the targets."""
    k = len(domains)
    square, totals, hessian, _ = evaluated(members, np.zeros((1, k)), np.zeros(k))
    base = totals[0]
    share = np.array([(weights or dict.fromkeys(domains, 1.0)).get(d, 0.0) for d in domains]) * (base > 0)
    whole = budget if budget is not None else float(base.sum())
    target = share / share.sum() * whole if share.sum() > 0 else base.copy()
    here = base > 0  # domains with tokens; nothing can be done about the others
    y, e, jobs, bound, best = np.zeros(k), 1.0, 1, 0.0, None
    square, totals, hessian = square[0], totals[0], hessian[0]
    while True:
        gap = np.where(here, totals - target, 0.0)
        pull = np.where(here, gap / np.where(here, base, 1.0), 0.0)
        value = float((gap * pull).sum() / 2)
        if best is None or value < best[0]:
            best = (value, y, totals, np.abs(gap).max(initial=0.0))
        if jobs >= steps or best[3] <= TOLERANCE * whole or best[0] - bound <= GAP * best[0]:
            break
        while True:  # how far both sides are apart, with e as small as that allows
            apart = np.where(here, e * base * y - gap, 0.0)
            if np.abs(apart).max() > max(AGREE * np.abs(gap).max(), 1e-12 * whole) or e < 1e-14:
                break
            e /= FALL
        way = np.zeros(k)
        way[here] = -np.linalg.solve(hessian[np.ix_(here, here)] + e * np.diag(base[here]), apart[here])
        tried = np.stack([y + t * way for t in LENGTHS])
        squares, sums, hessians, least = evaluated(members, tried, pull)
        jobs += 1
        # p . z >= 0 for all rows makes z feasible for the dual; posteriors add up to 1, so a shift does it
        z = pull + max(0.0, -least)
        bound = max(bound, float(-(base * z * z)[here].sum() / 2 - (target * z)[here].sum()))
        height = squares / 2 + tried @ target + e / 2 * (tried * tried) @ base
        i = int(height.argmin())
        y, square, totals, hessian = tried[i], squares[i], sums[i], hessians[i]
    return Fit(best[1].tolist(), best[2].tolist(), target.tolist(), best[0], bound, jobs)


def solve(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None, budget: float | None = None, steps: int = STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """The projected steps (one), the totals reached and the targets."""
    found = fitted(members, domains, weights, budget, steps)
    return [found.y], found.reached, found.wanted


def mix(docs: DataFrame, labelled: DataFrame | None = None, label: str = "lang", weights: dict[str, float] | None = None, budget: float | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, copies (the rate rounded up or down by a hash of doc_id) of every row."""
    model = model or fit(labelled if labelled is not None else docs, label)
    members = saved(memberships(docs, model))  # read once an iteration
    found = fitted(members, model.domains, weights, budget)
    history, apart = [found.y], max(abs(a - b) for a, b in zip(found.reached, found.wanted))
    if apart > 10 * TOLERANCE * sum(found.wanted):
        why = "no rates meet the targets" if found.bound > 0.5 * found.value else f"the targets are not met after {found.jobs} jobs"
        warnings.warn(f"{why}: {dict(zip(model.domains, found.reached))} instead of {dict(zip(model.domains, found.wanted))}", stacklevel=2)
    names = F.array(*(F.lit(d) for d in model.domains))
    best = F.array_position("posterior", F.array_max("posterior"))
    done = members.select("doc_id", "n_tokens", F.element_at(names, best.cast("int")).alias("domain"), "posterior", F.round(rate(history), 9).alias("rate"))
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    return done.withColumn("copies", (F.floor("rate") + F.when(uniform < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("bigint"))
