"""Operator 13, quality rules by a linear-chain conditional random field over a text's lines.

Every line with a word is one position of a chain, and is content (0) or boilerplate (1).
What a line looks like is put into bins (see `LINE_BINS`): its symbols, capitals, exclamation marks,
separators, digits, word lengths, repeated words, its length, its end, whether the text has
it before, and its place.  The score of a labelling is the sum of one weight a line, label and
bin, and one a pair of neighbouring labels; the best labelling is found by Viterbi decoding, and a
text is kept if at least `CONTENT` of its words stand in content lines and no base rule fails.

The field learns from whole texts that are labelled good or bad: each line of a good one is
content, each of a bad one boilerplate.  Bad texts have good lines, so single lines are learned with noise; the
weights, which are few, settle it by the majority.  It is fitted by maximum likelihood
(forward-backward) on at most `SAMPLE_ROWS` labelled texts, dealt by hash into groups of about `SHARD_ROWS` that fit in
parallel; the weights are the groups' mean.  Long texts teach in sequences of
`SEQUENCE` lines, every line of them.

Defined cases: null and empty texts have no words and fail the base rules; a text that passes them
has a line, so a share; lines without a word are no positions; null labels and ids teach
nothing, and a document labelled twice counts as its largest label; without labels of both kinds every
line is content; repeated rows are judged one by one; very long texts are read and decoded whole;
an empty table gives no rows.  Other columns are not looked at.
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
from cadenza.llm.storage import saved
from cadenza.llm.toxicity import labelled

U = np.uint64
#: Labelled texts that teach, at most, how they are dealt, lines of a sequence, and steps of the fit.
SAMPLE_ROWS, SHARD_ROWS, SEQUENCE, STEPS = 4096, 512, 64, 120
#: Weight of the squared weights, a sequence.
DECAY = 1e-3
#: Share of words in content lines from which a text is kept.
CONTENT = 0.5
#: Base rules: words that a text has at least, and share of words in repeated three-word windows at most, in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_words bigint, kept boolean"

#: Upper ends of the bins of each number of a line; one bin more than ends.
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
LINE_BINS: dict[str, tuple[float, ...]] = {
    "symbols_a_word": (0.0, 0.1, 0.5, 1.0, 2.0),
    "symbol_bytes": SHARES,
    "capital_letters": SHARES,
    "exclamation_words": SHARES,
    "digit_bytes": SHARES,
    "other_bytes": SHARES,
    "letters_a_word": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "again_words": SHARES,
    "distinct_words": SHARES,
    "words": (1, 2, 4, 8, 16, 32, 64, 128, 512),
    "sentence_end": (0.0,),
    "before": (0.0,),
    "first": (0.0,),
    "last": (0.0,),
}
STARTS = np.cumsum([0] + [len(e) + 1 for e in LINE_BINS.values()])
WIDTH = int(STARTS[-1])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"'")] = True


@dataclass
class Model:
    """emission [bins] and bias: score of boilerplate over content; change [2, 2]: score of a label behind a label."""

    emission: np.ndarray
    bias: float
    change: np.ndarray


def _runs_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (owner, key) stands twice or more, and whether it stood before."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    o, k = owner[order], keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    out[order], before[order] = twice, same
    return out, before


@dataclass
class Lines:
    """Counts of a column's texts, and bins [lines, features] of their lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    bins: np.ndarray
    words: np.ndarray  # of each line
    first: np.ndarray  # first line of each text (len + 1)


def lines(column: pa.Array) -> Lines:
    data, offsets = textkit.flat(column)
    texts = len(offsets) - 1
    starts, ends, first_word = textkit.words(data, offsets)
    hashes = textkit.span_hashes(data, starts, ends)
    own = textkit.owners(first_word)
    n_words = np.diff(first_word)
    symbol = _SYMBOL[data]
    begins = (data & 0xC0) != 0x80  # the first byte of a code point
    n_symbols = _runs_sum(symbol, offsets[:-1], offsets[1:])
    word_chars = _runs_sum(begins & ~textkit.SPACE[data], offsets[:-1], offsets[1:])
    # words in windows of three that their text has twice
    cover = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        window = textkit.mix(hashes[:-2] * U(0x9E3779B97F4A7C15) + textkit.mix(hashes[1:-1] * U(0xD6E8FEB86659FD93) + textkit.mix(hashes[2:])))
        whole = np.flatnonzero(own[:-2] == own[2:])
        twice, _ = _repeated(own[whole], window[whole])
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
    n_repeat = np.bincount(own[np.cumsum(cover[:-1]) > 0], minlength=texts).astype(np.int64)
    # lines: what lies between line breaks, with at least one word
    breaks = np.flatnonzero(data == 10)
    cuts = np.union1d(offsets, breaks + 1)
    a, b = cuts[:-1], cuts[1:] - (data[cuts[1:] - 1] == 10)
    w = np.searchsorted(starts, np.append(a, len(data)))
    full = np.diff(w) > 0
    a, b, w0, w1 = a[full], b[full], w[:-1][full], w[1:][full]
    text = np.searchsorted(offsets, a, "right") - 1
    first = np.searchsorted(text, np.arange(texts + 1))
    words = w1 - w0
    if len(a) == 0:
        none = np.zeros((0, len(LINE_BINS)), np.int32)
        return Lines(n_words, word_chars, n_symbols, np.zeros(texts, np.int64), n_repeat, none, words, first)
    _, before = _repeated(text, textkit.span_hashes(data, a, b))
    line = np.repeat(np.arange(len(a)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    _, known = _repeated(line, hashes)
    letter = (textkit.LETTER[data] == 1) & begins
    capital = (data >= 65) & (data <= 90)
    capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    n_letters = _runs_sum(letter, a, b)
    size = np.maximum(1, b - a)
    shout = data[ends - 1] == 33
    last_byte = data[ends[w1 - 1] - 1]
    digit = textkit.LETTER[data] == 2
    other = (textkit.LETTER[data] == 0) & ~textkit.SPACE[data] & ~symbol
    numbers = [
        _runs_sum(symbol, a, b) / words,
        _runs_sum(symbol, a, b) / size,
        _runs_sum(capital, a, b) / np.maximum(1, n_letters),
        _runs_sum(shout, w0, w1) / words,
        _runs_sum(digit, a, b) / size,
        _runs_sum(other, a, b) / size,
        n_letters / words,
        _runs_sum(again, w0, w1) / words,
        1 - _runs_sum(known, w0, w1) / words,
        words,
        _END[last_byte],
        before,
        np.arange(len(a)) == first[text],
        np.arange(len(a)) == first[text + 1] - 1,
    ]
    bins = np.stack([STARTS[i] + np.searchsorted(e, np.asarray(x, np.float64), "left") for i, (x, e) in enumerate(zip(numbers, LINE_BINS.values()))], axis=1).astype(np.int32)
    return Lines(n_words, word_chars, n_symbols, np.bincount(text[before], minlength=texts).astype(np.int64), n_repeat, bins, words, first)


def viterbi(score: list[float], change: np.ndarray) -> list[int]:
    """The best labelling of a chain whose lines score `score` as boilerplate over content; content wins ties."""
    (cc, cb), (bc, bb) = change.tolist()
    content, boiler, back = 0.0, 0.0, []
    for t, s in enumerate(score):
        if t:
            to_content, to_boiler = boiler + bc > content + cc, boiler + bb > content + cb
            content, boiler = max(content + cc, boiler + bc), max(content + cb, boiler + bb)
            back.append((to_content, to_boiler))
        boiler += s
    state = int(boiler > content)
    out = [state]
    for pair in reversed(back):
        state = int(pair[state])
        out.append(state)
    return out[::-1]


def gradient(bins: np.ndarray, real: np.ndarray, label: np.ndarray, model: Model) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Mean log-likelihood of sequences whose lines all have one label, and its gradient in emission, bias and change.

    bins [sequences, lines, features], real [sequences, lines] (padding is at the end), label [sequences].
    """
    n, length = real.shape
    node = np.zeros((n, length, 2))
    node[:, :, 1] = (model.emission[bins].sum(axis=2) + model.bias) * real
    size = real.sum(axis=1)
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = node[:, 0]
    for t in range(1, length):
        step = np.logaddexp(forward[:, t - 1, 0, None] + model.change[0], forward[:, t - 1, 1, None] + model.change[1]) + node[:, t]
        forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    pair = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        ahead = backward[:, t + 1] + node[:, t + 1]
        step = np.logaddexp(model.change[:, 0] + ahead[:, 0, None], model.change[:, 1] + ahead[:, 1, None])
        backward[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        p = np.exp(forward[:, t, :, None] + model.change + ahead[:, None, :] - whole[:, None, None])
        pair += p[real[:, t + 1]].sum(axis=0)
    boiler = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * real
    truth = label[:, None] * real
    gain = truth - boiler
    emission = np.bincount(bins.reshape(n * length, -1)[real.ravel()].ravel(), np.repeat(gain[real], bins.shape[2]), minlength=WIDTH)
    kept = np.zeros((2, 2))
    kept[0, 0], kept[1, 1] = ((size - 1) * (label == 0)).sum(), ((size - 1) * (label == 1)).sum()
    chain = np.where(label == 1, (node[:, :, 1] * real).sum(axis=1) + (size - 1) * model.change[1, 1], (size - 1) * model.change[0, 0])
    return float((chain - whole).mean()), emission / n, float(gain.sum() / n), (kept - pair) / n


def learned(found: Lines, label: np.ndarray, steps: int = STEPS) -> Model:
    """Fits a field on texts whose lines all have their text's label (1: boilerplate), by gradient steps that adapt to each weight."""
    chains = [(found.bins[a : min(a + SEQUENCE, end)], label[d]) for d, (begin, end) in enumerate(zip(found.first[:-1], found.first[1:])) for a in range(begin, end, SEQUENCE)]
    model = Model(np.zeros(WIDTH), 0.0, np.zeros((2, 2)))
    if not chains or len({y for _, y in chains}) < 2:
        return Model(np.zeros(WIDTH), -1.0, np.zeros((2, 2)))
    longest = max(len(x) for x, _ in chains)
    bins, real = np.zeros((len(chains), longest, len(LINE_BINS)), np.int32), np.zeros((len(chains), longest), bool)
    for i, (x, _) in enumerate(chains):
        bins[i, : len(x)], real[i, : len(x)] = x, True
    y = np.array([y for _, y in chains])
    weights, mean, square = np.zeros(WIDTH + 5), np.zeros(WIDTH + 5), np.zeros(WIDTH + 5)
    for step in range(1, steps + 1):
        model = Model(weights[:WIDTH], float(weights[WIDTH]), weights[WIDTH + 1 :].reshape(2, 2))
        _, emission, bias, change = gradient(bins, real, y, model)
        g = np.concatenate([emission, [bias], change.ravel()]) - DECAY * weights
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        weights = weights + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:WIDTH], float(weights[WIDTH]), weights[WIDTH + 1 :].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `sample` labelled texts (column: 1 good, 0 bad), picked and dealt by hashes of doc_id; rows whose crc32 remainder by 4 is 2 teach nothing."""
    marks = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias(column))
    picked = marks.filter(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max(column).alias(column))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(61)), "doc_id").limit(sample)
    picked = saved(picked)
    shards = max(1, round(picked.count() / SHARD_ROWS))
    rows = labelled(docs, picked, column, 4, 2).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(67)), F.lit(shards)).cast("int"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        label = 1 - (pdf["label"].to_numpy() > 0).astype(np.int64)
        model = learned(lines(pa.array(pdf["text"], pa.string())), label)
        return pd.DataFrame({"weights": [np.concatenate([model.emission, [model.bias], model.change.ravel()]).tobytes()], "n": [len(pdf) if 0 < label.sum() < len(label) else 0]})

    parts = [p for p in rows.groupBy("shard").applyInPandas(train, "weights binary, n bigint").collect() if p.n]  # a row a shard
    if not parts:
        return Model(np.zeros(WIDTH), -1.0, np.zeros((2, 2)))
    weights = sum(np.frombuffer(p.weights) * p.n for p in sorted(parts, key=lambda p: p.weights)) / sum(p.n for p in parts)
    return Model(weights[:WIDTH], float(weights[WIDTH]), weights[WIDTH + 1 :].reshape(2, 2))


def decoded(model: Model, found: Lines) -> np.ndarray:
    """Whether each line is boilerplate."""
    score = (model.emission[found.bins].sum(axis=1) + model.bias).tolist()
    out = np.zeros(len(score), bool)
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b > a:
            out[a:b] = viterbi(score[a:b], model.change)
    return out


def judge(docs: DataFrame, model: Model, content: float = CONTENT) -> DataFrame:
    """The counts of every text, whether a base rule fails, its words in content lines, and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = lines(part.column(1))
        boiler = decoded(shared.value, found)
        good = textkit.row_sums(np.where(boiler, 0, found.words), found.first).astype(np.int64)
        failed = (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > MOST_REPEATED * found.n_words)
        kept = ~failed & (good >= content * found.n_words)
        counts = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(good), pa.array(kept)], [c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(textkit.mapper(run), SCHEMA)


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (0-based, of all lines split at line breaks), boilerplate: one row a line with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = lines(part.column(1))
        boiler = decoded(shared.value, found)
        data, offsets = textkit.flat(part.column(1))
        text = textkit.owners(found.first)
        number = np.concatenate([[i for i, line in enumerate(t.split(b"\n")) if line.strip(b" \t\n\v\f\r")] for t in (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:]))]).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(number), pa.array(boiler)], ["doc_id", "line", "boilerplate"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(textkit.mapper(run), "doc_id bigint, line bigint, boilerplate boolean")
