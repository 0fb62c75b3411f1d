"""Operator 1, language ID by cross-parsing entropy.

For each labelled language a suffix automaton is built over a bounded sample of
its text: pieces, each piece of all its labelled text with the same probability, so
that long texts teach throughout.  A document is parsed greedily against each automaton: the longest
match with the language's text from the current position is one phrase, and the
next phrase starts behind it (a byte that the language's text lacks ends a phrase).  The phrases, times log2 of the length of the
language's text and divided by the length of the document, estimate the cross
entropy in bits a byte; the language with the lowest estimate wins.

Parsing runs over whole texts.  It cuts them into blocks of `block` bytes that
start a phrase of their own, so that thousands of blocks walk through the
automata in step, one NumPy gather a byte and language.

Defined cases: a null text, an empty one and one without a letter give `und`
with score 0 and null bits; equal estimates give the language that sorts first;
rows with a null lang teach nothing; without any labelled row every text is
`und`; very long texts are parsed whole; an empty table gives no rows.  Repeated rows
are scored one by one.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import textkit

#: Pieces that teach a language, at most, characters of one, and pieces of all languages together.
SAMPLE_ROWS, PIECE_CHARS, ALL_PIECES = 96, 256, 1 << 15
BLOCK = 1024
#: Bits a byte of a text behind its first phrase above which it is in no learned language: languages' own texts cost
#: 2 to 3, letters at random log2 26 = 4.7.
MAX_BITS = 4.0

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, bits double"


@dataclass
class Model:
    """One automaton after another in one table: value = 2 * (next state * symbols) + (a phrase ended)."""

    languages: list[str]
    symbol: np.ndarray
    symbols: int
    table: np.ndarray
    roots: np.ndarray
    log_size: np.ndarray


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case; a run of anything but letters becomes one space."""
    data = textkit.fold_case(data)
    letter = textkit.LETTER[data] == 1
    data = np.where(letter, data, 32).astype(np.uint8)
    keep = letter.copy()
    if len(data):
        keep[1:] |= letter[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        keep[inner] = letter[inner]
    sizes = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], sizes[offsets]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text (state 0 is the root)."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def build(texts: dict[str, list[str]]) -> Model:
    """Automata of the languages' sampled texts."""
    languages = sorted(texts)
    joined = []
    for lang in languages:
        data, _ = normalise(*textkit.flat(pa.array(["  ".join(texts[lang])], pa.large_string())))
        joined.append(data.tobytes())
    seen = sorted(set().union(*map(set, joined))) if joined else []
    symbol = np.zeros(256, np.int32)
    for i, b in enumerate(seen):
        symbol[b] = i + 1  # 0: never seen
    width = len(seen) + 1
    parts, roots, base = [], [], 0
    for text in joined:
        nexts = automaton(text)
        root = np.full(width, base * width * 2 + 1, np.int64)
        for b, to in nexts[0].items():
            root[symbol[b]] = (base + to) * width * 2 + 1
        table = np.tile(root, (len(nexts), 1))
        for s, out in enumerate(nexts):
            for b, to in out.items():
                table[s, symbol[b]] = (base + to) * width * 2
        parts.append(table.ravel())
        roots.append(base * width)
        base += len(nexts)
    table = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    kind = np.int32 if base * width * 2 < 2**31 - 2 else np.int64
    return Model(languages, symbol.astype(kind), width, table.astype(kind), np.array(roots, kind), np.array([math.log2(max(2, len(t))) for t in joined]))


def phrases(model: Model, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Phrases of each document in each language's text: [documents, languages]."""
    lengths = np.diff(offsets)
    blocks = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    if len(owner) == 0:
        return np.zeros((len(lengths), len(model.languages)))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][owner] + at * block
    size = np.minimum(block, offsets[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    symbols = model.symbol[data]
    n, langs = len(start), len(model.languages)
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # blocks longer than t
    state = np.repeat(model.roots[:, None], n, axis=1)
    count = np.zeros((langs, n), np.int32)
    for t in range(int(size[0])):
        w = active[t]
        sym = symbols[start[:w] + t]
        for k in range(langs):
            v = model.table[state[k, :w] + sym]
            count[k, :w] += v & 1
            np.right_shift(v, 1, out=state[k, :w])
    out = np.zeros((len(lengths), langs))
    for k in range(langs):
        out[:, k] = np.bincount(owner, count[k] + 1, len(lengths))
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)


def predict(model: Model, column: pa.Array, block: int = BLOCK) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score 0 to 1, bits a byte of each text, and bits a byte behind its first phrase (which costs a short text most of all)."""
    data, offsets = normalise(*textkit.flat(column))
    n, langs = np.diff(offsets), len(model.languages)
    good = has_letter(column) & (n > 0) & (langs > 0)
    bits, behind = np.full(len(n), np.nan), np.full(len(n), np.nan)
    score = np.zeros(len(n))
    names = np.full(len(n), "und", object)
    if good.any():
        cost = phrases(model, data, offsets, block) * model.log_size / np.maximum(n, 1)[:, None]
        best = cost.argmin(axis=1)
        rows = np.arange(len(n))
        low = cost[rows, best]
        if langs > 1:
            cost[rows, best] = np.inf
            other = cost.min(axis=1)
        else:
            other = 2 * low
        score[good] = (other / (low + other))[good]
        bits[good] = low[good]
        behind[good] = (low - model.log_size[best] / np.maximum(n, 1))[good]
        names[good] = np.array(model.languages, object)[best[good]]
    return pa.array(names, pa.string()), score, bits, behind


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text modulo parts is part; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def sample_pieces(labelled: DataFrame, label: str, rows: int, chars: int) -> dict[str, list[str]]:
    """`rows` pieces of `chars` characters a label at most, picked by hashes of doc_id and place: {label: pieces}.

    A text is cut into pieces one after another, and each piece of all labelled text is as
    likely as any other, so a label of a few long texts is learned throughout them.  Where
    labels are so many that `rows` of each would be more than `ALL_PIECES`, each gets its
    share of these, one at least.
    """
    labelled = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    last = F.greatest(F.lit(0), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / chars) - 1)
    marks = labelled.select("doc_id", label, last.alias("__last"))
    rows = max(1, min(rows, ALL_PIECES // max(1, marks.select(label).distinct().count())))
    pieces = marks.select("doc_id", label, F.explode(F.sequence(F.lit(0).cast("bigint"), "__last")).alias("__at"))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id", F.col("__at"), F.lit(11)), "doc_id", "__at")
    picked = pieces.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= rows).groupBy("doc_id", label).agg(F.collect_set("__at").alias("__at"))
    cut = F.transform("__at", lambda at: F.struct(at.alias("at"), F.substring(F.col("text"), (at * chars + 1).cast("int"), F.lit(chars)).alias("piece")))
    # at most ALL_PIECES ids (or one a label) are broadcast, and as many pieces of bounded length come back
    found = labelled.select("doc_id", label, "text").join(F.broadcast(picked), ["doc_id", label]).filter("text is not null").select("doc_id", label, F.explode(cut).alias("c"))
    texts: dict[str, list[str]] = {}
    for r in sorted(found.groupBy("doc_id", label, "c.at").agg(F.min("c.piece").alias("piece")).collect()):
        texts.setdefault(r[1], []).append(r[3])
    return texts


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out."""
    return build(sample_pieces(docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id"), 4, 2)), "lang", rows, chars))


def identify(docs: DataFrame, model: Model | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (a byte; null for und) of every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs))

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, confidence, bits, _ = predict(shared.value, part.column(1), block)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), lang, pa.array(confidence), pa.array(bits, mask=np.isnan(bits))], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return rows.mapInArrow(textkit.mapper(score, 1, 2 << 20), SCHEMA)


def keep_identified(docs: DataFrame, max_bits: float = MAX_BITS, model: Model | None = None) -> DataFrame:
    """The rows of docs, with its own columns, whose text is in a learned language: not und, and at most max_bits bits a byte behind its first phrase."""
    text = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        _, _, _, behind = predict(shared.value, part.column(text))
        return part.filter(pa.array(behind <= max_bits))  # und has none

    return docs.mapInArrow(textkit.mapper(run, text, 2 << 20), docs.schema)
