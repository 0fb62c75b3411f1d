"""Operator 9, substring dedup with compressed FM-indexes.

A window is 13 consecutive words of one document.  A word goes if a window that
covers it also starts, with the same words, in a document with a smaller doc_id.

Equal windows must meet in one index without every document being held against
every index, so windows are routed by content: a window belongs to the smallest
hash of its five-word pieces (its minimizer), and a run of consecutive windows
with one minimizer travels as one segment of words to the shard of that hash (as
several, of at most `RUN` windows each, where a text loops).

1. Each task sends the minimizers of its documents to their shards as packed
   arrays; a shard answers which documents have a minimizer that another document
   has too.  Minimizers seen twice inside a task are known to be shared; one of
   them goes to its shard, the others are spread evenly, so that a passage that a
   third of all documents hold doesn't meet in one place.
2. The answers come back by doc_id, and the segments of shared minimizers go to
   their shards.  Equal segments inside a task are decided there, by their smallest
   doc_id, and only that one travels.
3. A shard builds an FM-index (a wavelet matrix of the Burrows-Wheeler transform)
   of its distinct segments and streams the windows of every segment through
   backward search.  The range of suffixes that a window matches has a smallest
   doc_id; windows above it are reported as intervals of their documents.
4. Intervals are joined to the texts by doc_id, and the words outside them stay.

Defined cases: a null text has no words; an empty kept text has the digest of the
empty string; texts of fewer than 13 words lose nothing; a row with a null doc_id
neither loses nor takes words; rows with one doc_id are taken for one text and are
never smaller than each other; texts that loop, of any length, are cut into bounded
segments; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit
from cadenza.llm.fm_index import FMIndex
from cadenza.llm.storage import saved

U = np.uint64
WINDOW, PIECE = 13, 5
#: Windows of a segment, at most: a longer run (a text that loops) travels as several, so that sizes fit 16 bits.
RUN = 1024
#: Bytes of intervals that are broadcast to the texts, at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of text for each shard: with two shards a task, what a task reads does not grow with the corpus.
SHARD_BYTES = 3 << 20
#: Text that a task looks at at a time; equal parts inside it are combined.
SLICE = 2 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i with as many behind it."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def window_keys(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its row and its minimizer."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    own = np.repeat(np.arange(len(counts)), counts)
    if len(own) == 0:
        return np.zeros(0, np.int64), own, np.zeros(0, U)
    at = first[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    pieces = np.zeros(len(hashes) - piece + 1, U)
    for j in range(piece):
        pieces += hashes[j : j + len(pieces)] * (textkit.mix(np.array([j + 101], U))[0] | U(1))
    low = sliding_min(textkit.mix(pieces), window - piece + 1)
    return at, own, low[at]


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _by_doc(docs: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct docs, how many rows each has, and the columns in that order."""
    order = np.argsort(docs, kind="stable")
    ids, sizes = np.unique(docs, return_counts=True)
    return ids, sizes, [c[order] for c in columns]


def _shards(key: np.ndarray, shards: int) -> np.ndarray:
    return (textkit.mix(key) % U(shards)).astype(np.int32)


def _each_shard(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """As _whole(), of one shard of the task after another, so that one index stands at a time."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        columns = [batch.column(i + 1).to_pylist() for i in range(len(kinds))]
        for row, shard in enumerate(batch.column(0).to_pylist()):
            own = held.setdefault(shard, [[] for _ in kinds])
            for i, values in enumerate(columns):
                own[i].append(values[row])
    for shard in sorted(held):
        parts = held.pop(shard)
        yield [np.frombuffer(b"".join(x), kind) for x, kind in zip(parts, kinds)]
        textkit.let_go()


def _whole(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """The packed arrays of all rows, one after another, for each binary column from the second on."""
    held: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i in range(len(kinds)):
            held[i] += batch.column(i + 1).to_pylist()
    return [np.frombuffer(b"".join(x), kind) for x, kind in zip(held, kinds)]


def ask(shards: int):
    """Rows (doc_id, text) to packed (shard, minimizers, doc_ids, known) rows."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.asarray(part.column(0))
        _, own, key = window_keys(*textkit.word_hashes(part.column(1)))
        if len(key) == 0:
            return None
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        key, doc = key[new], ids[own[new]]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        known = ~head
        known[:-1] |= ~head[1:]  # another document of this task has it too
        shard = np.where(head, _shards(key, shards), (textkit.mix(doc.view(U)) % U(shards)).astype(np.int32))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(p, _binary(key[o]), _binary(doc[o]), _binary(known[o])) for p in range(shards) if len(o := order[cuts[p] : cuts[p + 1]])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "keys", "docs", "known"])

    return textkit.mapper(run, 1, SLICE)


def answer(shards: int):
    """A shard's packed rows to packed (shard, docs, keys) rows, by a hash of doc_id: minimizers that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _each_shard(batches, [U, np.int64, bool]):
            key, doc = _shared(*columns)
            yield from _packed(["shard", "docs", "keys"], _shards(doc.view(U), shards), shards, doc, key)

    return run


def _packed(names: list[str], shard: np.ndarray, shards: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a shard with the packed values of each column."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(p, *(_binary(c[order[cuts[p] : cuts[p + 1]]]) for c in columns)) for p in range(shards) if cuts[p] < cuts[p + 1]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))], names)


def keys_by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed (shard, docs, keys) rows to one (doc_id, keys) row a document."""
    doc, key = _whole(batches, [np.int64, np.int64])
    ids, sizes, (key,) = _by_doc(doc, key)
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(key, sizes, pa.int64())], ["doc_id", "keys"])


def intervals_by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed (shard, docs, starts, ends) rows to one (doc_id, starts, ends) row a document."""
    doc, start, end = _merged(*_whole(batches, [np.int64, np.int32, np.int32]))
    ids, sizes, (start, end) = _by_doc(doc, start, end)
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(start, sizes, pa.int32()), _lists(end, sizes, pa.int32())], ["doc_id", "starts", "ends"])


def _merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of a document become one."""
    if len(docs) == 0:
        return docs, starts, ends
    order = np.lexsort((ends, starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], docs[1:] != docs[:-1]])) << 33
    reach = np.maximum.accumulate(ends + number) - number
    at = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] > reach[:-1])]))
    last = reach[np.append(at[1:], len(docs)) - 1]
    return docs[at], starts[at].astype(np.int32), last.astype(np.int32)


def _shared(key: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, document) pairs of a shard whose minimizer another document has too."""
    if len(key) == 0:
        return key.view(np.int64), doc
    order = np.argsort(key, kind="stable")
    key, doc, known = key[order], doc[order], known[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
    good = known | several[group]
    return key[good].view(np.int64), doc[good]


def runs_of(hashes: np.ndarray, first: np.ndarray, shared: np.ndarray, shared_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most RUN windows with one minimizer that is among their row's shared ones: first word, windows, row, minimizer."""
    at, own, key = window_keys(hashes, first)
    if len(at) == 0:
        return at, at, own, key
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
    size = np.diff(np.append(start, len(at)))
    at, own, key = at[start], own[start], key[start]
    salted = textkit.mix(key) + own.astype(U) * U(0x9E3779B97F4A7C15)
    wanted = textkit.mix(shared) + textkit.owners(shared_first).astype(U) * U(0x9E3779B97F4A7C15)
    good = np.isin(salted, wanted)
    at, size, own, key = at[good], size[good], own[good], key[good]
    pieces = -(-size // RUN)
    of = np.repeat(np.arange(len(size)), pieces)
    past = RUN * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return at[of] + past, np.minimum(size[of] - past, RUN), own[of], key[of]


def contents(hashes: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each segment hashes[at : at + words]."""
    size = int(words.max(initial=0))
    total = textkit.mix(words.astype(U))
    for j in range(size):
        inside = words > j
        total[inside] = textkit.mix(total[inside] * U(0xC2B2AE3D27D4EB4F) + hashes[at[inside] + j])
    return total


def gather(hashes: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    index = np.repeat(at - np.concatenate([[0], np.cumsum(words)[:-1]]), words) + np.arange(int(words.sum()))
    return hashes[index]


def send(shards: int):
    """Rows (doc_id, text, keys) to packed (shard, words, sizes, doc_ids, starts, decided) rows of segments.

    A decided segment has no words: all its windows are known to stand in a smaller document.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.asarray(part.column(0))
        hashes, first = textkit.word_hashes(part.column(1))
        lists = part.column(2)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values) if lists.null_count else lists
        offsets = np.asarray(lists.offsets)
        at, size, own, key = runs_of(hashes, first, np.asarray(lists.values)[offsets[0] : offsets[-1]].view(U), offsets - offsets[0])
        if len(at) == 0:
            return None
        words = size + WINDOW - 1
        content = contents(hashes, at, words)
        doc = ids[own]
        order = np.lexsort((doc, content))
        at, words, own, key, content, doc = (x[order] for x in (at, words, own, key, content, doc))
        begin = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        least = np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
        decided = doc > least
        place = at - first[own]
        shard = np.where(decided, (textkit.mix(doc.view(U)) % U(shards)).astype(np.int32), _shards(key, shards))
        order = np.lexsort((place, doc, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for p in range(shards):
            o = order[cuts[p] : cuts[p + 1]]
            if len(o):
                sent = o[~decided[o]]
                rows.append((p, _binary(gather(hashes, at[sent], words[sent])), _binary(words[o].astype(np.int16)), _binary(doc[o]), _binary(place[o].astype(np.int32)), _binary(decided[o])))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "words", "sizes", "docs", "starts", "decided"])

    return textkit.mapper(run, 1, SLICE)


def report(shards: int):
    """A shard's packed segments to packed (shard, docs, starts, ends) rows, by a hash of doc_id: intervals of words that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _each_shard(batches, [U, np.int16, np.int64, np.int32, bool]):
            doc, start, end = _found(*columns)
            yield from _packed(["shard", "docs", "starts", "ends"], _shards(doc.view(U), shards), shards, doc, start, end)

    return run


def _found(word: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, decided: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and intervals of words that go, as a shard's segments show."""
    size = size.astype(np.int64)
    out = [(doc[decided], start[decided], start[decided] + size[decided])]
    size, doc, start = size[~decided], doc[~decided], start[~decided]
    if len(doc):
        at = np.cumsum(size) - size
        content = contents(word, at, size)
        order = np.lexsort((doc, content))
        begin = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
        group = np.empty(len(doc), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(doc))))
        head = order[begin]  # of each distinct segment, the one of the smallest document
        least = doc[head]
        later = doc > least[group]
        out.append((doc[later], start[later], start[later] + size[later]))
        windows, flags = search(word, at[head], size[head], least)
        # the windows found, for every place where the smallest document has the segment
        hit = np.flatnonzero(flags)
        if len(hit):
            seg, offset = windows[hit, 0], windows[hit, 1]
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(group[mine], kind="stable")]
            left = np.searchsorted(group[mine], seg, "left")
            count = np.searchsorted(group[mine], seg, "right") - left
            which = mine[np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            place = start[which] + np.repeat(offset, count)
            out.append((doc[which], place, place + WINDOW))
    return _merged(*(np.concatenate([x[i] for x in out]) for i in range(3)))


def search(word: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window of the distinct segments, and whether a smaller document has it."""
    _, ranks = np.unique(gather(word, at, size), return_inverse=True)
    # segments one after another, a separator in front of each and one at the end
    text = np.zeros(len(ranks) + len(at) + 1, np.int32)
    begin = np.cumsum(size + 1) - size
    text[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(ranks))] = ranks + 1
    owner = np.zeros(len(text), np.int64)
    owner[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(ranks))] = np.repeat(doc, size)
    index = FMIndex(text, WINDOW)
    counts = size - WINDOW + 1
    seg = np.repeat(np.arange(len(at)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    low, high = index.matches(text, begin[seg] + offset + WINDOW, WINDOW)
    found = np.flatnonzero(high > low)
    # the smallest document of a range: ranges of equal windows are equal, so one minimum a range
    flags = np.zeros(len(seg), bool)
    if len(found):
        starts, which = np.unique(low[found], return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[which] = high[found]
        edges = np.stack([starts, np.minimum(ends, len(text))], axis=1).ravel()
        owners = np.append(owner[index.order], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(owners, edges)[::2]
        flags[found] = least[which] < doc[seg[found]]
    return np.stack([seg, offset], axis=1), flags


def shard_count(docs: DataFrame, each: int = SHARD_BYTES) -> int:
    """Shards that the table's text needs, an even number: a task takes two, one after the other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 2 * max(1, -(-size // (2 * each)))


def intervals(docs: DataFrame) -> DataFrame:
    """doc_id, starts, ends (arrays of word positions, ends exclusive) of the words that go."""
    shards = shard_count(docs)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tasks = shards // 2
    asked = rows.mapInArrow(ask(shards), "shard int, keys binary, docs binary, known binary")
    # packed rows go to a shard and, packed again, to the documents: a row a shard and task, not a row a word or document
    answers = asked.repartition(tasks, "shard").mapInArrow(answer(shards), "shard int, docs binary, keys binary")
    answers = answers.repartition(tasks, "shard").mapInArrow(keys_by_doc, "doc_id bigint, keys array<bigint>")
    segments = rows.join(answers, "doc_id").select("doc_id", "text", "keys").mapInArrow(send(shards), "shard int, words binary, sizes binary, docs binary, starts binary, decided binary")
    found = segments.repartition(tasks, "shard").mapInArrow(report(shards), "shard int, docs binary, starts binary, ends binary")
    return found.repartition(tasks, "shard").mapInArrow(intervals_by_doc, "doc_id bigint, starts array<int>, ends array<int>")


def kept_bytes(column: pa.Array, starts: pa.Array, ends: pa.Array) -> tuple[np.ndarray, np.ndarray, list[memoryview]]:
    """Words, words removed, and the kept words joined by one space, of each row."""
    data, offsets = textkit.flat(column)
    begin, end, first = textkit.words(data, offsets)
    n = np.diff(first)
    gone = np.zeros(len(begin) + 1, np.int64)
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (starts, ends))
    sizes = np.asarray(a.value_lengths().fill_null(0))
    base = np.repeat(first[:-1], sizes)
    np.add.at(gone, base + np.asarray(a.flatten()), 1)
    np.add.at(gone, base + np.asarray(b.flatten()), -1)
    keep = np.cumsum(gone[:-1]) == 0
    # a copy with one more byte behind every row, so that every word has a byte behind it
    shift = np.repeat(np.arange(len(n)), np.diff(offsets))
    wide = np.full(len(data) + len(n), 32, np.uint8)
    wide[np.arange(len(data)) + shift] = data
    begin, end = begin + np.repeat(np.arange(len(n)), n), end + np.repeat(np.arange(len(n)), n)
    wide[end] = 32
    mark = np.zeros(len(wide) + 1, np.int8)
    mark[begin[keep]] += 1
    mark[np.minimum(end[keep] + 1, len(wide))] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    out = wide[inside]
    cuts = np.concatenate([[0], np.cumsum(inside)])[offsets + np.arange(len(offsets))]
    view = memoryview(out)
    texts = [view[x : max(x, y - 1)] for x, y in zip(cuts[:-1], cuts[1:])]
    left = np.concatenate([[0], np.cumsum(keep)])
    return n, n - (left[first[1:]] - left[first[:-1]]), texts


def with_intervals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs, then starts and ends; found is broadcast if it is small, else joined by a shuffle."""
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever columns docs has
    found = saved(found)
    size = found.agg(F.sum(64 + 16 * F.size("starts"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = docs.toDF(*names).join(found, F.col(names[docs.columns.index("doc_id")]).cast("bigint") == F.col("doc_id"), "left")
    return rows.select(*names, "starts", "ends")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, texts = kept_bytes(part.column(1), part.column(2), part.column(3))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = with_intervals(plain, intervals(docs))
    return rows.mapInArrow(textkit.mapper(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def strip(docs: DataFrame) -> DataFrame:
    """docs with its own columns: texts without the words that go (n_chars follows), and without the documents that lose every word.

    A document that loses nothing stays as it is, byte for byte.
    """
    names = docs.columns
    text = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [part.column(i) for i in range(len(names))]
        n, removed, kept = kept_bytes(columns[text], part.column(len(names)), part.column(len(names) + 1))
        lost = removed > 0
        new = pa.array([bytes(t).decode() if x else None for t, x in zip(kept, lost)], columns[text].type)
        columns[text] = pc.if_else(pa.array(lost), new, columns[text])
        if chars is not None:
            columns[chars] = pc.if_else(pa.array(lost), pc.utf8_length(new).cast(columns[chars].type), columns[chars])
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~lost | (n > removed)))

    rows = with_intervals(docs, intervals(docs))
    return rows.mapInArrow(textkit.mapper(run, text), docs.schema)
