"""Operator 7, edit-aware token counts.

A document's text is cut into leaves at places where the tokenizer's pre-token
pattern always cuts: before a single space between two letters.  A segment tree
over the leaves holds characters and tokens of every subtree.  An edit descends
by characters to the leaves it touches, takes one more leaf on a side where the
edit reaches the cut's own characters, encodes only that region again and updates
the sums on the paths to the root, so the count after an edit costs the region
and a logarithm, not the document.

Trees are plain columns (`chars` and `tokens`, heap-ordered arrays whose entry 1
is the root), so they can be written as a table and edited in a later job.
Nothing crosses rows: both jobs are one pass without a shuffle, except that
edit_table() first groups the edits by document.

Defined cases: a null text is an empty one and counts 0; an edit's range is
clipped to the text; a null replacement is an empty one and null numbers are 0;
edits of a document apply in the order of `seq` (then start, length,
replacement), each to what the one before has left; a document without a safe
place is one leaf; repeated rows are counted one by one; special tokens in a text
are ordinary text; very long texts are counted whole; a null doc_id is kept, and gets
no edits of a table; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textkit

#: Characters from which a leaf ends at the next safe place.
LEAF_CHARS = 256
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")

EDIT = "array<struct<start:int,length:int,replacement:string>>"
TREE = "chars array<int>, tokens array<int>"


@functools.lru_cache(maxsize=4)
def encoding(path: str | None = None, pattern: str | None = None):
    """The tokenizer of a rank file (by default a public byte-level one), made once a worker."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, leaf_chars: int = LEAF_CHARS, most: int | None = None) -> list[str]:
    """Leaves of a text; with `most`, the last one takes what is left."""
    out, at = [], 0
    while most is None or len(out) < most - 1:
        found = _SAFE.search(text, at + leaf_chars)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class Tree:
    """Sums of characters and tokens over a document's leaves, in heap order."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.slots = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, encode, leaf_chars: int = LEAF_CHARS) -> Tree:
        leaves = cut(text, leaf_chars)
        slots = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (slots - len(leaves))
        chars = [0] * slots + [len(x) for x in leaves] + pad
        tokens = [0] * slots + [len(encode(x)) for x in leaves] + pad
        for i in range(slots - 1, 0, -1):
            chars[i] = chars[2 * i] + chars[2 * i + 1]
            tokens[i] = tokens[2 * i] + tokens[2 * i + 1]
        return cls(chars, tokens)

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one with characters for the end), and where it starts."""
        node, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.slots:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.slots, start

    def put(self, slot: int, chars: int, tokens: int) -> None:
        node = slot + self.slots
        more, count = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += count
            node //= 2

    def edit(self, text: str, start: int, length: int, replacement: str, encode, leaf_chars: int = LEAF_CHARS) -> tuple[str, int]:
        """The edited text, and how many leaves were encoded."""
        start = min(max(start, 0), len(text))
        end = min(len(text), start + max(length, 0))
        if not text:
            low, left, high, right = 0, 0, 0, 0
        else:
            low, left = self.locate(start)
            high, right = self.locate(end)
            right += self.chars[self.slots + high]
        # a cut holds while its letter before and its space and letter behind are as they were
        while low > 0 and left > 0 and start < left + 2:
            low -= 1
            left -= self.chars[self.slots + low]
        while high < self.slots - 1 and right < len(text) and end > right - 1:
            high += 1
            right += self.chars[self.slots + high]
        region = cut(text[left:start] + replacement + text[end:right], leaf_chars, high - low + 1)
        region += [""] * (high - low + 1 - len(region))
        for slot, leaf in zip(range(low, high + 1), region):
            self.put(slot, len(leaf), len(encode(leaf)) if leaf else 0)
        return text[:start] + replacement + text[end:], high - low + 1


def build_trees(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, text and its tree: chars, tokens (arrays; entry 1 is the document's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            trees = [Tree.build(t, encode, leaf_chars) for t in batch.column(1).to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.chars for t in trees], ints), pa.array([t.tokens for t in trees], ints)], ["doc_id", "text", "chars", "tokens"])
            textkit.let_go()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, text string, {TREE}")


def edit_table(edits: DataFrame) -> DataFrame:
    """doc_id, seq, start, length, replacement rows to one row a document: doc_id, edits (in order)."""
    one = F.struct(*(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("seq", "start", "length")), F.coalesce("replacement", F.lit("")).alias("replacement"))
    grouped = edits.select(F.col("doc_id").cast("bigint").alias("doc_id"), one.alias("edit")).groupBy("doc_id").agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    return grouped.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement"))).alias("edits"))


def _edit_all(tree: Tree, text: str, edits: list[dict] | None, encode, leaf_chars: int) -> tuple[str, int]:
    encoded = 0
    for e in edits or []:
        text, leaves = tree.edit(text, e["start"] or 0, e["length"] or 0, e["replacement"] or "", encode, leaf_chars)
        encoded += leaves
    return text, encoded


def apply_edits(trees: DataFrame, edits: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Trees after an edit_table(): doc_id, text, chars, tokens, encoded (leaves encoded again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        ints = pa.list_(pa.int32())
        for batch in batches:
            ids, texts, chars, tokens, todo = (batch.column(i).to_pylist() for i in range(5))
            done = []
            for t, c, k, e in zip(texts, chars, tokens, todo):
                tree = Tree(c, k)
                t, encoded = _edit_all(tree, t, e, encode, leaf_chars)
                done.append((t, tree.chars, tree.tokens, encoded))
            columns = list(zip(*done)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(columns[0], pa.string()), pa.array(columns[1], ints), pa.array(columns[2], ints), pa.array(columns[3], pa.int64())], ["doc_id", "text", "chars", "tokens", "encoded"])

    rows = trees.join(edits, "doc_id", "left").select("doc_id", "text", "chars", "tokens", "edits")
    return rows.mapInArrow(run, f"doc_id bigint, text string, {TREE}, encoded bigint")


def count_with_edits(docs: DataFrame, edits: Column, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Trees and their edits in one pass, for edits that are a column of docs (array of start, length, replacement).

    doc_id, n_chars, n_tokens, edited_chars, edited_tokens, n_leaves, n_encoded.
    """
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "n_leaves", "n_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            for part in textkit.slices(batch, 1):
                out = np.zeros((part.num_rows, 6), np.int64)
                for i, (text, todo) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    tree = Tree.build(text, encode, leaf_chars)
                    before = tree.chars[1], tree.tokens[1]
                    _, encoded = _edit_all(tree, text, todo, encode, leaf_chars)
                    out[i] = (*before, tree.chars[1], tree.tokens[1], sum(c > 0 for c in tree.chars[tree.slots :]), encoded)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[:, k]) for k in range(6))], names)
            textkit.let_go()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), edits.cast(EDIT).alias("edits"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
