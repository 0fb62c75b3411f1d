import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import decontamination, textkit, token_counts
from tests.llm.helpers import documents, prose

ENCODE = token_counts.encoding().encode_ordinary
EDITS = st.lists(st.tuples(st.integers(-3, 90), st.integers(0, 40), st.sampled_from(["", " ", "ab", " cd ", "\n\n", "'s", " 12", "é", "日本"])), max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c'sé\n1日 ", max_size=80), EDITS, st.sampled_from([1, 4, 256]))
def test_tree_equals_full_count(text, edits, leaf):
    tree = token_counts.Tree.build(text, ENCODE, leaf)
    assert tree.tokens[1] == len(ENCODE(text))
    for start, length, new in edits:
        a = min(max(start, 0), len(text))
        want = text[:a] + new + text[min(len(text), a + length) :]
        text, _ = tree.edit(text, start, length, new, ENCODE, leaf)
        assert text == want and tree.tokens[1] == len(ENCODE(text)) and tree.chars[1] == len(text)


def test_edits_touch_few_leaves():
    text = prose(1, 20000)
    tree = token_counts.Tree.build(text, ENCODE)
    _, encoded = tree.edit(text, 50000, 5, "x", ENCODE)
    assert encoded <= 3 and tree.slots > 200


def test_trees_as_tables(spark):
    docs = documents(spark, [(1, prose(1, 300)), (2, None), (3, ""), (4, "one two"), (4, "one two")]).withColumn("tokens", F.lit("clash"))
    edits = spark.createDataFrame([(1, 1, 5, 3, "new words"), (1, 0, 0, 0, "start "), (3, None, 4, None, None), (9, 0, 0, 0, "x")], "doc_id bigint, seq int, start int, length int, replacement string")
    trees = token_counts.build_trees(docs, leaf_chars=32)
    out = token_counts.apply_edits(trees, token_counts.edit_table(edits), leaf_chars=32).collect()
    assert len(out) == 5
    for r in out:
        assert r.tokens[1] == len(ENCODE(r.text)) and r.chars[1] == len(r.text)
    first, old = [r.text for r in out if r.doc_id == 1][0], prose(1, 300)
    assert first == ("start " + old)[:5] + "new words" + ("start " + old)[8:]
    assert token_counts.build_trees(docs.limit(0)).count() == 0


def test_query_counts(spark):
    docs = documents(spark, [(i, prose(i, 200)) for i in range(20)] + [(50, None), (51, prose(5, 30000))])
    one = F.array(F.struct(F.lit(7).alias("start"), F.lit(9).alias("length"), F.lit(" mid ").alias("replacement")))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.count_with_edits(docs, one).collect():
        t = texts[r.doc_id]
        new = t[: min(7, len(t))] + " mid " + t[min(16, len(t)) :]
        assert (r.n_tokens, r.edited_tokens) == (len(ENCODE(t)), len(ENCODE(new)))


def exact(items, docs, threshold=0.8):
    def sets(texts):
        s, f = textkit.set_words(pa.array(texts, pa.string()))
        return [set(s[f[i] : f[i + 1]].tolist()) for i in range(len(texts))]

    a, b = sets([t for _, t in items]), sets([t for _, t in docs])
    return {(i, d): len(x & y) / len(x) for (i, _), x in zip(items, a) for (d, _), y in zip(docs, b) if x and len(x & y) / len(x) >= threshold}


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(1000 + i, rng.choice([5, 6, 9, 14, 30, 59, 200]))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    docs = [(i, prose(i, rng.choice([3, 50, 400]))) for i in range(60)] + [(100, prose(77, 20000)), (101, None), (102, ""), (103, "two words")]
    for i in range(30):
        words = docs[i][1].split()
        words[rng.randrange(len(words) + 1) :][:0] = []
        at = rng.randrange(len(words) + 1)
        docs[i] = (docs[i][0], " ".join(words[:at] + items[i][1].split() + words[at:]))
    words = docs[60][1].split()
    docs[60] = (100, " ".join(words[:12345] + items[35][1].split() + words[12345:]))
    got = decontamination.contaminated(documents(spark, docs + [docs[0]]).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x")))
    found = {(r.item_id, r.doc_id): r.containment for r in got.collect()}
    want = exact([x for x in items if x[1]], [d for d in docs if d[1]])
    assert set(found) == set(want) and len(want) >= 31
    assert all(np.isclose(found[k], want[k]) for k in want)
    blocks = decontamination.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), block=10)
    assert {(r.item_id, r.doc_id) for r in blocks.collect()} == set(want)


def test_every_text_of_an_item_is_found(spark):
    texts = [prose(600 + i, 20) for i in range(3)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (1, texts[0])], "item_id bigint, text string")
    docs = documents(spark, [(i, f"{prose(700 + i, 30)} {t}") for i, t in enumerate(texts)])
    for block in (50_000, 2):
        got = {(r.item_id, r.doc_id) for r in decontamination.contaminated(docs, items, block=block).collect()}
        assert got == {(1, 0), (1, 1), (2, 2)}


def test_counts_of_odd_tables(spark):
    none = F.array().cast(token_counts.EDIT)
    docs = documents(spark, [(None, "one two"), (1, None)]).withColumn("n_tokens", F.lit("clash")).withColumn("edits", F.lit(1))
    assert sorted((r.doc_id or 0, r.n_tokens, r.edited_tokens) for r in token_counts.count_with_edits(docs, none).collect()) == [(0, 2, 2), (1, 0, 0)]
    assert token_counts.count_with_edits(docs.limit(0), none).count() == 0


def test_no_items_or_documents(spark):
    items = spark.createDataFrame([(1, prose(1, 20))], "item_id bigint, text string")
    assert decontamination.contaminated(documents(spark, []), items).count() == 0
    assert decontamination.contaminated(documents(spark, [(1, prose(1, 20))]), items.limit(0)).count() == 0
