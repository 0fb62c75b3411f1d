import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat_format, language_id
from tests.llm.helpers import SF, documents, prose


def brute_phrases(text: str, reference: str, block: int) -> int:
    """Greedy phrases by substring search; a byte that the reference lacks ends a phrase and starts none."""
    count = 0
    for a in range(0, len(text), block):
        count, phrase = count + 1, ""
        for c in text[a : a + block]:
            if phrase + c in reference:
                phrase += c
            else:
                count, phrase = count + 1, c if c in reference else ""
    return count


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_phrases_equal_brute_force(block):
    model = language_id.build({"en": [prose(1, 200)], "fr": [prose(2, 200, "fr")]})
    texts = [prose(3, 60), prose(4, 60, "fr"), "th", "zzz th", ""]
    data, offsets = language_id.normalise(*language_id.textkit.flat(pa.array(texts)))
    got = language_id.phrases(model, data, offsets, block)
    raw = data.tobytes()
    for k, name in enumerate(model.languages):
        own, _ = language_id.normalise(*language_id.textkit.flat(pa.array([prose(1, 200) if name == "en" else prose(2, 200, "fr")])))
        reference = own.tobytes().decode("latin1")
        for i in range(len(texts)):
            text = raw[offsets[i] : offsets[i + 1]].decode("latin1")
            want = brute_phrases(text, reference, block)
            assert got[i, k] == want


def test_known_automaton_counts_exactly():
    model = language_id.build({"x": ["abcabd"]})
    data, offsets = language_id.normalise(*language_id.textkit.flat(pa.array(["abcabc", "abdabd", "cab"])))
    assert language_id.phrases(model, data, offsets).ravel().tolist() == [2, 2, 1]


def test_cases(spark):
    rows = [(i, prose(i, 40), "en") for i in range(40)] + [(100 + i, prose(i, 40, "fr"), "fr") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "12 $$ 3"), (203, prose(7, 30000)), (None, prose(9, 30), "en"), (0, prose(0, 40), "en")]
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert language_id.identify(docs).count() == len(rows)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert got[203].lang_pred == "en" and got[5].lang_pred == "en" and got[105].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_and_unlabelled(spark):
    assert language_id.identify(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents(spark, [(1, "abc def")])).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_rejects(spark):
    rng = np.random.default_rng(4)
    noise = " ".join("".join(rng.choice(list("bcdfgjkmpqvwxyz"), 7)) for _ in range(60))
    docs = documents(spark, [(i, prose(i, 40), "en") for i in range(40)] + [(50, "$$ 12"), (51, None), (52, noise), (53, "")])
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(40))


def test_many_languages_share_the_pieces(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_PIECES", 12)
    docs = documents(spark, [(i, prose(i, 400), f"l{i % 5}") for i in range(60)] + [(100 + i, prose(i, 3), "l0") for i in range(40)])
    pieces = language_id.sample_pieces(docs, "lang", 96, 64)
    assert {k: len(v) for k, v in pieces.items()} == {f"l{k}": 2 for k in range(5)}
    monkeypatch.setattr(language_id, "ALL_PIECES", 1000)
    own = language_id.sample_pieces(docs, "lang", 10, 64)["l0"]
    assert sum(len(p) == 64 for p in own) >= 9  # short texts teach little more than they hold


def test_long_texts_teach_throughout(spark):
    docs = documents(spark, [(1, prose(1, 4000), "a"), (2, prose(2, 3), "a"), (3, None, "a"), (4, "", "b")])
    pieces = language_id.sample_pieces(docs, "lang", 20, 64)
    assert len(pieces["a"]) == 20 and len(set(pieces["a"])) == 20 and pieces["b"] == [""]
    places = sorted(prose(1, 4000).find(p) for p in pieces["a"])
    assert places[0] < 8000 and places[-1] > 14000


@pytest.mark.parametrize("block, chunk", [(2, 7), (256, 4096)])
def test_chat_spans_in_parts(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(chat_format, "PREFIX_BLOCK", block)
    monkeypatch.setattr(chat_format, "CHUNK", chunk)
    rows = [(c, i, ["user", "assistant", "assistant"][i % 3], "é😀</turn>"[: (i * 7 + c) % 11] * (i % 4)) for c in range(9) for i in range(c * 2)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_conversations(table)
    for r in chat_format.read_back(formatted).join(formatted.select("conv_id", "loss_spans"), "conv_id").collect():
        mine = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss_texts == [t for role, t in mine if role == "assistant"]
        assert len(r.loss_spans) == len(r.loss_texts)


def test_a_conversation_of_200_000_turns_takes_linear_time(spark):
    table = spark.range(200_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text é ', id, ' ### ') AS text")
    began = time.time()
    row = chat_format.digests(chat_format.format_conversations(table)).first()
    assert time.time() - began < 30
    loss = "".join(f"text é {i} ### " for i in range(1, 200_000, 2))
    assert row.n_turns == 200_000 and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_of_very_long_texts(spark):
    text = "### x </turn> " * 60_000
    table = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    row = chat_format.digests(chat_format.format_conversations(table)).first()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    hard = ["### Assistant: </turn> ok", "<\\/turn>####x#\\###", "</part>", "a: b", "", None, "\\", "#", "é😀", "</turn>\n### user: x", "%3A%25:", "#\\#\\\\#"]
    rows = [(k, i, role, t) for k, role in enumerate(["user", "assistant", "sy:%s#\\##"]) for i, t in enumerate(hard)]
    rows += [(9, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(hard)] + [(9, None, "user", "first"), (9, 3, "user", "tie"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(table)).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = chat_format.format_conversations(table.filter("conv_id = 1")).first()
    assert one.formatted.count("### ") == 1 and one.formatted.count("</turn>\n") == 1  # texts can't forge a turn
    assert chat_format.format_conversations(table.limit(0)).count() == 0
