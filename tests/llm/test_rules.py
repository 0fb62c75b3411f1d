import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import line_labels
from tests.llm.helpers import SF, documents, prose

LABELS = "doc_id bigint, quality int, toxic int, text string"


def base(text):
    """The contract's counts in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


AWKWARD = ["", None, " \n\t\n", "\n\nword", "a b c a b c", "é — 漢字 𝄞 a|b #x\r\nsame\nsame\n  same\nsame\n", "x\x0by\x0cz\xa0w", "<>&" * 5 + "\n" + "<>&" * 5, prose(1, 80), "\n".join([prose(2, 30)] * 4), prose(3, 20) + "\n" + prose(3, 20) + "\n" + prose(4, 70), "q " * 3000, "long" * 100_000]


def test_counts_are_the_contracts(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, AWKWARD[8]), (8, AWKWARD[8])]
    model = line_labels.Model(np.zeros(line_labels.WIDTH), -1.0, np.zeros((2, 2)))
    got = [r for r in line_labels.judge(documents(spark, rows), model).collect()]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert found == sorted((-1 if i is None else i, *base(t), not base(t)[5]) for i, t in rows)
    assert line_labels.judge(documents(spark, []), model).count() == 0


def test_counts_on_real_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = line_labels.Model(np.zeros(line_labels.WIDTH), -1.0, np.zeros((2, 2)))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_labels.judge(docs, model).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}


def chain_score(labels, score, change):
    return sum(s for s, y in zip(score, labels) if y) + sum(change[a][b] for a, b in zip(labels, labels[1:]))


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    for n in range(1, 9):
        for _ in range(20):
            score, change = rng.integers(-3, 4, n).astype(float).tolist(), rng.integers(-2, 3, (2, 2)).astype(float)
            got = line_labels.viterbi(score, change)
            assert chain_score(got, score, change) == max(chain_score(y, score, change) for y in itertools.product((0, 1), repeat=n))
    assert line_labels.viterbi([0.0, 0.0], np.zeros((2, 2))) == [0, 0]  # content wins ties


def test_likelihood_and_gradient():
    """Likelihood against enumeration of all labellings, its gradient against differences."""
    rng = np.random.default_rng(4)
    width, features = line_labels.WIDTH, len(line_labels.LINE_BINS)
    bins = rng.integers(0, width, (3, 4, features)).astype(np.int32)
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    label = np.array([1, 0, 1])

    def model(v):
        return line_labels.Model(v[:width], float(v[width]), v[width + 1 :].reshape(2, 2))

    v = rng.normal(0, 0.3, width + 5)
    value, emission, bias, change = line_labels.gradient(bins, real, label, model(v))
    want = 0.0
    for b, r, y in zip(bins, real, label):
        n = int(r.sum())
        score = [float(v[b[t]].sum() + v[width]) for t in range(n)]
        total = sum(np.exp(chain_score(z, score, v[width + 1 :].reshape(2, 2))) for z in itertools.product((0, 1), repeat=n))
        want += chain_score([y] * n, score, v[width + 1 :].reshape(2, 2)) - np.log(total)
    assert value == pytest.approx(want / 3)
    g = np.concatenate([emission, [bias], change.ravel()])
    for i in [*rng.integers(0, width, 12), *range(width, width + 5)]:
        up, down = v.copy(), v.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert g[i] == pytest.approx((line_labels.gradient(bins, real, label, model(up))[0] - line_labels.gradient(bins, real, label, model(down))[0]) / 2e-5, abs=1e-6)


def test_held_out_texts(spark):
    """Of texts that teach nothing and pass the base rules, good ones stay and bad ones go."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = line_labels.judge(docs, line_labels.fit(docs, labels)).join(labels, "doc_id").filter((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & ~F.col("base_failed")).collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert len(good) > 50 and sum(good) == len(good)
    assert len(bad) >= 10 and sum(bad) <= len(bad) * 0.1


def test_lines_are_judged_in_their_text(spark):
    junk = "\n".join("w%d### x%d$$$ y%d***" % (i, i, i) for i in range(40))
    docs = documents(spark, [(i, prose(i, 60).replace(" ", "\n", 3) if i % 2 else junk) for i in range(40)] + [(100, prose(100, 90) + ".\n" + junk[:60]), (101, prose(101, 30) + ".\n" + junk), (102, "\n\n"), (103, None)])
    labels = spark.createDataFrame([(i, i % 2, None, "clash") for i in range(40)] + [(None, 1, 0, ""), (1, None, 0, "")], LABELS)
    model = line_labels.fit(docs, labels)
    kept = {r.doc_id: r.kept for r in line_labels.judge(docs, model).collect()}
    assert kept[100] and not kept[101] and not kept[102] and not kept[103]
    lines = [(r.line, r.boilerplate) for r in line_labels.line_labels(docs.filter("doc_id = 101"), model).collect()]
    assert sorted(lines) == [(0, False)] + [(i, True) for i in range(1, 41)]


def test_without_labels_all_lines_are_content(spark):
    docs = documents(spark, [(1, prose(1, 60)), (2, "short")])
    model = line_labels.fit(docs, spark.createDataFrame([], LABELS))
    assert {r.doc_id: r.kept for r in line_labels.judge(docs, model).collect()} == {1: True, 2: False}
    assert line_labels.learned(line_labels.lines(pa.array([], pa.string())), np.zeros(0)).bias == -1.0
