import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import embedding_dedup, flat_graph, fm_index, near_dedup, substring_dedup, textkit
from cadenza.llm.graph import components
from tests.llm.helpers import documents, prose


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + [(None, 1)], "u bigint, v bigint")).collect()}
    assert got == union_find(pairs)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def near_copies(seed, words, changes):
    rng = random.Random(seed)
    w = prose(seed // 100, words).split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark):
    rows = [(i, prose(10_000 + i, 80)) for i in range(40)]
    rows += [(100 + i, near_copies(500 + i, 200, i % 6)) for i in range(60)]  # a dense group around the threshold
    rows += [(300 + i, near_copies(900 + i, 60, i % 3)) for i in range(20)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "one  two"), (505, prose(1, 30000)), (506, prose(1, 30000) + " end")]
    docs = documents(spark, rows).withColumn("class_id", F.lit("clash")).withColumn("fp", F.lit(0))
    got = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
    texts = [(i, t) for i, t in rows if t and t.split()]
    s, w, f = near_dedup.counted(*textkit.set_words(pa.array([t for _, t in texts])))
    sets = [(s[f[k] : f[k + 1]], w[f[k] : f[k + 1]]) for k in range(len(texts))]
    pairs = [(texts[a][0], texts[b][0]) for a in range(len(texts)) for b in range(a) if near_dedup.similarity(sets[a], sets[b]) >= 0.8]
    want = union_find(pairs)
    assert {i: r.class_id for i, r in got.items()} == {i: want.get(i, i) for i, _ in rows}
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_near_dedup_small_tables(spark):
    assert near_dedup.classes(documents(spark, [])).count() == 0
    rows = near_dedup.classes(documents(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in rows) == [(0, 0), (1, 1), (1, 1)]


def test_probability_jaccard():
    a = (np.array([1, 2, 3], np.uint64), np.array([2, 1, 1]))
    b = (np.array([2, 3, 4], np.uint64), np.array([1, 3, 1]))
    x, y = {1: 2, 2: 1, 3: 1}, {2: 1, 3: 3, 4: 1}
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in (1, 2, 3, 4)) for i in (2, 3))
    assert near_dedup.similarity(a, b) == pytest.approx(want)
    sig = near_dedup.signatures(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 3, 6]), 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)


def brute_windows(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(50 + i, n) for i, n in enumerate([12, 13, 14, 20, 60, 200])]
    rows = []
    for i in range(120):
        parts = [prose(2000 + i, rng.choice([0, 3, 40, 100]))] + [rng.choice(shared) for _ in range(rng.choice([0, 1, 2, 3]))] + [prose(3000 + i, 5)]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300, None), (301, ""), (302, "a " * 40), (303, "a " * 30), (304, prose(1, 20000) + " " + shared[4]), (-5, shared[3])]
    docs = documents(spark, rows).withColumn("starts", F.lit("clash")).withColumn("shard", F.lit(0))
    want = brute_windows(rows)
    got = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}
    stripped = {r.doc_id: r for r in substring_dedup.strip(docs).collect()}
    texts = dict(rows)
    assert set(stripped) == {i for i, (n, g, _) in want.items() if n > g or g == 0}
    assert all(r.text == (want[i][2] if want[i][1] else texts[i]) for i, r in stripped.items())
    assert all(r.n_chars == len(r.text) for r in stripped.values() if r.text is not None)


def test_substrings_of_long_loops(spark):
    loop = "la li lu lo le " * 3
    rows = [(1, loop * 2700 + prose(61, 30)), (2, loop * 4700 + prose(62, 30)), (3, "x " * 40_000 + prose(63, 20)), (4, "y z " + "x " * 70_000 + prose(64, 20)), (5, prose(65, 50))]
    want = brute_windows(rows)
    got = {r.doc_id: r for r in substring_dedup.dedup(documents(spark, rows)).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}
    assert want[2][1] > 70_000 and want[4][1] >= 70_000


def test_substrings_without_rows_or_ids(spark):
    assert substring_dedup.dedup(documents(spark, [])).count() == 0
    assert substring_dedup.strip(documents(spark, [])).count() == 0
    long = prose(1, 30)
    rows = substring_dedup.dedup(documents(spark, [(None, long), (4, long), (4, long)])).collect()
    assert all(r.n_removed == 0 and r.n_words == 30 for r in rows)


def test_fm_index_finds_all():
    rng = np.random.default_rng(0)
    text = np.concatenate([[0], rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
    index = fm_index.FMIndex(text, 8)
    ends = np.array([e for e in range(9, len(text)) if 0 not in text[e - 6 : e]])
    low, high = index.matches(text, ends, 6, least=1)
    for e, a, b in zip(ends, low, high):
        want = {i for i in range(len(text) - 5) if (text[i : i + 6] == text[e - 6 : e]).all()}
        assert set(index.order[a:b].tolist()) == want


def vectors(spark, extra=()):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(i, base[i].tolist(), i % 3) for i in range(300)]
    hot = rng.normal(size=16)
    rows += [(1000 + i, (hot + rng.normal(size=16) * 0.06).tolist(), 1) for i in range(120)]
    rows += [(2000 + i, (base[i] * 3).tolist(), i % 3) for i in range(20)] + [(3000 + i, base[7].tolist(), 7 % 3) for i in range(15)]
    return rows + list(extra)


def test_embedding_links_equal_brute_force(spark):
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [1.0] * 16, None), (9005, [1.0] * 15, 1), (9006, [], 1), (9007, [None] + [1.0] * 15, 1), (9008, [float("inf")] * 16, 1)]
    rows = vectors(spark, odd)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit("clash")).withColumn("shard", F.lit(1))
    good = [r for r in rows if r[0] < 9000]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    near = np.abs(sims - 0.98) < 1e-9
    assert not near.any()
    links = [(good[a][0], good[b][0]) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and sims[a, b] >= 0.98]
    root = union_find(links)
    count = {}
    for a, b in links:
        count[a] = count.get(a, 0) + 1
        count[b] = count.get(b, 0) + 1
    for cap in (4096, 40):  # one block a shard, and parts that are searched against each other
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, cap=cap).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {r[0]: (count.get(r[0], 0), root.get(r[0], r[0]), root.get(r[0], r[0]) == r[0]) for r in rows}


def test_embedding_clump_of_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=16) + rng.normal(size=(600, 16)) * 0.05
    x = np.concatenate([x, rng.normal(size=(200, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    monkeypatch.setattr(embedding_dedup, "centroids", functools.partial(embedding_dedup.centroids, cell_rows=40))  # 20 of them
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert true.sum() > 100_000 and (found <= true).all() and found.sum() >= 0.99 * true.sum()


def test_embedding_cells_hold_every_link():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(150, 8)) * s for s in (0.02, 0.05, 0.1, 0.3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[::15]
    home, can = embedding_dedup.reached(x, c)
    q, n = flat_graph.exact_search(x, x, 0.98)
    assert can[q, home[n]].all() and 0 < can.mean() < 0.9


def test_embedding_fifteen_cells_a_label(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1200, 32))
    x[600:900] = x[:300] + rng.normal(size=(300, 32)) * 0.17  # around the threshold
    x[900:940] = x[5] + rng.normal(size=(40, 32)) * 0.1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    monkeypatch.setattr(embedding_dedup, "centroids", functools.partial(embedding_dedup.centroids, cell_rows=80))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1)], "vec_id bigint, embedding array<double>, label int")
    found = embedding_dedup.groups(table)
    (_, c, share), = embedding_dedup.centroids(found).values()
    assert len(c) == 15 and share < 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.99 * true.sum()
    every = np.arange(0, len(x), 20)  # the stated queries against all rows
    assert links[every].sum() >= 0.99 * true[every].sum()
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept


def test_embedding_answers_by_the_bound_if_the_audit_fails(spark, monkeypatch):
    rng = np.random.default_rng(14)
    flat = np.zeros((400, 16))  # links run along two dimensions only, so the first guess leaves cells out
    flat[:, :2] = rng.normal(size=(400, 2))
    flat[:, 2:] = rng.normal(size=(400, 14)) * 1e-3
    unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    monkeypatch.setattr(embedding_dedup, "centroids", functools.partial(embedding_dedup.centroids, cell_rows=40))
    monkeypatch.setattr(embedding_dedup, "REACH", 0.01)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(flat)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(flat))] == true.tolist()


def test_embedding_audit_looks_at_the_whole_label(spark):
    rows = [(i, [1.0, 0.01 * (i % 7), 0.001 * i], i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found, links = embedding_dedup.link(table)
    assert embedding_dedup.audit(found, links) == 1.0
    assert embedding_dedup.audit(found, links.filter("rep % 2 = 0")) == 0.0


def test_embedding_empty(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(table).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    x = np.concatenate([c + rng.normal(size=(20, 24)) * 0.05 for c in centers])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    neighbours, first = flat_graph.united(x)
    q, n = flat_graph.range_search(x, x, neighbours, first, flat_graph.medoids(x), 0.98)
    true_q, true_n = flat_graph.exact_search(x, x, 0.98)
    found = np.isin(true_q * len(x) + true_n, q * len(x) + n).mean()
    assert found >= 0.9 and (np.einsum("id,id->i", x[q], x[n]) >= 0.98).all()
