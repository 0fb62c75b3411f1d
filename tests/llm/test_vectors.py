import hashlib
import random

import numpy as np
import pytest

from cadenza.llm import ball_trees, integer_vectors, product_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, salt int, own int"


def near(x, books):
    return min(range(len(books)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, books[k])), k))


def lloyd(xs, books, rounds):
    """Plain Lloyd rounds in Python integers."""
    for _ in range(rounds):
        own = [near(x, books) for x in xs]
        for k in range(len(books)):
            mine = [x for x, o in zip(xs, own) if o == k]
            if mine:
                books[k] = [sum(c) // len(mine) for c in zip(*mine)]
    return [near(x, books) for x in xs], books


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, 2) for i, e, label in rows], SCHEMA)


def awkward(dimension, n, seed=3):
    """Few distinct values (ties), copies, repeated and null ids, and vectors that don't count."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-3, 3) / 64 for _ in range(dimension)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(500 + i, rows[5][1], 1) for i in range(40)] + [(3, rows[7][1], 2), (None, rows[9][1], None)]
    bad = [None, [], [1.0] * (dimension - 1), [float("nan")] + [0.0] * (dimension - 1), [None] + [0.0] * (dimension - 1), [float("inf")] + [0.0] * (dimension - 1)]
    return rows, [(900 + i, e, 1) for i, e in enumerate(bad)]


@pytest.mark.parametrize("block", [7, 4096])
def test_ball_trees_equal_lloyd(spark, monkeypatch, block):
    good, bad = awkward(6, 120)
    monkeypatch.setattr(integer_vectors.blocks, "__defaults__", (block,))
    rows, c = ball_trees.cluster(table(spark, good + bad).repartition(3), k=9, dimension=6)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in rows.collect())
    ints = [[int(np.floor(64 * v)) for v in e] for _, e, _ in good]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for (i, _, _), x in zip(good, ints) if i is not None)
    own, books = lloyd(ints, [list(x) for _, x in order[:9]], 3)
    assert c.tolist() == books
    assert got == sorted((-1 if i is None else i, k, sum((a - b) ** 2 for a, b in zip(x, books[k]))) for (i, _, _), x, k in zip(good, ints, own))
    about = ball_trees.with_inertia(rows, c).collect()
    assert {r.inertia for r in about} == {sum(g[2] for g in got)}
    assert {r.cluster: r.cluster_inertia for r in about} == {k: sum(g[2] for g in got if g[1] == k) for k in set(own)}


def test_balls_go_whole_and_ties_go_to_the_lower_number():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 5, (200, 3)), rng.integers(1000, 1005, (200, 3))])
    order, first, last, radius, sums = ball_trees.grow(x)
    c = np.array([[2, 2, 2], [1002, 1002, 1002], [2, 2, 2]])
    whole, leaves = ball_trees.owned(x[order], first, last, radius, sums, c)
    assert (1 in {k for _, k in whole}) and sum(last[n] - first[n] for n, _ in whole) + sum(len(a) for a, _ in leaves) == 400
    assert all(set(k) == {0} for _, k in leaves)  # 0 and 2 are equal: the lower number, at the leaves only


def test_large_components_are_exact_or_refused(spark):
    x = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]])
    assert integer_vectors.squared(x, x[:1]).tolist() == [[0], [1 + (5 + (1 << 27)) ** 2]]
    with pytest.raises(Exception, match="don't fit into a bigint"):
        ball_trees.cluster(table(spark, [(1, [1e30] * 64, 1)]))[0].count()


def test_empty_vectors(spark):
    rows, c = ball_trees.cluster(table(spark, []))
    assert rows.count() == 0 and len(c) == 0 and ball_trees.with_inertia(rows, c).count() == 0
    rows, books, _ = product_codes.compress(table(spark, []))
    assert books is None and product_codes.with_label_error(rows).count() == 0
    rows, books, _ = product_codes.compress(table(spark, [(1, [0.5] * 7, 1), (2, [0.5] * 8, 1)]))  # 7 can't be cut
    assert [(r.code, r.error) for r in rows.collect()] == [(None, None)] * 2


@pytest.mark.parametrize("block", [7, 4096])
def test_hamerly_equals_lloyd(spark, monkeypatch, block):
    good, bad = awkward(16, 150)
    monkeypatch.setattr(integer_vectors.blocks, "__defaults__", (block,))
    rows, books, scans = product_codes.compress(table(spark, good + bad).repartition(3))
    got = product_codes.with_label_error(rows).collect()
    ints = [[int(np.floor(4096 * v)) for v in e] for _, e, _ in good]
    order = sorted((i, x) for (i, _, _), x in zip(good, ints) if i is not None)[:16]
    codes, errors = [""] * len(good), [0] * len(good)
    for p in range(8):
        part = [x[2 * p : 2 * p + 2] for x in ints]
        own, book = lloyd(part, [list(x[2 * p : 2 * p + 2]) for _, x in order], 6)
        assert books[p].tolist() == book
        for i, (x, k) in enumerate(zip(part, own)):
            codes[i] += f"{k:02x}"
            errors[i] += sum((a - b) ** 2 for a, b in zip(x, book[k]))
    by = {}
    for (_, _, label), e in zip(good, errors):
        by[label] = by.get(label, 0) + e
    wanted = sorted((-1 if i is None else i, c, e, by[label]) for (i, _, label), c, e in zip(good, codes, errors))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got if r.code is not None) == wanted
    assert sorted(r.vec_id for r in got if r.code is None) == [901, 902]  # of another length
    assert scans[0] == 8 * len(good) and scans[-1] < scans[0]


def test_label_errors_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(product_codes, "BROADCAST_LABELS", 0)
    rows = spark.createDataFrame([(i, i % 3 or None, "00", i) for i in range(30)], "vec_id bigint, label int, code string, error bigint")
    got = {r.vec_id: r.label_error for r in product_codes.with_label_error(rows).collect()}
    assert got == {i: sum(j for j in range(30) if j % 3 == i % 3) for i in range(30)}
