"""Groups that count from their anchor, against a plain loop, with batches that end inside chains."""

import numpy as np
import pytest

from cadenza.operators import folds


def plain(rows, window):
    """{note_id: group_no} of rows (recording_id, at, note_id); rows without a time are groups of their own and come first."""
    out = {}
    for name in {r[0] for r in rows}:
        anchor, no = None, 0
        for _, t, i in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if anchor is None or t - anchor > window:
                anchor, no = t, no + 1
            out[i] = no
    return out


@pytest.mark.parametrize("batch", [1, 2, 5, 10_000])
def test_groups_equal_a_loop(spark, batch):
    rng = np.random.default_rng(batch)
    rows, k = [], 0
    for name, n, far in ((0, 60, 40), (1, 60, 12), (2, 40, 200), (3, 1, 1)):
        t = 0
        for _ in range(n):
            t += int(rng.integers(0, far))
            rows.append((name, t, k))
            k += 1
    rows += [(1, None, k), (1, None, k + 1), (4, None, k + 2), (4, None, k + 3)]
    table = spark.createDataFrame(rows, "recording_id long, at long, note_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.note_id: r.group_no for r in folds.anchored_groups(table, "at", 30, "note_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 30)
