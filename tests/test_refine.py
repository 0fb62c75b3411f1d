import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza import catalogue
from cadenza.operators import drift, folds, hands, key, lanes, matching, refine, tempo, verify
from cadenza.plans import analysis
from cadenza.plans.analysis import analyse
from cadenza.sources import pieces, views

NOTE = "recording_id long, note_id long, midi int, start_us long, end_us long, hand string, peak_fill double, roll_support double, detection_confidence double, pitch_confidence double, timing_confidence double, duration_confidence double, is_restrike boolean"
SF = "/root/testdata/sf0.001"


def notes(spark, rows, **more):
    """rows of (midi, start s, end s); more columns by name, one value for all or a list."""
    base = {"hand": "unknown", "peak_fill": 1.0, "roll_support": 1.0, "detection_confidence": 1.0, "pitch_confidence": 1.0, "timing_confidence": 0.7, "duration_confidence": 0.7, "is_restrike": False} | more
    pick = lambda c, i: base[c][i] if isinstance(base[c], list) else base[c]
    full = [(0, i + 1, m, round(a * 1e6), round(b * 1e6), *(pick(c, i) for c in base)) for i, (m, a, b) in enumerate(rows)]
    return spark.createDataFrame(full, NOTE)


def attacks(spark, *seconds):
    return spark.createDataFrame([(0, round(s * 1e6)) for s in seconds], "recording_id long, attack_us long")


def times(df, *columns):
    return [tuple(r) for r in df.orderBy("note_id").select("note_id", *columns).collect()]


def test_repeats_stay_and_fragments_merge(spark):
    repeats = notes(spark, [(64, 1 + 0.4 * i, 1.3 + 0.4 * i) for i in range(5)])
    assert refine.merge_fragments(repeats).count() == 5
    parts = notes(spark, [(60, 0, 0.5), (60, 0.51, 1.0), (60, 1.03, 1.06), (60, 2.0, 2.01), (61, 0.2, 0.9)])
    rows = refine.merge_fragments(parts).orderBy("note_id").collect()
    assert [(r.note_id, r.end_us, r.parts) for r in rows] == [(1, 1_060_000, 3), (5, 900_000, 1)]
    struck = notes(spark, [(60, 0, 0.5), (60, 0.4, 1.0)], is_restrike=[False, True])
    assert refine.merge_fragments(struck).count() == 2


def test_trim_is_idempotent(spark):
    rows = notes(spark, [(60, 0, 1.0), (60, 0.5, 0.8), (60, 0.51, 2.0), (61, 0, 3.0)])
    once = refine.trim_same_pitch(rows)
    assert times(once, "end_us") == [(1, 499_000), (3, 2_000_000), (4, 3_000_000)]
    assert times(refine.trim_same_pitch(once), "end_us") == times(once, "end_us")


def test_groups_count_from_their_anchor(spark):
    rows = notes(spark, [(40 + 5 * i, 0.02 * i, 1) for i in range(4)])
    assert times(refine.chord_groups(rows), "group_no") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_chords_align_but_runs_do_not(spark):
    chord = notes(spark, [(60, 1.0, 1.5), (64, 1.01, 1.5), (67, 1.02, 1.6)])
    assert times(refine.align_chords(chord), "start_us", "end_us") == [(1, 1_010_000, 1_510_000), (2, 1_010_000, 1_500_000), (3, 1_010_000, 1_590_000)]
    run = notes(spark, [(60, 1.0, 1.5), (61, 1.01, 1.5), (62, 1.02, 1.6)])
    assert times(refine.align_chords(run), "moved") == [(1, False), (2, False), (3, False)]
    heard = refine.align_chords(chord, attacks(spark, 0.99, 1.03))
    assert {r[1] for r in times(heard, "start_us")} == {990_000} or {r[1] for r in times(heard, "start_us")} == {1_030_000}


def test_releases_and_durations(spark):
    rows = notes(spark, [(60, 0, 1.0), (64, 0, 1.02), (67, 0, 1.025), (70, 1.015, 1.024)])
    assert times(refine.align_releases(rows), "end_us") == [(1, 1_022_000), (2, 1_022_000), (3, 1_022_000), (4, 1_024_000)]
    same = notes(spark, [(40 + i, i, i + 0.5 + 0.005 * i) for i in range(8)])
    assert {r[1] for r in times(refine.consolidate_durations(same).withColumn("d", F.col("end_us") - F.col("start_us")), "d")} == {517_500}
    assert refine.duration_clusters(same.limit(7)).count() == 0


def test_snapping(spark):
    rows = notes(spark, [(60, 1.03, 1.5), (64, 1.04, 1.5), (61, 1.05, 1.6), (72, 3.0, 3.5)])
    got = times(refine.snap_onsets(rows, attacks(spark, 1.0, 5.0)), "start_us", "end_us", "snapped")
    assert got == [(1, 1_000_000, 1_470_000, True), (2, 1_000_000, 1_460_000, True), (3, 1_050_000, 1_600_000, False), (4, 3_000_000, 3_500_000, False)]


def test_silent_and_bleeding_notes_go(spark):
    rows = notes(spark, [(60, 1.0, 1.05), (60, 2.0, 2.05), (60, 3.0, 3.5)])
    assert times(refine.drop_silent_short(rows, attacks(spark, 1.01))) == [(1,), (3,)]
    assert refine.drop_silent_short(rows, attacks(spark).limit(0)).count() == 3
    bleed = notes(spark, [(60, 1.0, 2.0), (61, 1.1, 1.9), (70, 1.0, 2.0)], peak_fill=[1.0, 0.5, 0.5])
    assert times(refine.drop_glow_bleed(bleed)) == [(1,), (3,)]
    bloom = notes(spark, [(60, 1.0, 2.0), (62, 1.1, 1.9), (63, 1.0, 2.0)], roll_support=[0.9, 0.1, 0.1])
    assert times(refine.drop_bloom(bloom)) == [(1,), (3,)]


def test_nearest_takes_the_earlier_of_two(spark):
    rows = notes(spark, [(60, 1.0, 2), (60, 5.0, 6), (61, 0.0, 1)])
    assert times(matching.nearest(rows, attacks(spark, 0.9, 1.1, 4.0), "start_us", "attack_us"), "nearest_us") == [(1, 900_000), (2, 4_000_000), (3, 900_000)]
    assert times(matching.nearest(rows, attacks(spark).limit(0), "start_us", "attack_us"), "nearest_us") == [(1, None), (2, None), (3, None)]


def test_flags(spark):
    rows = notes(spark, [(60, 0, 1.0), (60, 0.02, 1.0), (72, 1.5, 1.505), (60, 2.0, 3.0)])
    got = {r.note_id: r.issues for r in verify.error_flags(rows).collect()}
    assert got == {1: [], 2: ["possible_duplicate", "overlaps_same_pitch"], 3: ["very_short", "octave_jump_isolated"], 4: []}


def test_perfect_reconstruction_scores_one(spark):
    truth = pieces.as_table(spark, pieces.demo_piece())
    found = truth.withColumnRenamed("truth_id", "note_id").withColumn("start_us", F.col("start_us") + 7000).withColumn("end_us", F.col("end_us") + 7000)
    row = matching.accuracy(found, truth).first()
    assert (row.true_positive, row.precision, row.recall, row.f1, row.mean_onset_error_ms) == (40, 1.0, 1.0, 1.0, 7.0)
    assert len(pieces.scale_piece()) == 13


def test_matching_is_one_to_one(spark):
    truth = pieces.as_table(spark, [(60, 1.0, 1.5, "left", 80)])
    row = matching.accuracy(notes(spark, [(60, 0.99, 1.5), (60, 1.01, 1.5), (61, 1.0, 1.5)]), truth).first()
    assert (row.true_positive, row.false_positive, row.false_negative) == (1, 2, 0)


def test_tempo_of_a_metronome(spark):
    steady = notes(spark, [(60 + i % 12, 0.25 + 0.6 * i, 0.5 + 0.6 * i) for i in range(40)] + [(72, 0.4 + 0.6 * i, 0.5 + 0.6 * i) for i in range(40)])
    row = tempo.estimate(steady).first()
    assert abs(row.bpm - 100) < 0.2 or abs(row.bpm / 100 - round(row.bpm / 100 * 2) / 2) < 0.01
    few = tempo.estimate(notes(spark, [(60, 0, 1), (61, 1, 2)])).first()
    assert (few.bpm, few.confidence) == (120.0, 0.2)


def test_tracked_grid(spark):
    steady = notes(spark, [(60, 0.3 + 0.5 * i, 0.5 + 0.5 * i) for i in range(60)])
    beats = spark.createDataFrame([(0, 0.5, 0.3)], "recording_id long, period double, phase double")
    grid = drift.beat_map(steady, beats)
    rows = [r.beat for r in drift.beats_on(steady, grid, beats).orderBy("start_us").collect()]
    steps = [b - a for a, b in zip(rows, rows[1:])]
    assert all(abs(s - 1) < 0.05 for s in steps)


def test_tempo_hits_equal_counting_each_phase(spark):
    rng = random.Random(6)
    onsets = [round(rng.choice([0.25, 0.125, 0.01]) * rng.randrange(400) + rng.choice([0, 0.02, -0.02, rng.random()]), 6) for _ in range(60)]
    tempi = [65.0, 75.0, 100.0, 120.0, 150.0, 169.8]
    best = None
    for k, bpm in enumerate(tempi):
        step = 60.0 / bpm / 4
        for j in range(64):
            g = [(t - j * step / 64) / step for t in onsets]
            hits = sum(abs(x - round(x)) * step <= 0.02 for x in g)
            if best is None or hits > best[0]:
                best = (hits, bpm, j * step / 64)
    rows = notes(spark, [(60, t, t + 0.1) for t in onsets])
    for most in (8192, 7):  # in one row, and in parts whose counts add up
        arrays = tempo.onset_arrays(rows, most)
        assert arrays.count() == (1 if most > 60 else 9)
        row = tempo.grid_search(arrays.withColumn("tempi", F.array(*map(F.lit, tempi)))).first()
        assert (row.hits, row.bpm, row.onsets) == (best[0], best[1], 60) and abs(row.phase - best[2]) < 1e-9
    whole, parts = (tempo.estimate(rows).first(), tempo.estimate(rows, most=7).first())
    assert whole == parts


def test_tracked_grid_follows_a_slowing_performance(spark):
    """Against the same rule over arrays, and against the beats that were played."""
    t, times_ = 0.5, []
    for i in range(160):
        times_.append(round(t, 6))
        t += 0.5 * (1 + 0.0009 * i) / 2
    rows = notes(spark, [(60 + i % 5, a, a + 0.1) for i, a in enumerate(times_)])
    found = tempo.estimate(rows)
    grid = drift.beat_map(rows, found)
    beats = [r.beat for r in drift.beats_on(rows, grid, found).orderBy("start_us").collect()]
    steps = [b - a for a, b in zip(beats, beats[1:])]
    assert all(abs(s - steps[0]) < 0.08 for s in steps) and abs(sum(steps) / len(steps) - steps[0]) < 0.05
    axis = grid.orderBy("ts").toPandas()
    assert np.allclose(np.diff(axis.ts), 0.01) and (np.diff(axis.phi) > 0).all()
    assert abs(axis.ts.iloc[0] - (times_[0] - 2)) < 1e-9 and len(axis) == len(np.arange(times_[0] - 2, times_[-1] + 10, 0.01))
    # the windows' tempi on straight lines, summed up by the trapezium rule, less the windows' mean turns
    local = drift.local_periods(drift.windows(rows), found).orderBy("i").toPandas()
    centres = times_[0] + 1.5 * local.i.to_numpy()
    rate = 4 / np.interp(axis.ts, centres, local.period)
    phi = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * 0.01)])
    own = [np.interp([x for x in times_ if abs(x - c) <= 3], axis.ts, phi) for c in centres]
    turn = np.unwrap([np.angle(np.exp(2j * np.pi * x).mean()) for x in own]) / (2 * np.pi)
    want = phi - np.interp(axis.ts, centres, turn)
    shift = want - axis.phi.to_numpy()
    assert np.abs(shift - np.rint(shift[0])).max() < 1e-6


def test_short_recordings_have_no_tracked_grid(spark):
    rows = notes(spark, [(60, i * 0.2, i * 0.2 + 0.1) for i in range(20)])
    found = tempo.estimate(rows)
    assert drift.beat_map(rows, found).count() == 0
    beats = drift.beats_on(rows, drift.beat_map(rows, found), found).collect()
    row = found.first()
    assert all(abs(r.beat - (r.start_us / 1e6 - row.phase) / row.period) < 1e-9 for r in beats)


def test_keys(spark):
    c_major = notes(spark, [(60 + p, i, i + (2 if p in (0, 7) else 1)) for i, p in enumerate((0, 2, 4, 5, 7, 9, 11, 0, 7))])
    assert tuple(key.detect_key(c_major).select("tonic_pc", "mode", "fifths").first()) == (0, "major", 0)


def test_hands(spark):
    wide = notes(spark, [(40, 0, 1), (45, 0, 1), (70, 0, 1), (76, 0, 1), (72, 2, 3), (38, 2, 3)])
    got = times(hands.by_context(wide), "hand", "hand_confidence")
    assert got == [(1, "left", 0.7), (2, "left", 0.7), (3, "right", 0.7), (4, "right", 0.7), (5, "right", 0.7), (6, "left", 0.7)]
    doubled = notes(spark, [(30, 0, 1), (44, 0, 1), (56, 0, 1), (68, 0, 1), (92, 0, 1)])
    assert hands.by_context(doubled).count() < 5
    one = hands.by_colour(notes(spark, [(60, 0, 1), (72, 0, 1)]).withColumn("color_cluster", F.lit(None).cast("int")))
    assert {r.hand for r in one.collect()} == {None}


def test_hands_equal_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        at = i * 0.2
        rows += [(rng.randrange(30, 100), round(at + rng.random() * 0.02, 6), at + 0.1) for _ in range(rng.choice([1, 1, 2, 3, 5, 6]))]
        if i % 4 == 0:
            rows += [(p, at, at + 0.1) for p in (rng.randrange(30, 40), *(48 + 12 * k for k in range(rng.choice([2, 4]))))]
    table = notes(spark, rows)
    got = {r.note_id: (r.hand, r.hand_confidence, r.hand_unreachable) for r in hands.by_context(table).collect()}

    def width(ps, k):
        return max(ps[k - 1] - ps[0] if k else 0, ps[-1] - ps[k] if k < len(ps) else 0)

    want, groups = {}, []
    for r in table.orderBy("start_us", "midi", "note_id").collect():
        if not groups or r.start_us - groups[-1][0].start_us > 30_000:
            groups.append([])
        groups[-1].append(r)
    every = [r[0] for r in rows]
    place = [float(np.percentile(every, 25)), float(np.percentile(every, 75))]
    for group in groups:
        notes_ = sorted((r.midi, r.note_id) for r in group)
        while True:
            ps = [m for m, _ in notes_]
            twice = [i for i, p in enumerate(ps) if sum((q - p) % 12 == 0 for q in ps) > 1]
            if len(ps) <= 2 or not twice or min(width(ps, k) for k in range(len(ps) + 1)) <= 14:
                break
            less = {i: ps[:i] + ps[i + 1 :] for i in twice}
            del notes_[min(twice, key=lambda i: min(width(less[i], k) for k in range(len(ps))))]
        score = []
        for k in range(len(ps) + 1):
            means = [np.mean(side) if side else None for side in (ps[:k], ps[k:])]
            cost = sum(abs(m - p) for m, p in zip(means, place) if m is not None)
            wide = width(ps, k) > 14
            score.append((wide, width(ps, k) if wide else cost, cost, k, means))
        wide, _, _, k, means = min(score, key=lambda x: x[:4])
        place = [p if m is None else 0.6 * p + 0.4 * m for m, p in zip(means, place)]
        for i, (_, n) in enumerate(notes_):
            want[n] = ("left" if i < k else "right", 0.3 if wide else 0.7 if 0 < k < len(ps) else 0.6, wide)
    assert got == want and len(got) < len(rows) and any(w for _, _, w in got.values())


def test_groups_of_a_dense_recording_take_linear_time(spark):
    def seconds(n):
        table = spark.range(n).select(F.lit(0).cast("bigint").alias("recording_id"), F.col("id").alias("note_id"), (F.col("id") * 9_000).alias("start_us"))
        began = time.monotonic()
        assert folds.anchored_groups(table, "start_us", 33_000, "note_id").agg(F.max("group_no")).first()[0] == n // 4
        return time.monotonic() - began

    seconds(1000)
    assert seconds(200_000) < 12 * seconds(20_000) + 5


def test_spaced(spark):
    row = spark.range(1).select(folds.spaced(F.array(*(F.lit(x).cast("bigint") for x in (0, 50, 100, 160, 205))), 100).alias("x")).first()
    assert row.x == [0, 100, 205]


def test_corrections(spark):
    rows = notes(spark, [(60, 0, 1), (61, 1, 2), (62, 2, 3)])
    edits = spark.createDataFrame([(0, 2, 65, None)], "recording_id long, note_id long, midi int, hand string")
    gone = spark.createDataFrame([(0, 3)], "recording_id long, note_id long")
    assert times(refine.correct(rows, edits, gone), "midi", "hand", "manually_corrected") == [(1, 60, "unknown", False), (2, 65, "unknown", True)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_whole_analysis_does_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = views.notes(spark, SF).filter("recording_id < 4")
        found = analyse(rows, views.attacks(rows), views.truth(rows))
        got = sorted(map(tuple, found.notes.select("recording_id", "note_id", "start_us", "end_us", "hand", F.array_join("issues", ";")).collect()))
        assert len(got) > 100 and found.report.count() == 4 and found.accuracy.count() == 4
        _seen.append(got)
        assert got == _seen[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


_seen: list = []


def test_random_groups_equal_a_loop(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(2_000_000), i) for i in range(200))
    table = spark.createDataFrame([(0, i, t) for t, i in rows], "recording_id long, note_id long, start_us long")
    want, anchor, no = {}, None, 0
    for t, i in rows:
        if anchor is None or t - anchor > 33_000:
            anchor, no = t, no + 1
        want[i] = no
    assert {r.note_id: r.group_no for r in folds.anchored_groups(table, "start_us", 33_000, "note_id").collect()} == want


def test_folds_are_split_at_gaps(spark):
    rows = [(0, i, i * 10_000 + i // 5 * 100_000) for i in range(400)] + [(1, i, i * 30_000) for i in range(50)] + [(2, i, None) for i in range(3)] + [(2, 9, 5)]
    table = spark.createDataFrame(rows, "recording_id long, note_id long, start_us long")
    sizes = folds.chains(table, "start_us", 25_000, ties=("note_id",)).groupBy("recording_id", "__chain").count()
    assert {(r.recording_id, r["max(count)"]) for r in sizes.groupBy("recording_id").agg(F.max("count")).collect()} == {(0, 5), (1, 1), (2, 4)}
    want, anchor, no, last = {}, None, 0, None
    for rec, i, t in sorted(rows, key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[1])):
        if rec != last:
            anchor, no, last = None, 0, rec
        if anchor is None or t - anchor > 25_000:
            anchor, no = t, no + 1
        want[rec, i] = no
    assert {(r.recording_id, r.note_id): r.group_no for r in folds.anchored_groups(table, "start_us", 25_000, "note_id").collect()} == want


def test_folds_of_200_000_notes_of_one_key_take_linear_time(spark):
    """One island of notes that touch but never join, one long chain that joins, all durations near each other."""
    n = 200_000
    rows = spark.range(n).selectExpr("0L AS recording_id", "id AS note_id", "60 AS midi", "id * 100000 AS start_us", "id * 100000 + 100000 + (id * 7919) % 30000 AS end_us", "0.5D AS detection_confidence", "true AS is_restrike").cache()
    rows.count()
    for restrike, parts in ((True, n), (False, 1)):
        began = time.time()
        got = refine.merge_fragments(rows.withColumn("is_restrike", F.lit(restrike))).agg(F.count("*").alias("n"), F.sum("parts").alias("parts")).first()
        assert (got.n, got.parts) == (parts, n) and time.time() - began < 10
    began = time.time()
    centers = refine.duration_clusters(rows).first().centers
    assert time.time() - began < 10
    lengths, want = sorted(100_000 + (i * 7919) % 30_000 for i in range(n)), []
    while lengths:
        k = sum(x <= lengths[0] * 1.1 for x in lengths)
        want.append((lengths[(k - 1) // 2] + lengths[k // 2]) // 2)
        lengths = lengths[k:]
    assert centers == want
    began = time.time()
    assert lanes.dedupe(rows.select("recording_id", "midi", F.col("start_us").alias("t_us"))).count() == n // 2 and time.time() - began < 10
    began = time.time()
    attacks = rows.select("recording_id", (F.col("start_us") + 10).alias("attack_us"))
    assert matching.nearest(rows, attacks, "start_us", "attack_us").filter("nearest_us <> start_us + 10").count() == 0 and time.time() - began < 10


@pytest.mark.parametrize("size", [2, 128])
def test_emitted_equals_a_loop(spark, size):
    rng = random.Random(size)
    rows = [(k, [rng.randrange(9) for _ in range(rng.randrange(20))]) for k in range(60)] + [(99, None)]
    table = spark.createDataFrame(rows, "k int, xs array<int>")

    def step(total, x):
        new = total + x
        return F.when(new > 12, 0).otherwise(new), F.when(new > 12, new)

    got = {r.k: r.out for r in table.select("k", folds.emitted(F.col("xs"), F.lit(0), step, "int", lambda t: F.when(t > 0, t), size).alias("out")).collect()}
    for k, xs in rows:
        out, total = [], 0
        for x in xs or []:
            total += x
            if total > 12:
                out.append(total)
                total = 0
        assert got[k] == out + [total] * (total > 0)


def test_times_are_the_inverse_of_the_grid(spark):
    """Against interpolation, over many buckets, buckets without a point, and beyond both ends."""
    rng = np.random.default_rng(5)
    grids, asked = [], []
    for r, step in ((0, 0.08), (1, 40.0), (2, 1000.0)):
        phi, ts = np.cumsum(rng.random(300) * step) - 3, np.arange(300) * 0.01
        grids += [(r, float(t), float(p)) for t, p in zip(ts, phi)]
        asked += [(r, k, float(p)) for k, p in enumerate([*rng.uniform(phi[0] - 5, phi[-1] + 200, 200), phi[0], phi[7], phi[-1]])]
    asked.append((7, 0, 1.0))
    grid = spark.createDataFrame(grids, "recording_id bigint, ts double, phi double")
    rows = spark.createDataFrame(asked, "recording_id bigint, k int, p double")
    got = {(r.recording_id, r.k): r.ts for r in drift.times_at(rows, grid, F.col("p")).collect()}
    assert len(got) == len(asked) and got[7, 0] is None
    for r in (0, 1, 2):
        ts, phi = zip(*((t, p) for q, t, p in grids if q == r))
        for q, k, p in asked:
            if q == r:
                assert got[r, k] == pytest.approx(np.interp(p, phi, ts), abs=1e-9)


def test_the_analysis_quantizes_a_slowing_performance_on_its_grid(spark):
    """Beats of a performance that slows down are where they were played; short recordings take the linear grid."""
    t, times_ = 0.5, []
    for i in range(160):
        times_.append(round(t, 6))
        t += 0.5 * (1 + 0.0009 * i) / 2
    rows = notes(spark, [(60 + i % 5, a, a + 0.1) for i, a in enumerate(times_)])
    found = tempo.estimate(rows).checkpoint()
    grid = drift.beat_map(rows, found).checkpoint()
    got = drift.quantize(rows, grid, found).join(rows.select("note_id", "start_us"), "note_id").orderBy("start_us").collect()
    axis = grid.orderBy("ts").toPandas()
    for r in got:
        assert r.quantized_s == pytest.approx(np.interp(4 * r.beat, axis.phi, axis.ts), abs=1e-9)
    linear = tempo.quantize(rows, F.lit(found.first().period), F.lit(found.first().phase)).collect()
    late = lambda quantized: np.mean([abs(r.error_ms) for r in quantized])
    assert late(got) < 0.5 * late(linear) and np.mean([r.ambiguous for r in got]) < 0.1
    short = rows.filter("note_id < 10")
    plain = {r.note_id: r for r in drift.quantize(short, grid.filter("recording_id < 0"), found).collect()}
    assert {r.note_id: r for r in tempo.quantize(short, F.lit(found.first().period), F.lit(found.first().phase)).collect()} == plain


def test_a_grid_is_not_broadcast(spark, tmp_path):
    """A grid of 320,000 steps from 40 short rows of a file: Spark takes it for small, but no broadcast may hold more than a row a recording."""
    path = str(tmp_path / "notes")
    spark.range(40).selectExpr("id as note_id", "id as recording_id", "60 as midi", "id * 1000 as start_us", "id * 1000 + 80000000 as end_us").write.parquet(path)
    rows = spark.read.parquet(path)
    grid = catalogue._tracked(rows).checkpoint()
    assert grid.count() == 40 * 8201
    beats = rows.select("recording_id", F.lit(0.5).alias("period"), F.lit(0.0).alias("phase"))
    got = drift.quantize(rows, grid, beats)
    assert got.count() == 40
    largest = []

    def look(plan):
        if plan.nodeName() == "BroadcastExchange":
            largest.append(plan.metrics().apply("numOutputRows").value())
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        for child in [*inner, *(children.apply(i) for i in range(children.size()))]:
            look(child)

    got.collect()
    look(got._jdf.queryExecution().executedPlan())
    assert max(largest, default=0) <= 40


def test_ties_on_the_tracked_grid_fall_as_in_its_sql(spark, tmp_path):
    """Notes whose begin or end is halfway between two note values, where the last bit decides; then rows without a time or a recording."""
    ties = {0: (1818317, 3349567, 3499567), 1: (3599567, 3849567, 4880817), 2: (1443317, 1693317, 1749567), 3: (2099567, 2849567, 3099567), 4: (1249567, 1399567, 1449567)}
    begin, rows = 1704067200000000, []
    for r, times_ in ties.items():
        # a note is 20 ms long at least, so ties at ends are put 200 ms behind a begin
        for us in (1234567, *times_, *(t - 200000 for t in times_ if t > 1434567)):
            rows.append((len(rows), begin + us * 86400, r, "view", 20.0, '{"k": 5}'))
    rows += [(len(rows), None, 0, "view", 20.0, '{"k": 5}'), (len(rows) + 1, None, 9, "view", 20.0, '{"k": 5}'), (len(rows) + 2, begin, None, "view", 20.0, '{"k": 5}')]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"user_id": "Int64"})
    events["ts"] = pd.to_datetime(events.ts.astype("Int64"), unit="us").astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = sorted(db.execute(f"SELECT note_id, beat, end_beat, quantized_s, ambiguous FROM ({catalogue.ORACLE['tracked_quantize']})").fetchall())
    got = catalogue.tracked_quantize(spark, str(tmp_path)).select("note_id", "beat", "end_beat", "quantized_s", "ambiguous").collect()
    assert sorted(map(tuple, got)) == want and len(want) == len(rows) - 1


def test_a_grid_by_stretches_gives_what_its_steps_give(spark):
    """A recording of many stretches with notes on and between steps, one of less than a stretch, notes before the grid and behind it, and one without a grid."""
    rng = random.Random(8)
    rows = [(1, 0, 40_000_000), (2, 1_000, 21_000), (3, 0, 500_000)] + [(1, us, us + rng.randrange(20_000, 2_000_000)) for us in (*(rng.randrange(38_000_000) for _ in range(300)), *range(0, 3_000_000, 10_000))]
    whole = spark.createDataFrame([(r, i, 60, a, b) for i, (r, a, b) in enumerate(rows)], "recording_id bigint, note_id bigint, midi int, start_us bigint, end_us bigint")
    hops = catalogue._hops(whole.filter("recording_id < 3"))
    outside = spark.createDataFrame([(1, 1000, 60, -5_000_000, -4_000_000), (1, 1001, 60, 60_000_000, 61_000_000)], whole.schema)
    asked = whole.unionByName(outside)
    beats = asked.select("recording_id").distinct().select("recording_id", F.lit(0.5).alias("period"), F.lit(0.0).alias("phase"))
    got = {r.note_id: r for r in drift.quantize(asked, hops, beats).collect()}
    steps = hops.steps().checkpoint()
    assert len(got) == len(rows) + 2 and got == {r.note_id: r for r in drift.quantize(asked, steps, beats).collect()}
    ts, phi = zip(*((r.ts, r.phi) for r in steps.filter("recording_id = 1").orderBy("ts").collect()))
    for row in got.values():
        if row.recording_id == 1:
            assert row.quantized_s == pytest.approx(np.interp(row.beat * 4, phi, ts), abs=1e-9)
    assert got[2].beat == 0.0 and got[1000].quantized_s == pytest.approx(-1.0, abs=0.5) and got[1001].quantized_s == pytest.approx(41.0, abs=0.5)


def test_steps_that_no_note_asks_for_are_not_shuffled(spark, tmp_path):
    """40 recordings of two notes and 13,000 steps of a grid each: shuffles hold rows of notes, recordings and hops only."""
    rows = [(i, 1704067200000000 + us * 86400, i // 2, "view", 2.0, '{"k": 5}') for i, us in enumerate([0, 130_000_000] * 40)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events["ts"] = pd.to_datetime(events.ts, unit="us").astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    got = catalogue.tracked_quantize(spark, str(tmp_path))
    assert len(got.collect()) == 80
    most = []

    def look(plan):
        if "Exchange" in plan.nodeName() and plan.metrics().contains("shuffleRecordsWritten"):
            most.append(plan.metrics().apply("shuffleRecordsWritten").value())
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        for child in [*inner, *(children.apply(i) for i in range(children.size()))]:
            look(child)

    look(got._jdf.queryExecution().executedPlan())
    assert 0 < max(most) <= 40 * 90 * 3


def test_recordings_are_detected_again_where_attacks_say_so(spark):
    """1: too few notes and lit keys; 2: enough notes; 3: no light; 4: the second finds no more; 5: few attacks."""
    first = spark.createDataFrame([(r, i) for r, n in ((1, 3), (2, 30), (3, 3), (4, 15), (5, 1)) for i in range(n)], "recording_id bigint, t int")
    attacks = spark.createDataFrame([(r, i * 1000) for r, n in ((1, 40), (2, 40), (3, 40), (4, 40), (5, 19), (6, 25)) for i in range(n)], "recording_id bigint, attack_us bigint")
    lane = spark.createDataFrame([(r, 60, i, -1 if r == 3 else 0) for r in range(1, 7) for i in range(10)], "recording_id bigint, midi int, frame int, lit int")
    asked = spark.sparkContext.accumulator(0)

    def second(rows):
        asked.add(rows.select("recording_id").distinct().count())
        return rows.select("recording_id", F.col("frame").alias("t"))

    got = analysis.redetect(first, lane, attacks, second).groupBy("recording_id", "again").count().collect()
    assert {tuple(r) for r in got} == {(1, True, 10), (2, False, 30), (3, False, 3), (4, False, 15), (5, False, 1), (6, True, 10)}
    assert asked.value == 3  # 1, 4 and 6 only
