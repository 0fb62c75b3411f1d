import io
import json
import struct
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from cadenza import catalogue, config
from cadenza.operators import bars, lanes, matching, notation, tempo, vision
from cadenza.sources import frames, pieces, sinks, views
from cadenza.streaming import lanes as stream
from tests.test_refine import SF, notes

LANE = "recording_id long, midi int, frame int, t_us long, fill double, trip double, lit int"


def lane(spark, fills, trips=None, threshold=0.4):
    return spark.createDataFrame([(0, 60, i, i * 16_667, float(f), float(trips[i]) if trips else 0.0, 0 if f >= threshold else -1) for i, f in enumerate(fills)], LANE)


def test_envelope_splits(spark):
    hits = lane(spark, [0.2, 0.5, 0.9, 0.9, 0.9, 0.5, 0.2] * 4, threshold=0.1)
    runs = spark.createDataFrame([(0, 60, 0, 27)], "recording_id long, midi int, first_frame int, last_frame int")
    assert lanes.trough_splits(runs, hits).count() == 3
    held = lane(spark, [0.9] * 40)
    assert lanes.trough_splits(lanes.light_islands(held), held).count() == 0


def test_islands_bridge_flicker_and_end_in_the_dark(spark):
    fills = [0.0, 0.9, 0.9, 0.3, 0.3, 0.9, 0.0, 0.0, 0.9, 0.9, 0.1, 0.3, 0.1, 0.3, 0.3, 0.9, 0.0]
    got = [(r.first_frame, r.last_frame) for r in lanes.light_islands(lane(spark, fills)).orderBy("first_frame").collect()]
    assert got == [(1, 5), (8, 9)]


def test_subframe_times(spark):
    rows = lane(spark, [0.2, 0.6, 0.9, 0.8, 0.0])
    r = lanes.subframe_edges(lanes.light_islands(rows), rows).first()
    assert (r.on_us, r.off_us) == (round(0.5 * 16_667), round(16_667 * 3.5))


def test_stream_equals_batch(spark, tmp_path):
    signal = views.lane_signal(spark, SF).filter("midi < 40")
    timed = signal.withColumn("ts", F.timestamp_micros(F.col("t_us") + 86_400_000_000))  # the watermark starts at 0
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = [timed.filter("frame < 32"), timed.filter("frame >= 32")]
    # a late frame of another lane moves the watermark, so that open runs end
    parts.append(timed.limit(1).withColumn("ts", F.expr("timestamp'2100-01-01'")).withColumn("midi", F.lit(1)).withColumn("lit", F.lit(-1)))
    for rows in parts:  # one trigger each, in order; state lives in the checkpoint between them
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.light_islands(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in lanes.light_islands(signal).select("recording_id", "midi", "first_frame", "last_frame").collect()}
    closed = {r for r in want if r[3] < 58}
    assert closed <= got <= want


def test_rendered_piece_is_read_back(spark):
    layout = notation.even_lanes(spark, 1040.0)
    truth = pieces.as_table(spark, [(60, 0.5, 0.9, "left", 80), (64, 0.5, 0.9, "left", 80), (72, 0.6, 1.0, "right", 90), (72, 1.2, 1.5, "right", 90), (61, 1.3, 1.6, "right", 90)])
    pictures = frames.render(spark, truth, layout, 2.0, 60, 1040, 100)
    clusters = vision.hue_peaks(vision.hue_histogram(pictures)).collect()
    assert len(clusters) == 2
    colours = spark.createDataFrame([tuple(c) for c in clusters], "recording_id long, cluster int, hue int, share double")
    found = lanes.lane_notes(vision.key_lights(pictures, layout, colours))
    found = found.withColumn("note_id", F.monotonically_increasing_id())
    row = matching.accuracy(found, truth).first()
    assert (row.recall, row.precision) == (1.0, 1.0) and row.mean_onset_error_ms < 20 and row.mean_duration_error_ms < 25
    assert vision.sampled(pictures, 40).count() == 40


def test_ground_truth_of_the_demo_piece(spark):
    rows = {(r.fps, r.detector): r for r in catalogue.QUERIES["ground_truth"](spark, SF).collect()}
    assert set(rows) == {(f, d) for f in (60, 30) for d in ("key_lights", "bars")}
    for (fps, _), r in rows.items():
        assert r.recall == 1.0 and r.precision >= 0.97 and r.f1 >= 0.98
        assert r.mean_onset_error_ms < (20 if fps == 60 else 35)
        assert r.mean_duration_error_ms < (25 if fps == 60 else 35)


def test_restrikes_of_bars_stay_distinct(spark):
    layout = notation.even_lanes(spark, 640.0)
    truth = pieces.as_table(spark, [(64, 0.6 + i * 0.3, 0.6 + i * 0.3 + (0.28 if i % 2 else 0.2), "right", 95) for i in range(5)])
    runs = bars.lane_runs(frames.render(spark, truth, layout, 2.4, 60, 640, 160, 160.0), layout)
    found = bars.bar_notes(runs, 120.0, 160.0)
    assert found.filter("midi = 64").count() == 5
    held = lanes.attach_lanes(found, layout).collect()
    assert all(r.lane_x is not None and r.timing_confidence >= 0.4 and r.pitch_confidence == 1.0 for r in held)
    assert [r.lane_x for r in lanes.attach_lanes(found.limit(1).withColumn("midi", F.lit(5)), layout).collect()] == [None]


def test_temporal_median_and_footage(spark):
    rng = np.random.default_rng(0)
    stack = rng.integers(0, 255, (7, 40, 24, 3), dtype=np.uint8)
    rows = [(0, i, i, 24, 40, bytearray(x.tobytes())) for i, x in enumerate(stack)]
    dark = np.full((40, 24, 3), 12, np.uint8)
    rows += [(1, i, i, 24, 40, bytearray(dark.tobytes())) for i in range(4)]
    median = vision.temporal_median(spark.createDataFrame(rows, frames.SCHEMA))
    got = {r.recording_id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(40, 24, 3) for r in median.collect()}
    assert (got[0] == np.median(stack, axis=0).astype(np.uint8)).all() and (got[1] == dark).all()
    assert {r.recording_id: r.composited for r in vision.composited(median).collect()} == {0: True, 1: False}


def test_geometry_of_a_rendered_keyboard(spark):
    layout = notation.even_lanes(spark, 1040.0)
    truth = pieces.as_table(spark, [(60 + i, 0.1 + 0.1 * i, 0.15 + 0.1 * i, "right", 90) for i in range(13)])
    pictures = vision.sampled(frames.render(spark, truth, layout, 1.6, 20, 1040, 200), 20)
    blank = spark.createDataFrame([(1, 0, 0, 104, 20, bytearray(104 * 20 * 3))], frames.SCHEMA)
    found = vision.geometry(vision.temporal_median(pictures.unionByName(blank)))
    want = {r.midi: r for r in layout.collect()}
    got = {r.midi: r for r in found.filter("recording_id = 0").collect()}
    assert set(got) == set(range(21, 109)) and all(r.confidence > 0.9 for r in got.values())
    assert all(abs(r.center - want[m].center) < 3 and r.is_black == want[m].is_black for m, r in got.items())
    even = found.filter("recording_id = 1").collect()
    assert len(even) == 88 and {r.confidence for r in even} == {0.35}


def test_manual_layout(spark):
    rows = {r.midi: r for r in notation.manual_lanes(spark, 100.0, 240.0, 60, 71).collect()}
    assert len(rows) == 12 and (rows[60].center, rows[61].center, rows[62].center) == (110.0, 120.0, 130.0)
    assert (rows[60].half_width, round(rows[61].half_width, 6), rows[60].confidence) == (10.0, 11.6, 1.0)


def test_separators_are_made_regular():
    marked = np.array([0.0, 60, 90, 120, 150, 180, 210, 241, 300, 330, 420, 480])
    assert vision.regular(marked, 60.0).tolist() == [0, 60, 120, 180, 241, 300, 360, 420, 480]
    clean = np.arange(0, 600, 60.0)
    assert (vision.regular(clean, 60.0) == clean).all()


def test_presets():
    assert (config.preset("fast").scaled(1920), config.preset("maximum").scaled(1920), config.preset("other").scaled(640)) == ((854, 854 / 1920), (1920, 1.0), (640, 1.0))
    assert [config.preset(n).stride for n in ("fast", "balanced", "maximum")] == [8, 4, 2]


def test_beat_lines(spark):
    view = spark.createDataFrame([(0, 900_000, 2_600_000), (1, 5, 5)], "recording_id long, from_us long, to_us long")
    beats = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.5, 0.0)], "recording_id long, period double, phase double")
    assert [(r.beat, r.t_us, r.measure) for r in notation.beat_lines(view, beats).orderBy("beat").collect()] == [(2, 1_100_000, False), (3, 1_600_000, False), (4, 2_100_000, True)]


def test_pedals_come_behind_notes(spark):
    rows = notes(spark, [(60, 0, 1.0)], hand=["left"])
    pedals = spark.createDataFrame([(0, 0, True), (0, 1_000_000, False)], "recording_id long, t_us long, down boolean")
    events = [(r.tick, r.kind, r.channel, r.midi, r.velocity) for r in notation.midi_events(rows, F.lit(120.0), pedals=pedals).orderBy("seq").collect()]
    assert events == [(0, "on", 0, 60, 80), (0, "pedal", 1, 64, 127), (1920, "off", 0, 60, 0), (1920, "pedal", 1, 64, 0)]
    data = bytes(sinks.midi_files(rows, F.lit(120.0), pedals=pedals).first().file)
    assert data.count(b"\xb1\x40\x7f") == 1 and data.count(b"\xff\x58\x04\x04\x02\x18\x08") == 1


def test_whole_document(spark):
    rows = notes(spark, [(60, 0, 1.0), (64, 0.5, 1.0)])
    beats = spark.createDataFrame([(0, 120.0, 0.5, 0.0)], "recording_id long, bpm double, period double, phase double")
    quantized = tempo.quantize(rows, F.lit(0.5), F.lit(0.0))
    document = json.loads(sinks.json_documents(rows, tempo=beats, quantized=quantized).first().document)
    assert [n["midi"] for n in document["notes"]] == [60, 64] and document["tempo"]["bpm"] == 120.0 and [q["beat"] for q in document["quantized"]] == [0.0, 1.0]


def test_printed_lengths_are_true(spark):
    """Every type and dot is worth its duration, and triplets are bracketed."""
    third = 0.5 / 3
    rows = [(60 + 3 * i, i * third, (i + 1) * third) for i in range(3)] + [(72 + i, 0.5 + 0.125 * i, 0.5 + 0.125 * i + 0.06) for i in range(4)] + [(60, 1.0, 1.7), (61, 1.01, 1.6), (48, 1.75, 2.0)]
    table = notes(spark, rows, hand=["right"] * len(rows))
    positions, thirds = notation.score_positions(table, F.lit(0.5), F.lit(0.0)), notation.triplet_beats(table, F.lit(0.5), F.lit(0.0))
    layout = notation.chord_layout(positions, thirds).orderBy("measure", "staff", "pos").collect()
    worth = {"whole": 4, "half": 2, "quarter": 1, "eighth": 0.5, "16th": 0.25, "32nd": 0.125}
    for r in layout:
        assert r.dur == r.divisions * worth[r.type] * (1.5 if r.dots else 1) * (2 / 3 if r.triplet else 1), r
    upper = [r for r in layout if r.staff == 1]
    assert [(r.triplet, r.begins, r.ends) for r in upper[:3]] == [(True, True, False), (True, False, False), (True, False, True)]
    assert [r.pitches for r in upper if r.pos >= 24 and r.pitches][:2] == [[60], [61]]  # a step's neighbour is no chord
    score = ET.fromstring(sinks.musicxml(table, F.lit(0.5), F.lit(0.0)).first().document.split("partwise.dtd\">", 1)[1])
    assert len(list(score.iter("time-modification"))) == 3 and len(list(score.iter("tuplet"))) == 2


def test_keyboard_band_and_separators():
    gray = np.full((300, 520), 20.0)
    gray[150:281] = 230
    for k in range(5, 520, 40):
        gray[150:235, k : k + 18] = 25
    top, bottom = vision.keyboard_band(gray)
    assert top <= 158 and abs(bottom - 280) <= 8
    keys = np.full((20, 660), 220.0)
    keys[:, 59:660:60] = 60
    for k in range(11):
        keys[5:15, 60 * k + 25 : 60 * k + 35] -= 8
    lines = vision.separators(keys)
    assert 9 <= len(lines) <= 11 and abs(np.median(np.diff(lines)) - 60) <= 3
    assert abs(vision.dominant_period(255 - keys.mean(axis=0)) - 60) <= 3


def test_octave_phase():
    white = np.array([i * 60 + 40 for i in range(14)], float)
    black = np.array([(o * 7 + p) * 60 + 40 for o in range(2) for p in (0.6, 1.6, 3.6, 4.6, 5.6)])
    assert vision.black_phase(white, black) == 0


def test_clicks_are_heard(spark):
    rate = 22_050
    sound = np.random.default_rng(0).normal(size=rate * 3) * 1e-3
    for t in (0.5, 1.0, 2.2):
        at = int(t * rate)
        sound[at : at + 3000] += np.sin(np.arange(3000) * 0.2) * np.exp(-np.arange(3000) / 800)
    parts = [(0, i, [float(x) for x in p]) for i, p in enumerate(np.array_split(sound, 5))]
    heard = [r.attack_us / 1e6 for r in vision.spectral_onsets(spark.createDataFrame(parts, "recording_id long, chunk int, pcm array<double>")).orderBy("attack_us").collect()]
    assert all(min(abs(h - t) for h in heard) < 0.1 for t in (0.5, 1.0, 2.2))


def test_every_measure_is_full(spark):
    rows = notes(spark, [(48, 0, 2), (60, 0, 0.5), (64, 0, 0.5), (67, 0.5, 0.9), (72, 0.75, 1.5), (50, 2, 4)], hand=["left", "right", "right", "right", "right", "left"])
    positions, thirds = notation.score_positions(rows, F.lit(0.5), F.lit(0.0)), notation.triplet_beats(rows, F.lit(0.5), F.lit(0.0))
    layout = notation.chord_layout(positions, thirds).groupBy("measure", "staff", "divisions").agg(F.sum("dur").alias("d")).collect()
    assert len(layout) == 4 and all(r.d == r.divisions * 4 for r in layout)
    score = ET.fromstring(sinks.musicxml(rows, F.lit(0.5), F.lit(0.0)).first().document.split("partwise.dtd\">", 1)[1])
    for measure in score.iter("measure"):
        for staff in ("1", "2"):
            total = sum(int(n.find("duration").text) for n in measure.iter("note") if n.find("staff").text == staff and n.find("chord") is None)
            assert total == 48


def test_midi_file_reads_back(spark):
    rows = notes(spark, [(60, 0, 1.0), (64, 0.5, 1.0), (200, 0, 1)], hand=["left", "right", "left"])
    data = io.BytesIO(bytes(sinks.midi_files(rows, F.lit(120.0)).first().file))
    assert data.read(4) == b"MThd" and struct.unpack(">IHHH", data.read(10)) == (6, 0, 1, 960)
    assert data.read(4) == b"MTrk"
    body = data.read(struct.unpack(">I", data.read(4))[0])
    assert body.endswith(b"\xff\x2f\x00") and body.count(b"\x90\x3c") == 1 and body.count(b"\x91\x40") == 1 and not data.read()


def test_csv_files(spark, tmp_path):
    sinks.write_csv(notes(spark, [(60, 0, 1.0), (61, 1, 2)]), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 2 and back.filter("name = 'C4'").first().start == "0.000000"


def test_falling_bars_are_read_back(spark):
    layout = notation.even_lanes(spark, 1040.0)
    truth = pieces.as_table(spark, [(60, 0.8, 1.1, "left", 80), (64, 0.8, 1.3, "left", 80), (72, 1.0, 1.4, "right", 90)])
    runs = bars.lane_runs(frames.render(spark, truth, layout, 1.8, 60, 1040, 400, 320.0), layout)
    found = bars.bar_notes(runs, 300.0, 320.0).withColumn("note_id", F.monotonically_increasing_id())
    row = matching.accuracy(found, truth).first()
    assert (row.recall, row.precision) == (1.0, 1.0) and row.mean_onset_error_ms < 20 and row.mean_duration_error_ms < 25


def test_notches(spark):
    edges = [300, 300, 300, 280, 270, 285, 300, 300, 299, 300]
    runs = spark.createDataFrame([(0, 60, i, i * 16_667, 100.0, float(e)) for i, e in enumerate(edges)], "recording_id long, midi int, frame int, t_us long, y_top double, y_bottom double")
    assert [r.frame for r in bars.restrike_notches(runs, 300.0, 40.0).collect()] == [6]
    still = runs.withColumn("y_bottom", F.lit(300.0))
    assert bars.restrike_notches(still, 300.0, 40.0).count() == 0


def test_measures_are_not_broadcast(spark):
    """Spark takes a score's measures for small whatever their notes; the join of the layout may not send them to every task."""
    table = views.notes(spark, SF)
    positions = notation.score_positions(table, F.lit(0.5), F.lit(0.0))
    rows = notation.chord_layout(positions, notation.triplet_beats(table, F.lit(0.5), F.lit(0.0)))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "measure" in line]
