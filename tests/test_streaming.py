import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import drift, lanes, tempo, verify
from cadenza.sources import views
from cadenza.streaming import capture, ordered
from cadenza.streaming import lanes as stream
from cadenza.streaming import tempo as stream_tempo

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(ordered.STORE[0])
    ordered.use_rocksdb(spark)
    yield
    spark.conf.set(ordered.STORE[0], before)


def fed(spark, tmp_path, batches, build, stops=()):
    """Rows of a stream over a folder that gets one batch after another; the query stops and starts again behind the batches in `stops`."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)

    def started():
        source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 100).parquet(folder)
        return build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()

    query = started()
    try:
        for k, batch in enumerate(batches):
            batch.coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
            if k in stops:
                query.stop()
                query = started()
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out)


def timed(lane):
    return lane.withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("t_us"))).select("recording_id", "midi", "frame", "ts", "fill", "lit")


def test_shuffled_frames_give_the_runs_of_the_batch(spark, tmp_path, rocksdb):
    """Frames in any order, some twice, with a stop in the middle."""
    lane = views.lane_signal(spark, SF).filter("recording_id = 0 and midi < 29")
    want = {tuple(r) for r in lanes.light_islands(lane).collect()}
    rows = timed(lane)
    part = F.pmod(F.xxhash64("midi", "frame"), F.lit(3))
    batches = [rows.filter(part == k).orderBy(F.rand(k)) for k in range(3)]
    batches[1] = batches[1].union(batches[0].limit(20))
    late = rows.limit(1).withColumn("midi", F.lit(127)).withColumn("lit", F.lit(-1))
    after = [late.withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000 + s * 1_000_000))) for s in (60, 120, 180)]
    got = [tuple(r) for r in fed(spark, tmp_path, batches + after, ordered.ordered_islands, stops=(1,)).collect()]
    assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want


def test_sliding_windows_equal_the_batch(spark, tmp_path):
    """Late onsets join their windows; windows come once the watermark is behind them."""
    rng = random.Random(3)
    rows, base = [], 1_704_067_200_000_000
    for recording, first, beat in ((0, 250_001, 0.5), (1, 3_777_777, 0.41)):
        t = first
        for i in range(100):
            rows.append((recording, i, t))
            t += round(1e6 * beat / 2 * (1 + 0.0008 * i)) + rng.randint(-3000, 3000)
    notes = spark.createDataFrame([(r, n, 60, t, t + 1000) for r, n, t in rows], "recording_id bigint, note_id bigint, midi int, start_us bigint, end_us bigint")
    found = tempo.estimate(notes).cache()
    windows = drift.windows(notes)
    want = {(r.recording_id, r.i): r.period for r in drift.local_periods(windows, found).collect()}
    first = notes.groupBy("recording_id").agg(F.min("start_us").alias("t0_us"))
    static = found.select("recording_id", "period").join(first, "recording_id").cache()
    onsets = notes.select("recording_id", F.timestamp_micros(F.lit(base) + F.col("start_us")).alias("ts"), F.col("start_us").alias("t_us"))
    quarter = F.floor(F.col("t_us") / 7_000_000)
    held = F.pmod(F.xxhash64("t_us"), F.lit(4)) == 0  # these come a batch late, but within the wait
    batches = [onsets.filter(((quarter == k) & ~held) | ((quarter == k - 1) & held)) for k in range(6)]
    end = spark.createDataFrame([(0, 90_000_000), (0, 120_000_000)], "recording_id bigint, t_us bigint").select("recording_id", F.timestamp_micros(F.lit(base) + F.col("t_us")).alias("ts"), "t_us")
    batches += [end.filter("t_us < 100000000"), end.filter("t_us > 100000000")]
    got = fed(spark, tmp_path, batches, lambda s: stream_tempo.sliding_periods(s, static, "20 seconds")).collect()
    assert len(got) == len({(r.recording_id, r.i) for r in got})
    mine = {(r.recording_id, r.i): r.period for r in got}
    assert len(want) > 20 and set(want) <= set(mine)
    assert all(mine[k] == pytest.approx(p, abs=1e-12) for k, p in want.items())
    assert all(i > max(w for r, w in want if r == recording) for recording, i in set(mine) - set(want))  # the last windows, centred behind the last onset


def arrays(folder, names, rng):
    for name in names:
        np.save(os.path.join(folder, "part.tmp.npy"), rng.integers(0, 255, (5, 4, 6, 3), dtype=np.uint8))
        os.rename(os.path.join(folder, "part.tmp.npy"), os.path.join(folder, name))


def test_captured_frames_as_a_stream_and_progress(spark, tmp_path):
    """The stream gives the rows of the batch, stopped in the middle and started again; the listener has a row a batch."""
    folder, out, rng = str(tmp_path / "in"), str(tmp_path / "out"), np.random.default_rng(1)
    os.makedirs(folder)
    heard = capture.Progress()
    spark.streams.addListener(heard)
    try:
        def run():
            frames = capture.captured(spark, folder, stream=True, frames=2)
            query = frames.writeStream.queryName("capture").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
            query.processAllAvailable()
            return query

        arrays(folder, ["1_7_0_60.npy", "2_7_5_60.npy"], rng)
        query = run()
        arrays(folder, ["9_8_0_30.npy"], rng)
        query.processAllAvailable()
        query.stop()
        arrays(folder, ["10_7_10_60.npy", "not a frame.txt"], rng)
        run().stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(heard)
    batch = capture.captured(spark, folder, frames=3)
    assert batch.count() == 20 and batch.rdd.getNumPartitions() == 8
    assert batch.schema == spark.createDataFrame([], capture.SCHEMA).schema
    key = lambda r: (r.recording_id, r.frame, r.t_us, r.width, r.height, bytes(r.pixels))
    assert sorted(map(key, spark.read.parquet(out).collect())) == sorted(map(key, batch.collect()))
    reports = [r for r in heard.table(spark).filter("query = 'capture' and rows > 0").collect()]
    assert [r.rows for r in reports] == [10, 5, 5] and all(r.rows_a_second >= 0 and r.ms >= 0 for r in reports) and len(heard.ended) == 2


def test_sessions_and_tumbling_counts(spark, tmp_path):
    lane = views.lane_signal(spark, SF).filter("recording_id = 0 and midi < 25")
    want = {(r.recording_id, r.midi, r.first_frame, r.last_frame, r.frames) for r in lanes.gap_islands(lane).collect()}
    end = timed(lane).limit(1).withColumn("midi", F.lit(127)).withColumn("lit", F.lit(0)).withColumn("ts", F.timestamp_micros(F.lit(1_704_067_300_000_000)))
    got = fed(spark, tmp_path, [timed(lane).filter("frame < 30"), timed(lane).filter("frame >= 30"), end, end.withColumn("ts", F.col("ts") + F.expr("interval 1 minute"))], stream.gap_islands).filter("midi < 127").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_counts_of_a_stream_of_notes(spark, tmp_path):
    notes = verify.error_flags(views.notes(spark, SF)).withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("start_us"))).drop("issues")
    want = {(r.recording_id, r.window.start): (r.notes, r.low) for r in stream.report_counts(notes).collect()}
    end = notes.limit(1).withColumn("recording_id", F.lit(-1).cast("bigint")).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    got = fed(spark, tmp_path, [notes, end, end.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))], stream.report_counts).filter("recording_id >= 0").collect()
    assert len(want) > 5 and {(r.recording_id, r.window.start): (r.notes, r.low) for r in got} == want
