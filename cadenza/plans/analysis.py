"""The whole refinement of detected notes, in the order that the passes build on each other."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.operators import bars, drift, hands, key, lanes, matching, notation, refine, tempo, theme, verify, vision
from cadenza.sources import frames


@dataclass
class Analysis:
    notes: DataFrame
    tempo: DataFrame
    key: DataFrame
    quantized: DataFrame
    report: DataFrame
    accuracy: DataFrame | None


def _kept(df: DataFrame) -> DataFrame:
    """df from the shared folder: most passes read their input twice, so a chain of them would plan and read the first 2 ** n times."""
    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="cadenza-") if sc.master.startswith("local") and "cluster" not in sc.master else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint()


def analyse(notes: DataFrame, attacks: DataFrame | None = None, truth: DataFrame | None = None, coloured: bool = False, config: Config = DEFAULT) -> Analysis:
    """Merge, hands, skew and snapping, alignment, trimming, tempo, flags and report.

    Hands come before snapping, trimming after all alignment, and tempo sees final
    onsets.  Everything is keyed by recording_id, so one shuffle by it serves the
    passes that follow.
    """
    merged = refine.merge_fragments(notes, config)
    rest = [c for c in notes.columns if c not in merged.columns]
    rows = merged.drop("parts").join(notes.select("recording_id", "note_id", *(c for c in rest if c not in ("recording_id", "note_id"))), ["recording_id", "note_id"])
    rows = _kept(hands.assign(rows, coloured, config))
    if attacks is not None:
        skew = refine.av_skew(rows, attacks, config).select("recording_id", "applied_us")
        moved = attacks.join(skew, "recording_id", "left").selectExpr("recording_id", "attack_us + coalesce(applied_us, 0) as attack_us")
        moved = _kept(moved)
        rows = _kept(refine.snap_onsets(rows, moved, config).drop("snapped"))
        rows = _kept(refine.drop_silent_short(rows, moved, config))
        attacks = moved
    rows = _kept(refine.align_chords(rows, attacks, config).drop("moved"))
    rows = _kept(refine.align_releases(rows, config).drop("moved"))
    rows = _kept(refine.consolidate_durations(rows, config).drop("moved"))
    rows = _kept(verify.error_flags(refine.trim_same_pitch(rows, config), config=config))
    beats = _kept(tempo.estimate(rows, config))
    grid = _kept(drift.beat_map(rows, beats, config))
    return Analysis(
        notes=refine.renumber(rows),
        tempo=beats,
        key=key.detect_key(rows),
        quantized=drift.quantize(rows, grid, beats, config),
        report=verify.report(rows, config=config),
        accuracy=matching.accuracy(rows, truth, config) if truth is not None else None,
    )


def redetect(first: DataFrame, source: DataFrame, attacks: DataFrame, second: Callable[[DataFrame], DataFrame], least: int = 20, share: float = 0.5) -> DataFrame:
    """The notes of each recording by the detector that fits it, with `again` (whether the second one's were taken).

    first: notes (recording_id, ...) of the first detector; second: makes notes of the
    same columns from rows of the source.  A recording is looked at again if it has `least`
    attacks or more, the first detector found less than `share` of them as notes, and its key lights
    tell enough; the second detector's notes stand if they are more.  The counts are joined and
    decide in the plan: the second detector gets the rows of those recordings only, and
    nothing goes through the driver.
    """
    found = first.groupBy("recording_id").agg(F.count("*").alias("__n"))
    marked = attacks.groupBy("recording_id").agg(F.count("*").alias("__attacks")).filter(F.col("__attacks") >= least)
    few = marked.join(found, "recording_id", "left").filter(F.coalesce("__n", F.lit(0)) < share * F.col("__attacks"))
    doubtful = _kept(few.join(vision.applicable(source).filter("applicable"), "recording_id", "left_semi").select("recording_id", F.coalesce("__n", F.lit(0)).alias("__n")))
    others = _kept(second(source.join(doubtful, "recording_id", "left_semi")))
    more = others.groupBy("recording_id").agg(F.count("*").alias("__m")).join(doubtful, "recording_id").filter("__m > __n").select("recording_id")
    stay = first.join(more, "recording_id", "left_anti").withColumn("again", F.lit(False))
    return stay.unionByName(others.join(more, "recording_id", "left_semi").withColumn("again", F.lit(True)))


def ground_truth(spark: SparkSession, truth: DataFrame, seconds: float, rates: tuple[int, ...] = (60, 30), width: int = 640, height: int = 160, speed: float = 160.0) -> DataFrame:
    """fps, detector and the accuracy of each: known notes (one recording) drawn as frames, read by lit keys and by falling bars, and scored.

    Notes of both detectors stand in one table of recordings (twice the frame rate's
    place, and one more for bars), so one comparison scores all.
    """
    layout = notation.even_lanes(spark, float(width))
    found, names = None, []
    for i, fps in enumerate(rates):
        frame_us = round(1e6 / fps)
        pictures = _kept(frames.render(spark, truth, layout, seconds, fps, width, height, speed))  # read five times
        themes = _kept(theme.theme(_kept(theme.tones(vision.sampled(pictures)))))
        lit = lanes.lane_notes(vision.key_lights(pictures, layout, themes), frame_us=frame_us)
        falling = bars.bar_notes(bars.lane_runs(pictures, layout, themes=themes), height * (1 - frames.KEYS_SHARE), speed, frame_us=frame_us)
        for j, (name, rows) in enumerate((("key_lights", lit), ("bars", falling))):
            rows = rows.select(F.lit(2 * i + j).cast("bigint").alias("recording_id"), "midi", "start_us", "end_us")
            found = rows if found is None else found.unionByName(rows)
            names.append((2 * i + j, fps, name))
    order = Window.partitionBy("recording_id").orderBy("start_us", "midi", "end_us")
    found = _kept(found.withColumn("note_id", F.row_number().over(order).cast("bigint")))
    runs = spark.createDataFrame(names, "recording_id bigint, fps int, detector string")
    wanted = truth.drop("recording_id").crossJoin(F.broadcast(runs.select("recording_id")))  # the piece once a run, four in all
    return runs.join(matching.accuracy(found, wanted), "recording_id").drop("recording_id")
