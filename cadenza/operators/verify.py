"""Flags for suspicious notes, and a recording's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions.note import duration_us, flagged, overall_confidence

_EMPTY = "cast(array() as array<string>)"


def error_flags(notes: DataFrame, frame_us: int = 16_667, config: Config = DEFAULT) -> DataFrame:
    """notes with issues array<string>, and with lower confidences where a flag lowers them.

    Order within a key is (start_us, note_id), within a recording (start_us, midi, note_id).
    """
    same = Window.partitionBy("recording_id", "midi").orderBy("start_us", "note_id")
    line = Window.partitionBy("recording_id").orderBy("start_us", "midi", "note_id")
    have = F.col("issues") if "issues" in notes.columns else F.expr(_EMPTY)
    short = duration_us() < F.greatest(F.lit(config.min_duration_us), F.lit(frame_us * 0.75))
    again = F.coalesce(F.col("start_us") - F.lag("start_us").over(same) < config.duplicate_us, F.lit(False))
    over = F.coalesce(F.lag("end_us").over(same) > F.col("start_us") + config.overlap_us, F.lit(False))
    before, after = F.lag("midi").over(line), F.lead("midi").over(line)
    jump = F.coalesce((before == after) & (F.abs(F.col("midi") - before) == 12), F.lit(False))
    issues = have
    rows = notes.withColumns({"__short": short, "__again": again, "__over": over, "__jump": jump})
    for name in ("short", "again", "over", "jump"):
        label = {"short": "very_short", "again": "possible_duplicate", "over": "overlaps_same_pitch", "jump": "octave_jump_isolated"}[name]
        issues = flagged(issues, label, F.col(f"__{name}"))
    return rows.withColumns({
        "issues": issues,
        "duration_confidence": F.when(F.col("__short"), F.least("duration_confidence", F.lit(0.4))).otherwise(F.col("duration_confidence")),
        "detection_confidence": F.when(F.col("__again"), F.least("detection_confidence", F.lit(0.5))).otherwise(F.col("detection_confidence")),
    }).drop("__short", "__again", "__over", "__jump")


def report(notes: DataFrame, diffs: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row a recording: counts by confidence and issue, and the agreement with sampled frames if there are any."""
    overall = overall_confidence()
    counts = notes.groupBy("recording_id").agg(
        F.count("*").alias("notes_total"),
        F.count_if(overall >= config.high).alias("high_confidence"),
        F.count_if((overall >= config.medium) & (overall < config.high)).alias("medium_confidence"),
        F.count_if(overall < config.medium).alias("low_confidence"),
        F.count_if(F.size("issues") > 0).alias("needs_review"),
        F.count_if(F.array_contains("issues", "possible_duplicate")).alias("possible_duplicates"),
        F.count_if(F.col("timing_confidence") < config.medium).alias("timing_conflicts"),
        F.count_if(F.col("pitch_confidence") < config.pitch_conflict).alias("pitch_conflicts"),
    )
    if diffs is None:
        return counts
    seen = diffs.groupBy("recording_id").agg(F.count("*").alias("frames"), F.sum("matched").alias("matched"), F.sum(F.size("missing")).alias("missing"))
    rows = counts.join(seen, "recording_id", "left").na.fill(0, ["frames", "matched", "missing"])
    return rows.select(
        *counts.columns, "frames",
        F.floor(F.col("missing") / F.greatest("frames", F.lit(1)) * 2).cast("bigint").alias("possible_missing"),
        F.round(F.coalesce(F.try_divide("matched", F.col("matched") + F.col("missing")), F.lit(1.0)), 6).alias("agreement"),
    )
