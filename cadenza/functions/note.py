"""Columns of a note: duration, confidence, tone, labels and places on screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config

_PARTS = ("detection_confidence", "pitch_confidence", "timing_confidence", "duration_confidence")


def duration_us() -> Column:
    return F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))


def overall_confidence() -> Column:
    """The weakest of detection, pitch, timing and duration; the hand doesn't count."""
    return F.least(*(F.col(p) for p in _PARTS))


def tone(overall: Column, issues: Column, config: Config = DEFAULT) -> Column:
    """high, medium or low; a note with an issue is medium at best."""
    return F.when((overall >= config.high) & (F.size(issues) == 0), "high").when(overall >= config.medium, "medium").otherwise("low")


def flagged(issues: Column, name: str, when: Column) -> Column:
    """issues with one more, once, where the condition holds."""
    return F.when(when, F.array_union(issues, F.array(F.lit(name)))).otherwise(issues)


def clock(us: Column) -> Column:
    """m:ss.mmm"""
    ms = F.greatest(F.lit(0), F.floor(us / 1000)).cast("bigint")
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000).cast("bigint"), F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)


def bar(t_us: Column, strike: float, speed: float) -> Column:
    """struct(top, bottom) of a note's falling bar at a time, null where it is not in view; speed in pixels a second."""
    lead = F.lit(strike) - speed * (F.col("start_us") - t_us) / 1e6
    trail = F.lit(strike) - speed * (F.col("end_us") - t_us) / 1e6
    seen = (F.least(lead, F.lit(strike)) >= 0) & (trail <= strike)
    clip = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(strike), y))
    return F.when(seen, F.struct(clip(trail).alias("top"), clip(lead).alias("bottom")))


def hue_distance(a: Column, b: Column) -> Column:
    """Circular distance of hues on 0..179."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def onset_uncertainty_ms(speed: Column, fps: Column) -> Column:
    return 0.5 / speed * 1000 + 0.1 * 1000 / fps


def sounding(t_us: Column) -> Column:
    """Whether the note sounds at a time; its end is outside."""
    return (F.col("start_us") <= t_us) & (t_us < F.col("end_us"))


def triggered(before_us: Column, now_us: Column) -> Column:
    """Whether playback from one moment to the next starts the note."""
    return (F.col("start_us") > before_us) & (F.col("start_us") <= now_us)


def in_view(from_us: Column, to_us: Column) -> Column:
    """Whether the note overlaps a closed range of time."""
    return (F.col("start_us") <= to_us) & (F.col("end_us") >= from_us)
