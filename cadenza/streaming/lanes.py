"""Lit-key runs from a stream of lane frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.config import DEFAULT, Config

OUT = "recording_id bigint, midi int, first_frame int, last_frame int"
STATE = "first int, last int, gap int, dark int, seen int"


def light_islands(frames: DataFrame, frame_us: int = 16_667, wait: str = "5 seconds", config: Config = DEFAULT) -> DataFrame:
    """The runs that lanes.light_islands() finds, each as soon as it has ended.

    frames: recording_id, midi, frame, ts (event time), fill, lit.  State is five
    integers a lane, kept until `wait` of event time passes without a frame, when an
    open run ends.  Frames of a lane must come in order between triggers; within one
    they are sorted.
    """
    bridge = max(3, round(config.flicker_us / frame_us))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, gap, dark, seen = state.get if state.exists else (-1, -1, 0, 0, -1)
        found = []

        def close() -> None:
            if first >= 0 and last - first + 1 >= config.min_run:
                found.append((*key, first, last))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("frame")
            for frame, fill, lit in rows[["frame", "fill", "lit"]].itertuples(index=False):
                if frame <= seen:
                    continue  # repeated
                seen = int(frame)
                if lit >= 0:
                    first, last, gap, dark = (first if first >= 0 else seen), seen, 0, 0
                elif first >= 0:
                    gap, dark = gap + 1, dark + 1 if fill < config.dark_fill else 0
                    if dark >= config.dark_frames or gap > bridge:
                        close()
                        first, last, gap, dark = -1, -1, 0, 0
            state.update((first, last, gap, dark, seen))
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(pd.Timedelta(wait).total_seconds() * 1000))
        yield pd.DataFrame(found, columns=["recording_id", "midi", "first_frame", "last_frame"])

    timed = frames.withWatermark("ts", wait)
    return timed.groupBy("recording_id", "midi").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def gap_islands(frames: DataFrame, gap: str = "60 milliseconds", wait: str = "5 seconds") -> DataFrame:
    """recording_id, midi, first_frame, last_frame, frames: lit frames less than `gap` apart, by session windows; at 60 frames a second the default bridges as many frames as operators.lanes.gap_islands()."""
    lit = frames.filter("lit >= 0").withWatermark("ts", wait)
    rows = lit.groupBy("recording_id", "midi", F.session_window("ts", gap)).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"))
    return rows.select("recording_id", "midi", "first_frame", "last_frame", "frames")


def report_counts(notes: DataFrame, every: str = "10 seconds", wait: str = "5 seconds") -> DataFrame:
    """recording_id, window, notes, low: counts of a stream of notes with ts, confidences and issues in tumbling windows."""
    from cadenza.functions.note import overall_confidence

    rows = notes.withWatermark("ts", wait).withColumn("overall", overall_confidence())
    return rows.groupBy("recording_id", F.window("ts", every)).agg(F.count("*").alias("notes"), F.count_if(F.col("overall") < DEFAULT.medium).alias("low"))
