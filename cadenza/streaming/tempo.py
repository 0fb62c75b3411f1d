"""Local tempi from a stream of onsets: sliding windows under a watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.operators.drift import HOP_S, LEAST_IN_WINDOW, SPAN, STEP_BPM, WINDOW_S
from cadenza.operators.tempo import best_tempo

OUT = "recording_id bigint, i bigint, period double, onsets bigint"


def sliding_periods(onsets: DataFrame, tempo: DataFrame, wait: str = "5 seconds", config: Config = DEFAULT) -> DataFrame:
    """recording_id, i, period, onsets: what drift.local_periods() finds for window i, as soon as the watermark is behind it.

    onsets: recording_id, ts (event time), t_us (in the recording); tempo: recording_id,
    period, t0_us (the first onset), a static table.  Windows stand on a raster of
    their hop, so an event time moves by what its recording's first onset is off that
    raster, which is less than a hop.  A window's state is the list of its onsets,
    what is played in six seconds: as lists of one window they merge across batches and
    late rows join theirs, and a list is far smaller than the counts of all tempi and
    phases that it decides.  An onset exactly at a window's end is not in it.
    """
    hop_us = round(HOP_S * 1e6)
    raster = f"{hop_us} microseconds"
    first = F.col("t0_us") - round(WINDOW_S / 2 * 1e6)
    rows = onsets.join(tempo.select("recording_id", "period", "t0_us"), "recording_id")
    # event time, moved so that windows begin at whole hops
    moved = F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts") - (F.col("t_us") - first), F.lit(hop_us)))
    rows = rows.select("recording_id", "period", "t_us", "t0_us", moved.alias("moved")).withWatermark("moved", wait)
    window = F.window("moved", f"{round(WINDOW_S * 1e6)} microseconds", raster)
    # the number of a window is how many hops its begin is behind that of the first one
    lists = rows.groupBy("recording_id", "period", window.alias("w")).agg(F.array_sort(F.collect_list(F.col("t_us") / 1e6)).alias("ts"), F.first(F.unix_micros("moved") - F.col("t_us") + first).alias("origin"), F.count("*").alias("onsets"))
    i = F.rint((F.unix_micros("w.start") - F.col("origin")) / hop_us).cast("bigint")
    found = lists.select("recording_id", i.alias("i"), "period", "ts", "onsets").filter((F.col("i") >= 0) & (F.col("onsets") >= LEAST_IN_WINDOW))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bpm = 60 / r.period
                last = min(math.floor(2 * SPAN / STEP_BPM * 1000), math.floor(2 * SPAN * bpm / STEP_BPM + 1e-6))
                out.append((r.recording_id, r.i, 60.0 / best_tempo(np.asarray(r.ts, float), bpm * (1 - SPAN) + np.arange(last + 1) * STEP_BPM, config)[0], r.onsets))
            yield pd.DataFrame(out, columns=["recording_id", "i", "period", "onsets"])

    return found.mapInPandas(run, OUT)
