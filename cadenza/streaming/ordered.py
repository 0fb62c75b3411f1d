"""Lit-key runs from frames that come out of order: list state, event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.config import DEFAULT, Config
from cadenza.streaming.lanes import OUT

#: The state store that processors with lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Islands(StatefulProcessor):
    """A lane's frames wait in a list until the watermark has passed them, then go through the run in order.

    A timer stands at the first waiting frame, or, with none, `wait_ms` behind the last
    frame seen, where an open run ends and the lane's state goes.
    """

    def __init__(self, bridge: int, wait_ms: int, config: Config):
        self.bridge, self.wait_ms, self.config = bridge, wait_ms, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame int, ms bigint, fill double, lit int")
        self.run = handle.getValueState("run", "first int, last int, gap int, dark int, seen int, ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            new = list(zip(pdf["frame"].astype(int).tolist(), ms.tolist(), pdf["fill"].astype(float).tolist(), pdf["lit"].astype(int).tolist()))
            if new:
                self.waiting.appendList(new)
        yield self.advanced(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advanced(key, timerValues)

    def advanced(self, key, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentWatermarkInMs()
        frames = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [f for f in frames if f[1] <= now], [f for f in frames if f[1] > now]
        first, last, gap, dark, seen, at = self.run.get() if self.run.exists() else (-1, -1, 0, 0, -1, 0)
        found = []

        def close() -> None:
            if first >= 0 and last - first + 1 >= self.config.min_run:
                found.append((*key, first, last))

        for frame, ms, fill, lit in ready:
            if frame <= seen:
                continue  # repeated
            seen, at = frame, max(at, ms)
            if lit >= 0:
                first, last, gap, dark = (first if first >= 0 else seen), seen, 0, 0
            elif first >= 0:
                gap, dark = gap + 1, dark + 1 if fill < self.config.dark_fill else 0
                if dark >= self.config.dark_frames or gap > self.bridge:
                    close()
                    first, last, gap, dark = -1, -1, 0, 0
        if later:
            self.waiting.put(later)
        elif frames:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if later or seen < 0 or now < at + self.wait_ms:
            self.run.update((first, last, gap, dark, seen, at))
            self.handle.registerTimer(later[0][1] if later else max(at + self.wait_ms, now + 1))
        else:
            close()
            self.run.clear()
        return pd.DataFrame(found, columns=["recording_id", "midi", "first_frame", "last_frame"])

    def close(self) -> None:
        pass


def ordered_islands(frames: DataFrame, frame_us: int = 16_667, wait: str = "5 seconds", config: Config = DEFAULT) -> DataFrame:
    """The runs that operators.lanes.light_islands() finds, in any order of frames that the watermark of `wait` allows.

    frames: recording_id, midi, frame, ts (event time), fill, lit.  A lane's state is the
    frames of the last `wait` and six numbers.  The session's state store has to be
    RocksDB, see use_rocksdb().
    """
    processor = Islands(max(3, round(config.flicker_us / frame_us)), int(pd.Timedelta(wait).total_seconds() * 1000), config)
    timed = frames.withWatermark("ts", wait).groupBy("recording_id", "midi")
    return timed.transformWithStateInPandas(processor, OUT, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store; to be called before a query with ordered_islands() starts."""
    spark.conf.set(*STORE)
