"""A data source of captured frames: a folder of NumPy arrays, read whole or as a stream, and a listener that keeps progress.

A file `<sequence>_<recording>_<first frame>_<frames a second>.npy` holds consecutive
frames, [frames, height, width, 3] bytes.  A capture writes files under another name and
renames them, with growing sequence numbers.
"""

from __future__ import annotations

import os
import re
import threading
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "recording_id bigint, frame int, t_us bigint, width int, height int, pixels binary"
NAME = re.compile(r"^(\d+)_(\d+)_(\d+)_(\d+)\.npy$")


class Part(InputPartition):
    """Some frames of a file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def listed(folder: str, after: int, until: int | None = None) -> list[str]:
    """Files with sequence numbers behind `after` up to `until`, in order."""
    names = [(int(m[1]), n) for n in os.listdir(folder) if (m := NAME.match(n))]
    return [n for k, n in sorted(names) if k > after and (until is None or k <= until)]


class _Reading:
    def __init__(self, options: dict):
        self.folder, self.frames = options["path"], int(options.get("framespartition", 256))

    def parts(self, names: list[str]) -> list[Part]:
        """One partition for every `framesPartition` frames of a file; only the files' headers are read."""
        out = []
        for name in names:
            path = os.path.join(self.folder, name)
            n = len(np.load(path, mmap_mode="r"))
            out += [Part(path, a, min(n, a + self.frames)) for a in range(0, n, self.frames)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        _, recording, first, fps = map(int, NAME.match(os.path.basename(partition.path)).groups())
        stack = np.load(partition.path, mmap_mode="r")
        for i in range(partition.first, partition.last):
            frame = first + i
            yield recording, frame, round(frame * 1_000_000 / fps), stack.shape[2], stack.shape[1], stack[i].tobytes()


class FolderReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(listed(self.folder, -1))


class FolderStream(_Reading, DataSourceStreamReader):
    """Offsets are sequence numbers, so a batch that is run again reads the same files."""

    def initialOffset(self) -> dict:
        return {"sequence": -1}

    def latestOffset(self) -> dict:
        names = listed(self.folder, -1)
        return {"sequence": int(NAME.match(names[-1])[1]) if names else -1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(listed(self.folder, start["sequence"], end["sequence"]))

    def commit(self, end: dict) -> None:
        pass  # files stay: a capture is read more than once


class Capture(DataSource):
    """Format `capture`, with the options path (a folder that all executors see) and framesPartition."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)


def captured(spark: SparkSession, folder: str, stream: bool = False, frames: int = 256) -> DataFrame:
    """The frames of a capture's folder, those that are there or all that come."""
    spark.dataSource.register(Capture)
    reader = spark.readStream if stream else spark.read
    return reader.format("capture").option("framesPartition", frames).load(folder)


class Progress(StreamingQueryListener):
    """Keeps the last `most` progress reports of the session's streams, one row a micro-batch."""

    COLUMNS = "query string, batch bigint, ts string, rows bigint, rows_a_second double, ms bigint, watermark string, state_rows bigint"

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)
        self.ended: list[str] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0.0), p.batchDuration, (p.eventTime or {}).get("watermark"), sum(s.numRowsTotal for s in p.stateOperators))
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.append(str(event.id))

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, ts, rows, rows_a_second, ms, watermark, state_rows of the reports so far."""
        with self.lock:
            return spark.createDataFrame(list(self.rows), self.COLUMNS)
