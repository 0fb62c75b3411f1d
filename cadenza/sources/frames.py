"""Frames of a piano roll drawn from notes, and the image arithmetic that reads them.

A frame is a row (recording_id, frame, t_us, width, height, pixels), pixels being
height x width x 3 bytes in RGB.  Tasks draw and read one frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "recording_id bigint, frame int, t_us bigint, width int, height int, pixels binary"
# the drawing's colours and proportions
LEFT, RIGHT, BACK = (40, 150, 225), (90, 200, 80), 12
WHITE_KEY, BLACK_KEY = 235, 22
KEYS_SHARE, BLACK_SHARE = 0.25, 0.62


def draw(notes: np.ndarray, lanes: pd.DataFrame, t_us: int, width: int, height: int, speed: float) -> np.ndarray:
    """One frame. notes: rows (midi, start_us, end_us, hand is left)."""
    image = np.full((height, width, 3), BACK, np.uint8)
    strike = int(height * (1 - KEYS_SHARE))
    black_end = strike + int((height - strike) * BLACK_SHARE)
    place = {int(r.midi): (max(0, round(r.center - r.half_width)), min(width, round(r.center + r.half_width)), bool(r.is_black)) for r in lanes.itertuples()}
    image[strike:] = WHITE_KEY
    for x0, _, is_black in place.values():
        if not is_black:
            image[strike:, x0 : x0 + 1] = 90
    sounding = {int(m): LEFT if left else RIGHT for m, a, b, left in notes if a <= t_us < b}
    for black in (False, True):
        for midi, (x0, x1, is_black) in place.items():
            if is_black == black and (is_black or midi in sounding):
                image[strike : black_end if is_black else height, x0 + (not is_black) : x1] = sounding.get(midi, (BLACK_KEY,) * 3)
    for midi, start, end, left in notes:
        x0, x1, _ = place[int(midi)]
        low = strike - speed * (start - t_us) / 1e6
        high = strike - speed * (end - t_us) / 1e6
        y0, y1 = int(np.clip(round(high), 0, strike)), int(np.clip(round(low), 0, strike))
        image[y0:y1, x0 + 1 : x1 - 1] = LEFT if left else RIGHT
    return image


def render(spark: SparkSession, notes: DataFrame, lanes: DataFrame, seconds: float, fps: int = 60, width: int = 640, height: int = 120, speed: float = 160.0) -> DataFrame:
    """Frames of every recording of notes (recording_id, midi, start_us, end_us, hand); lanes is one layout of 88 keys.

    The notes of a recording are a struct array beside each frame's number; pixels
    are drawn where they are read.
    """
    layout = spark.sparkContext.broadcast(lanes.toPandas())
    x = F.struct("midi", "start_us", "end_us", (F.col("hand") == "left").alias("left"))
    rows = notes.groupBy("recording_id").agg(F.collect_list(x).alias("ns"))
    count = int(seconds * fps)
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("t_us", F.round(F.col("frame") * (1e6 / fps)).cast("bigint"))
    # only the notes in view go along
    ahead = int(height / speed * 1e6)
    rows = rows.withColumn("ns", F.filter("ns", lambda n: (n["start_us"] <= F.col("t_us") + ahead) & (n["end_us"] >= F.col("t_us")))).repartition("recording_id", "frame")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in range(0, len(pdf), 64):
                piece = pdf.iloc[part : part + 64]
                pixels = [draw([(n["midi"], n["start_us"], n["end_us"], n["left"]) for n in ns], layout.value, t, width, height, speed).tobytes() for ns, t in zip(piece["ns"], piece["t_us"])]
                yield pd.DataFrame({"recording_id": piece["recording_id"], "frame": piece["frame"], "t_us": piece["t_us"], "width": width, "height": height, "pixels": pixels})

    return rows.mapInPandas(run, SCHEMA)


def image(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0..179, saturation and value 0..255, as arrays of the image's shape."""
    x = rgb.astype(np.float32)
    top, low = x.max(axis=-1), x.min(axis=-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30
    return np.where(top > low, hue % 180, 0), np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0), top
