"""Known pieces as note rows (midi, start s, end s, hand, velocity), and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Row = tuple[int, float, float, str, int]


def demo_piece() -> list[Row]:
    """Triads under a melody, a fast run, black keys and a last chord: 40 notes."""
    # fixed values: the published piece
    triads = [(48, 52, 55), (45, 48, 52), (50, 53, 57), (43, 47, 50)]
    melody = [(72, 0.0, 0.4), (72, 0.5, 0.9), (74, 1.0, 1.4), (76, 1.5, 2.4), (77, 2.5, 2.7), (79, 2.7, 2.9), (81, 2.9, 3.1), (83, 3.1, 3.3), (84, 3.3, 4.0)]
    run = [72, 74, 76, 77, 79, 81, 83, 84]
    black = [61, 63, 66, 68, 70, 73, 75, 78]
    rows: list[Row] = [(m, 1.0 + k, 1.9 + k, "left", 70) for k, chord in enumerate(triads) for m in chord]
    rows += [(m, 1.0 + a, 1.0 + b, "right", 100) for m, a, b in melody]
    rows += [(m, 5.2 + 0.08 * i, 5.27 + 0.08 * i, "right", 95) for i, m in enumerate(run)]
    rows += [(m, 6.0 + 0.25 * i, 6.22 + 0.25 * i, "right", 88) for i, m in enumerate(black)]
    return rows + [(m, 8.2, 9.1, "left", 66) for m in (42, 46, 49)]


def scale_piece() -> list[Row]:
    return [(60 + i, 0.3 * i, 0.3 * i + 0.28, "right", 90) for i in range(13)]


def as_table(spark: SparkSession, rows: list[Row], recording_id: int = 0) -> DataFrame:
    """truth_id, recording_id, midi, start_us, end_us, hand, velocity."""
    full = [(i + 1, recording_id, m, round(a * 1e6), round(b * 1e6), h, v) for i, (m, a, b, h, v) in enumerate(rows)]
    return spark.createDataFrame(full, "truth_id bigint, recording_id bigint, midi int, start_us bigint, end_us bigint, hand string, velocity int")
