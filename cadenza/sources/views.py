"""The engine's tables as views of the driver's: notes, attacks, truth, lane signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event is one note of its user's recording; a day becomes a second."""
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts) div 86400")
    length = F.greatest(F.lit(20_000), F.least(F.lit(2_000_000), F.round(F.col("value") * 10_000).cast("bigint")))

    def share(factor: int):
        return (F.col("event_id") * factor % 101).cast("double") / 100

    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"),
        F.col("user_id").alias("recording_id"),
        (36 + F.get_json_object("props", "$.k").cast("int") % 24).cast("int").alias("midi"),
        start.alias("start_us"),
        (start + length).alias("end_us"),
        F.when(F.col("event_type").isin("view", "click"), "left").when(F.col("event_type") == "error", "unknown").otherwise("right").alias("hand"),
        share(31).alias("peak_fill"),
        share(53).alias("roll_support"),
        share(17).alias("detection_confidence"),
        share(29).alias("pitch_confidence"),
        share(43).alias("timing_confidence"),
        share(61).alias("duration_confidence"),
        (F.col("event_id") % 13 == 0).alias("is_restrike"),
    )


def attacks(notes: DataFrame) -> DataFrame:
    jitter = ((F.col("note_id") * 7919) % 41 - 20) * 1000
    return notes.filter("note_id % 3 <> 0").select("recording_id", (F.col("start_us") + jitter).alias("attack_us"))


def truth(notes: DataFrame) -> DataFrame:
    return notes.filter("note_id % 10 <> 0").select(
        F.col("note_id").alias("truth_id"), "recording_id", "midi",
        (F.col("start_us") + ((F.col("note_id") * 104729) % 61 - 30) * 1000).alias("start_us"),
        (F.col("end_us") + ((F.col("note_id") * 1299709) % 41 - 20) * 1000).alias("end_us"),
    )


def lane_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One embedding is one lane, one position is one frame at 60 a second."""
    lanes = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.posexplode("embedding").alias("p", "v"))
    fill = F.least(F.lit(1.0), F.abs(F.col("v").cast("double")) * 4)
    trip = F.least(F.lit(1.0), F.abs(F.get("embedding", 63 - F.col("p")).cast("double")) * 4)
    return lanes.select(
        F.expr("vec_id div 88").alias("recording_id"),
        (21 + F.col("vec_id") % 88).cast("int").alias("midi"),
        F.col("p").cast("int").alias("frame"),
        (F.col("p").cast("bigint") * 16667).alias("t_us"),
        fill.alias("fill"),
        trip.alias("trip"),
        F.when(fill >= 0.4, F.col("label") % 2).otherwise(-1).alias("lit"),
    )
