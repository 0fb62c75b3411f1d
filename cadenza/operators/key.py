"""Key of a recording from its pitch classes, and spelling of its notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.pitch import spelling

# fixed values: published key profiles by pitch class from the tonic, major and minor
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def histogram(notes: DataFrame) -> DataFrame:
    """recording_id, pc 0..11, weight: sounding seconds a pitch class, at least a millisecond a note."""
    weight = F.greatest(F.lit(1000), F.col("end_us") - F.col("start_us"))
    found = notes.groupBy("recording_id", F.pmod("midi", F.lit(12)).alias("pc")).agg((F.sum(weight) / 1e6).alias("weight"))
    every = notes.select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    return every.join(found, ["recording_id", "pc"], "left").select("recording_id", "pc", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def detect_key(notes: DataFrame) -> DataFrame:
    """recording_id, tonic_pc, mode, fifths, score: the key whose profile correlates best, the lower tonic and then major among equals."""
    spark = notes.sparkSession
    shapes = [(t, m, pc, float(p[(pc - t) % 12])) for t in range(12) for m, p in enumerate((MAJOR, MINOR)) for pc in range(12)]
    profiles = spark.createDataFrame(shapes, "tonic int, minor int, pc int, p double")
    scored = histogram(notes).join(F.broadcast(profiles), "pc").groupBy("recording_id", "tonic", "minor").agg(F.coalesce(F.corr("weight", "p"), F.lit(0.0)).alias("score"))
    # equal up to rounding is equal
    best = scored.groupBy("recording_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("tonic")).alias("t"), (-F.col("minor")).alias("m"))).alias("b"))
    tonic, minor = -F.col("b.t"), F.col("b.m") == -1
    major = F.when(minor, F.pmod(tonic + 3, F.lit(12))).otherwise(tonic)
    return best.select("recording_id", tonic.alias("tonic_pc"), F.when(minor, "minor").otherwise("major").alias("mode"), (F.pmod(7 * major + 5, F.lit(12)) - 5).alias("fifths"), F.round("b.score", 6).alias("score"))


def spell(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """notes with step, alter, octave for their recording's key (C major without one)."""
    rows = notes.join(keys.select("recording_id", "fifths"), "recording_id", "left")
    return rows.withColumn("__s", spelling(F.col("midi"), F.coalesce("fifths", F.lit(0)))).select(*notes.columns, F.col("__s.step").alias("step"), F.col("__s.alter").alias("alter"), F.col("__s.octave").alias("octave"))
