import pytest
from pyspark.sql import functions as F

from cadenza.functions import grid, note, pitch
from cadenza.operators import notation


def test_names_round_trip(spark):
    rows = spark.range(0, 128).select(F.col("id").cast("int").alias("m")).select("m", pitch.midi_to_name(F.col("m")).alias("n"), pitch.is_black_key(F.col("m")).alias("b")).withColumn("back", pitch.name_to_midi(F.col("n"))).collect()
    by = {r.m: r for r in rows}
    assert all(r.back == r.m for r in rows)
    assert (by[60].n, by[69].n, by[21].n, by[108].n) == ("C4", "A4", "A0", "C8")
    assert by[61].b and by[70].b and not by[60].b and not by[64].b and not by[71].b
    odd = spark.createDataFrame([(" C4 ",), ("H2",), ("Db4",), (None,), ("A#-1",)], "n string").select(pitch.name_to_midi(F.col("n")).alias("m")).collect()
    assert [r.m for r in odd] == [60, None, None, None, 10]


def test_snap_is_half_even_and_prefers_long(spark):
    beats = [0.0, 0.5, 1.5, 2.5, 0.26, 0.33, 0.1251, -0.3]
    got = [r.b for r in spark.createDataFrame([(b,) for b in beats], "x double").select(grid.snap(F.col("x")).alias("b")).collect()]

    def want(x):
        best, error = round(x), abs(x - round(x))
        for d in (4, 2, 1, 0.5, 1 / 3, 0.25, 1 / 6, 0.125):
            q = round(x / d) * d
            if abs(x - q) < error:
                best, error = q, abs(x - q)
        return best

    assert got == pytest.approx([want(b) for b in beats])


def test_bar_and_hue(spark):
    row = spark.createDataFrame([(1_000_000, 2_000_000)], "start_us long, end_us long").select(
        note.bar(F.lit(0), 600.0, 320.0).alias("a"), note.bar(F.lit(3_000_000), 600.0, 320.0).alias("b"), note.hue_distance(F.lit(175), F.lit(5)).alias("h"), note.clock(F.lit(61_234_999)).alias("c")
    ).first()
    assert (row.a.bottom, row.a.top, row.b, row.h, row.c) == (280.0, 0.0, None, 10, "1:01.234")


def test_spelling_in_flat_and_sharp_keys(spark):
    def spelled(midi, fifths):
        return tuple(spark.range(1).select(pitch.spelling(F.lit(midi), F.lit(fifths)).alias("s")).first().s)

    assert spelled(60, 0) == ("C", 0, 4)
    assert spelled(61, 7)[0] == "C" and spelled(61, -5)[0] == "D"
    assert spelled(71, -7) == ("C", -1, 5)  # a flat that crosses the octave


def test_even_lanes(spark):
    rows = notation.even_lanes(spark).collect()
    assert len(rows) == 88 and sum(not r.is_black for r in rows) == 52
    white = sorted(r.center for r in rows if not r.is_black)
    assert all(abs(b - a - 1280 / 52) < 1e-9 for a, b in zip(white, white[1:]))
