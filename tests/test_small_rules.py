"""Rules that no query's SQL reaches: the report with frames, intervals in view, onset uncertainty."""

from pyspark.sql import functions as F

from cadenza.functions import note
from cadenza.operators import verify
from tests.test_refine import notes


def test_report_with_frames(spark):
    rows = verify.error_flags(notes(spark, [(60, 0, 1.0), (64, 2.0, 3.0), (67, 4.0, 5.0)]))
    diffs = spark.createDataFrame([(0, 3, ["C4"]), (0, 2, []), (0, 1, ["E4", "G4"])], "recording_id long, matched int, missing array<string>")
    r = verify.report(rows, diffs).first()
    assert (r.notes_total, r.frames, r.possible_missing, r.agreement) == (3, 3, 2, round(6 / 9, 6))
    bare = verify.report(rows, diffs.filter("false")).first()
    assert (bare.frames, bare.possible_missing, bare.agreement) == (0, 0, 1.0)


def test_in_view(spark):
    spans = notes(spark, [(60, 0, 1.0), (61, 1.0, 2.0), (62, 2.0, 3.0), (63, 5.0, 6.0)])
    got = {r.midi for r in spans.filter(note.in_view(F.lit(1_500_000), F.lit(2_500_000))).collect()}
    assert got == {61, 62}


def test_onset_uncertainty_falls_with_the_frame_rate(spark):
    rows = spark.createDataFrame([(160.0, 30.0), (160.0, 60.0), (640.0, 60.0)], "speed double, fps double")
    got = [r.u for r in rows.select(note.onset_uncertainty_ms(F.col("speed"), F.col("fps")).alias("u")).collect()]
    assert got[0] >= got[1] >= got[2] > 0
