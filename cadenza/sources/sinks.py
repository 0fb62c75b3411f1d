"""Writers: CSV rows, JSON documents, MIDI files and MusicXML, a file's bytes as one row a recording."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions.note import overall_confidence
from cadenza.functions.pitch import midi_to_name
from cadenza.operators.key import detect_key, spell
from cadenza.operators.notation import chord_layout, midi_events, score_positions, triplet_beats


def csv_columns(notes: DataFrame) -> DataFrame:
    """recording_id and the columns of the note table as text: seconds with 6 decimals, confidences with 3, issues joined by `;`."""
    seconds = lambda c: F.format_string("%.6f", c / 1e6)
    share = lambda c: F.format_string("%.3f", F.col(c))
    issues = F.array_join("issues", ";") if "issues" in notes.columns else F.lit("")
    return notes.select(
        "recording_id", "note_id", "midi", midi_to_name(F.col("midi")).alias("name"), seconds(F.col("start_us")).alias("start"), seconds(F.col("end_us")).alias("end"),
        seconds(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).alias("duration"), "hand", *(share(c).alias(c) for c in ("detection_confidence", "pitch_confidence", "timing_confidence", "duration_confidence")),
        F.format_string("%.3f", overall_confidence()).alias("overall_confidence"), issues.alias("issues"),
    )


def write_csv(notes: DataFrame, path: str) -> None:
    """One folder a recording; each writer task sorts its own rows, so there is no sort of the whole table."""
    rows = csv_columns(notes).repartition("recording_id").sortWithinPartitions("recording_id", "note_id")
    rows.write.partitionBy("recording_id").option("header", True).csv(path)


def json_documents(notes: DataFrame, report: DataFrame | None = None, tempo: DataFrame | None = None, quantized: DataFrame | None = None, accuracy: DataFrame | None = None) -> DataFrame:
    """recording_id, document: {"notes": [...], "quantized": [...], "report": {...}, "tempo": {...}, "ground_truth": {...}}, as far as they are given.

    Notes stand in time order, quantized ones in the order of their beats.
    """
    note = F.struct("start_us", "midi", "note_id", "end_us", "hand", F.round(overall_confidence(), 4).alias("overall_confidence"))
    rows = notes.groupBy("recording_id").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    names = ["notes"]
    if quantized is not None:
        one = F.struct("beat", "midi", "note_id", "end_beat", "quantized_s", "error_ms", "ambiguous")
        rows = rows.join(quantized.groupBy("recording_id").agg(F.array_sort(F.collect_list(one)).alias("quantized")), "recording_id", "left")
        names.append("quantized")
    for name, part in (("report", report), ("tempo", tempo), ("ground_truth", accuracy)):
        if part is not None:
            rows = rows.join(part.select("recording_id", F.struct(*(c for c in part.columns if c != "recording_id")).alias(name)), "recording_id", "left")
            names.append(name)
    return rows.select("recording_id", F.to_json(F.struct(*names)).alias("document"))


def read_documents(documents: DataFrame) -> DataFrame:
    """Notes of json_documents(); unknown fields are ignored, note ids run by start and pitch."""
    kind = "struct<notes:array<struct<start_us:bigint,midi:int,end_us:bigint,hand:string>>>"
    rows = documents.select("recording_id", F.from_json("document", kind).alias("d")).select("recording_id", F.posexplode(F.array_sort("d.notes")).alias("i", "n"))
    return rows.select("recording_id", (F.col("i") + 1).cast("bigint").alias("note_id"), "n.midi", "n.start_us", "n.end_us", F.coalesce("n.hand", F.lit("unknown")).alias("hand"))


def _varint(n: int) -> bytes:
    """Seven bits a byte, the last without the high bit."""
    out = bytes([n & 0x7F])
    while n > 0x7F:
        n >>= 7
        out = bytes([(n & 0x7F) | 0x80]) + out
    return out


def midi_files(notes: DataFrame, bpm: Column, config: Config = DEFAULT, pedals: DataFrame | None = None, beats_per_measure: int = 4) -> DataFrame:
    """recording_id, file: a format 0 MIDI file with the tempo, the time signature and the event stream. A file is one value, so a recording is one group."""
    rows = midi_events(notes.withColumn("__bpm", bpm), F.col("__bpm"), config, pedals).join(notes.groupBy("recording_id").agg(F.max(bpm).alias("bpm")), "recording_id")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        head = b"\x00\xff\x51\x03" + int(round(60_000_000 / pdf["bpm"].iloc[0])).to_bytes(3, "big")
        parts = [head, b"\x00\xff\x58\x04", bytes([beats_per_measure, 2, 24, 8])]
        status = {"on": 0x90, "off": 0x80, "pedal": 0xB0}
        for delta, kind, channel, midi, velocity in pdf[["delta", "kind", "channel", "midi", "velocity"]].itertuples(index=False):
            parts += [_varint(int(delta)), bytes([status[kind] | int(channel), int(midi), int(velocity)])]
        track = b"".join([*parts, b"\x00\xff\x2f\x00"])
        data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, config.ppq) + b"MTrk" + struct.pack(">I", len(track)) + track
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "file": [data]})

    return rows.groupBy("recording_id").applyInPandas(build, "recording_id bigint, file binary")


def musicxml(notes: DataFrame, period: Column, phase: Column, beats_per_measure: int = 4) -> DataFrame:
    """recording_id, document: a two-staff score.

    Every note, measure and score is text made by column expressions; a document is one
    value, so a recording's measures meet in one row at the end.
    """
    positions = score_positions(notes, period, phase, beats_per_measure)
    layout = chord_layout(positions, triplet_beats(notes, period, phase), beats_per_measure)
    keys = detect_key(notes).select("recording_id", "tonic_pc", "mode", "fifths")
    rows = layout.select("*", F.posexplode_outer("pitches").alias("i", "midi"))
    rows = spell(rows, keys)

    def tag(name: str, *inner: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), *(x.cast("string") for x in inner), F.lit(f"</{name}>"))

    def when(condition: Column, text: Column) -> Column:
        return F.when(condition, text).otherwise("")

    pitch = tag("pitch", tag("step", F.col("step")), when(F.col("alter") != 0, tag("alter", F.col("alter"))), tag("octave", F.col("octave")))
    head = F.when(F.col("midi").isNull(), F.lit("<rest/>")).otherwise(F.concat(when(F.col("i") > 0, F.lit("<chord/>")), pitch))
    third = F.lit("<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes><normal-type>eighth</normal-type></time-modification>")
    lead = F.coalesce(F.col("i"), F.lit(0)) == 0
    brackets = tag("notations", when(F.col("begins"), F.lit('<tuplet type="start" bracket="yes"/>')), when(F.col("ends"), F.lit('<tuplet type="stop"/>')))
    note = tag("note", head, tag("duration", F.col("dur")), tag("voice", F.col("staff")), tag("type", F.col("type")), F.repeat(F.lit("<dot/>"), F.col("dots")), when(F.col("triplet"), third), tag("staff", F.col("staff")), when(lead & (F.col("begins") | F.col("ends")), brackets))
    rows = rows.withColumn("xml", note)
    staves = rows.groupBy("recording_id", "divisions", "measure").agg(F.array_sort(F.collect_list(F.struct("staff", "pos", "i", "xml"))).alias("xs"))

    def staff(k: int) -> Column:
        return F.array_join(F.transform(F.filter("xs", lambda x: x["staff"] == k), lambda x: x["xml"]), "")

    back = tag("backup", tag("duration", F.col("divisions") * beats_per_measure))
    staves = staves.select("recording_id", "divisions", "measure", F.concat(staff(1), back, staff(2)).alias("xml"))
    scores = staves.groupBy("recording_id", "divisions").agg(F.array_sort(F.collect_list(F.struct("measure", "xml"))).alias("xs"))
    scores = scores.join(keys, "recording_id").join(notes.groupBy("recording_id").agg(F.max(60 / period).alias("bpm")), "recording_id")
    clefs = F.lit('<staves>2</staves><clef number="1"><sign>G</sign><line>2</line></clef><clef number="2"><sign>F</sign><line>4</line></clef>')
    key = tag("key", tag("fifths", F.col("fifths")), tag("mode", F.col("mode")))
    time = tag("time", tag("beats", F.lit(beats_per_measure)), tag("beat-type", F.lit(4)))
    pace = F.rint("bpm").cast("int").cast("string")
    tempo = F.concat(F.lit('<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>'), pace, F.lit('</per-minute></metronome></direction-type><sound tempo="'), pace, F.lit('"/></direction>'))
    opening = F.concat(tag("attributes", tag("divisions", F.col("divisions")), key, time, clefs), tempo)
    measures = F.transform("xs", lambda x: F.concat(F.lit('<measure number="'), x["measure"].cast("string"), F.lit('">'), F.when(x["measure"] == 1, opening).otherwise(""), x["xml"], F.lit("</measure>")))
    before = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 3.1 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd"><score-partwise version="3.1"><part-list><score-part id="P1"><part-name>Piano</part-name></score-part></part-list><part id="P1">'
    return scores.select("recording_id", F.concat(F.lit(before), F.array_join(measures, ""), F.lit("</part></score-partwise>")).alias("document"))
