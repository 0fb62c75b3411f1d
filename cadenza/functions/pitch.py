"""Pitch as columns: names, key colours, frequencies and spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: pitch classes from C, the classes of black keys, letters along the line of fifths, and their classes
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
BLACK = [1, 3, 6, 8, 10]
FIFTHS_LETTERS = ["F", "C", "G", "D", "A", "E", "B"]
FIFTHS_CLASSES = [5, 0, 7, 2, 9, 4, 11]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def midi_to_name(midi: Column) -> Column:
    octave = (F.floor(midi / 12) - 1).cast("int")
    return F.concat(_pick(NAMES, F.pmod(midi, F.lit(12))), octave.cast("string"))


def name_to_midi(name: Column) -> Column:
    """Inverse of midi_to_name; null for what is no sharp-spelled name."""
    plain = F.trim(name)
    letter = F.regexp_extract(plain, r"^([A-G]#?)(-?\d+)$", 1)
    octave = F.nullif(F.regexp_extract(plain, r"^([A-G]#?)(-?\d+)$", 2), F.lit("")).cast("int")
    index = F.array_position(F.array(*(F.lit(n) for n in NAMES)), letter).cast("int")
    return F.when(index > 0, (octave + 1) * 12 + index - 1)


def is_black_key(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12)).isin(BLACK)


def frequency(midi: Column) -> Column:
    """Hertz in equal temperament, A4 = 440."""
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def spelling(midi: Column, fifths: Column) -> Column:
    """struct(step, alter, octave): the line-of-fifths place of the pitch class nearest to fifths + 2."""
    start = F.pmod(7 * F.pmod(midi, F.lit(12)), F.lit(12))
    place = start + F.rint((fifths + 2 - start) / 12.0).cast("int") * 12
    letter = F.pmod(place + 1, F.lit(7))
    step = _pick(FIFTHS_LETTERS, letter)
    alter = F.floor((place + 1) / 7.0).cast("int")
    octave = (F.floor((midi - _pick(FIFTHS_CLASSES, letter) - alter) / 12.0) - 1).cast("int")
    return F.struct(step.alias("step"), alter.alias("alter"), octave.alias("octave"))
