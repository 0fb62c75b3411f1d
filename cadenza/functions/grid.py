"""Beats: places on a linear or tracked grid, and snapping to note values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: note lengths in beats that a beat may snap to, in the order that breaks ties, as numerator and denominator
DIVISIONS = [(4, 1), (2, 1), (1, 1), (1, 2), (1, 3), (1, 4), (1, 6), (1, 8)]


def beat_at(t_us: Column, period: Column, phase: Column) -> Column:
    return (t_us / 1e6 - phase) / period


def beat_to_time(beat: Column, period: Column, phase: Column) -> Column:
    return phase + beat * period


def snap(beat: Column) -> Column:
    """The nearest multiple of a division, the whole beat first and then the earlier division among equals."""
    whole = F.rint(beat)
    options = [F.struct(F.abs(beat - whole).alias("error"), F.lit(0).alias("order"), whole.alias("beat"))]
    for i, (n, d) in enumerate(DIVISIONS, 1):
        step = F.lit(n) / F.lit(d).cast("double")
        near = F.rint(beat / step) * step
        options.append(F.struct(F.abs(beat - near).alias("error"), F.lit(i).alias("order"), near.alias("beat")))
    return F.array_min(F.array(*options))["beat"]
