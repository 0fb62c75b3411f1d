"""Thresholds of the operators, in microseconds where they are times."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values that decide results; times in microseconds
    ppq: int = 960
    merge_gap_us: int = 45_000
    sliver_us: int = 50_000
    continuous_us: int = 16_000
    far_overlap_us: int = 500_000
    drop_min_us: int = 22_000
    trim_eps_us: int = 1_000
    chord_window_us: int = 33_000
    release_window_us: int = 30_000
    release_min_us: int = 20_000
    still_us: int = 100
    semitone_guard: int = 2
    duration_tol: float = 0.1
    duration_members: int = 4
    silent_max_us: int = 70_000
    silent_tol_us: int = 55_000
    snap_low_us: int = 60_000
    snap_high_us: int = 110_000
    snap_default_us: int = 90_000
    snap_share: float = 0.45
    together_us: int = 45_000
    skew_window_us: int = 60_000
    skew_min_us: int = 4_000
    skew_matches: int = 10
    duplicate_us: int = 30_000
    overlap_us: int = 5_000
    min_duration_us: int = 20_000
    iou: float = 0.35
    truth_tol_us: int = 50_000
    high: float = 0.8
    medium: float = 0.55
    pitch_conflict: float = 0.6
    bleed_fill: float = 0.70
    bleed_brighter: float = 0.20
    roll_support: float = 0.30
    roll_strong: float = 0.85
    roll_relative: float = 0.80
    roll_lead_us: tuple[int, int] = (50_000, 1_000_000)
    hand_reach: int = 14
    hand_window_us: int = 30_000
    tempo_bpm: tuple[int, int] = (65, 170)
    tempo_phases: int = 64
    tempo_tol: float = 0.02
    odd_tol: float = 0.025
    odd_share: float = 0.2
    odd_min_bpm: float = 55.0
    ambiguous_beats: float = 0.12
    ioi_us: tuple[int, int] = (40_000, 3_000_000)
    fill: float = 0.4
    dark_fill: float = 0.15
    dark_frames: int = 2
    flicker_us: int = 60_000
    restrike_us: int = 110_000
    trough_dip: float = 0.6
    trough_rise: float = 0.85
    min_run: int = 2


DEFAULT = Config()


@dataclass(frozen=True)
class Preset:
    """How wide frames are read (None: as they are), and of how many observations one is kept for verification."""

    name: str
    width: int | None
    stride: int

    def scaled(self, native: int) -> tuple[int, float]:
        """The width that frames of a native width are read at, and its share of it; nothing is scaled up."""
        width = native if self.width is None else min(self.width, native)
        return width, width / native


# fixed values: name, width, stride
PRESETS = {p.name: p for p in (Preset("fast", 854, 8), Preset("balanced", 1280, 4), Preset("maximum", None, 2))}


def preset(name: str) -> Preset:
    """A preset by name; balanced for names that aren't known."""
    return PRESETS.get(name, PRESETS["balanced"])
