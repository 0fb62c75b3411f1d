"""Themes, the route of a pixel, and the colour of a run, on drawn frames: one a rule."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import bars, hands, notation, theme, vision
from cadenza.sources import frames, pieces

W, H, BACK = 120, 80, 12
BLUE, GREEN, GOLD, RED, ORANGE, WHITE = (40, 80, 225), (90, 200, 80), (210, 190, 150), (230, 30, 20), (230, 85, 20), (235, 235, 235)


def picture(blocks, back=None):
    """Blocks (x0, x1, y0, y1, colour) on a dark or a given image of W x H."""
    image = np.full((H, W, 3), BACK, np.uint8) if back is None else back.copy()
    for x0, x1, y0, y1, colour in blocks:
        image[y0:y1, x0:x1] = colour
    return image


def falling(spark, name, columns, back=None, count=12):
    """Frames of blocks (x0, x1, colour) that fall from frame to frame."""
    rows = []
    for i in range(count):
        y = (i * 5) % 50
        rows.append((name, i, i * 16_667, W, H, bytearray(picture([(a, b, y, y + 8, c) for a, b, c in columns], back).tobytes())))
    return spark.createDataFrame(rows, frames.SCHEMA)


def rainbow(spark, name):
    wheel = [tuple(int(x) for x in np.rint(255 * np.clip(np.abs((np.arange(3) * -2 + k / 60 + 3) % 6 - 3) - 1, 0, 1))) for k in range(0, 360, 3)]
    return falling(spark, name, [(x, x + 1, wheel[x]) for x in range(W)])


@pytest.fixture(scope="module")
def themes(spark):
    rng = np.random.default_rng(3)
    art = np.empty((H, W, 3), np.uint8)
    art[:] = (150, 20, 140)
    art[:, ::7] = (120, 10, 130)
    film = [(7, i, i, W, H, bytearray(picture([(0, 40, (i * 5) % 50, (i * 5) % 50 + 20, BLUE)], rng.integers(0, 160, (H, W, 3)).astype(np.uint8)).tobytes())) for i in range(12)]
    pictures = [
        falling(spark, 0, [(0, 20, BLUE), (60, 80, GREEN)]),
        falling(spark, 1, [(0, 20, BLUE), (60, 80, GREEN)], art),  # over a still image
        rainbow(spark, 2),
        falling(spark, 3, [(0, 20, (200, 200, 200))]),  # colourless
        falling(spark, 4, [(0, 20, BLUE), (60, 80, WHITE)]),  # one colour and white
        falling(spark, 5, [(0, 15, ORANGE), (90, 110, RED)]),  # close hues, apart on the keyboard
        falling(spark, 6, [(0, 40, BLUE), (60, 80, GOLD)]),  # a pale second colour
        spark.createDataFrame(film, frames.SCHEMA),
        falling(spark, 8, [(0, 20, RED), (5, 25, ORANGE)]),  # close hues in one place
        falling(spark, 9, [(0, 20, BLUE), (60, 80, GREEN)], art, 7),  # too few frames to know a backdrop
    ]
    table = pictures[0]
    for p in pictures[1:]:
        table = table.unionByName(p)
    return {r.recording_id: r for r in theme.theme(theme.tones(table).checkpoint()).collect()}


def hue_of(colour):
    return float(np.floor(frames.hsv(np.array(colour, np.uint8))[0]))


def hues(row):
    return {c.hue for c in row.colours if not c.white}


def test_colours(themes):
    r = themes[0]
    assert (r.kind, r.backdrop, hues(r)) == ("colours", True, {hue_of(BLUE), hue_of(GREEN)})
    assert [c.cluster for c in r.colours] == [0, 1] and r.colours[0].share >= r.colours[1].share
    assert 55 <= r.val_min <= 210 and r.sat_min == 70 and r.white_sat_max == 0


def test_still_backdrop_is_taken_away(themes):
    assert themes[1].backdrop and hues(themes[1]) == {hue_of(BLUE), hue_of(GREEN)}
    assert not themes[9].backdrop and hues(themes[9]) & {hue_of((150, 20, 140)), hue_of((120, 10, 130))}


def test_moving_backdrop_stays(themes):
    assert not themes[7].backdrop and hue_of(BLUE) in hues(themes[7])


def test_rainbow(themes):
    r = themes[2]
    assert (r.kind, len(r.colours), r.colours[0].hue) == ("rainbow", 1, 90.0) and 30 <= r.sat_min <= 70


def test_colourless(themes):
    r = themes[3]
    assert (r.kind, r.sat_min, r.val_min) == ("colourless", 0, 120) and len(r.colours) == 1


def test_white_notes_beside_one_colour(themes):
    r = themes[4]
    assert r.kind == "colours" and [c.white for c in r.colours] == [False, True] and hues(r) == {hue_of(BLUE)}
    assert 20 <= r.white_sat_max and r.white_val_min == int(0.75 * 235) and r.colours[1].sat == 0.0
    assert not any(c.white for c in themes[0].colours)


def test_close_hues_are_two_colours_only_where_they_are_apart(themes):
    assert hues(themes[5]) == {hue_of(RED), hue_of(ORANGE)}
    assert len(hues(themes[8])) == 1


def test_pale_colour_of_another_family_stays(themes):
    r = themes[6]
    assert hues(r) == {hue_of(BLUE), hue_of(GOLD)} and r.colours[1].share < 0.12
    assert 30 <= r.sat_min < 70


def test_no_frames(spark):
    assert theme.theme(theme.tones(spark.createDataFrame([], frames.SCHEMA))).count() == 0


def test_routes():
    colour = lambda k, hue, white=False: {"cluster": k, "hue": hue, "white": white}
    row = SimpleNamespace(kind="colours", sat_min=70, val_min=100, white_sat_max=40, white_val_min=180, colours=[colour(0, 3.0), colour(1, 11.0), colour(2, 0.0, True)])
    h, s, v = np.array([4, 8, 175, 90, 7, 5, 5, 0, 0]), np.array([200, 200, 200, 200, 200, 60, 240, 10, 10]), np.array([200, 200, 200, 200, 200, 200, 60, 200, 150])
    assert theme.routed(h, s, v, row, theme.CLASSIFY_REACH).tolist() == [0, 1, 0, -1, 0, -1, -1, 2, -1]
    assert theme.routed(h, s, v, row, theme.BAR_REACH, dark=True).tolist() == [0, 1, 0, -1, 0, -1, 0, 2, -1]
    assert theme.routed(h, s, v, row, theme.KEY_REACH, 30).tolist() == [0, 1, 0, -1, 0, 0, -1, 2, -1]
    for kind, want in (("rainbow", [0, 0, 0, 0, 0, -1, -1, -1, -1]), ("colourless", [0, 0, 0, 0, 0, 0, -1, 0, 0])):
        assert theme.routed(h, s, v, SimpleNamespace(kind=kind, sat_min=70, val_min=100), 22).tolist() == want


def test_runs_carry_their_colour_and_labels_are_no_holes(spark):
    layout = spark.createDataFrame([(60, 20.0, 10.0, False), (61, 30.0, 5.8, True), (62, 40.0, 10.0, False), (64, 80.0, 10.0, False), (63, 50.0, 5.8, True)], "midi int, center double, half_width double, is_black boolean")
    labelled = [(11, 29, 10, 40, BLUE), (18, 23, 15, 35, WHITE)]  # a label in the middle of the bar
    pair = [(25, 35, 10, 40, GREEN), (45, 55, 10, 40, GREEN)]  # both black neighbours of 62
    mixed = [(71, 90, 10, 30, BLUE), (71, 90, 30, 40, GREEN)]
    rows = [(0, i, i, W, H, bytearray(picture(b).tobytes())) for i, b in enumerate((labelled, pair, mixed))]
    colours = spark.createDataFrame([(0, 0, int(hue_of(BLUE)), 0.5), (0, 1, int(hue_of(GREEN)), 0.5)], "recording_id long, cluster int, hue int, share double")
    found = bars.lane_runs(spark.createDataFrame(rows, frames.SCHEMA), layout, themes=theme.of_peaks(colours)).collect()
    assert {(r.frame, r.midi, r.y_top, r.y_bottom, r.cluster) for r in found} == {(0, 60, 10.0, 40.0, 0), (1, 61, 10.0, 40.0, 1), (1, 63, 10.0, 40.0, 1), (2, 64, 10.0, 40.0, 0)}


def test_white_keys_are_read_below_the_black_ones(spark):
    layout = spark.createDataFrame([(60, 20.0, 10.0, False)], "midi int, center double, half_width double, is_black boolean")
    strike, deep = 60, 20
    shown = picture([(0, W, strike, H, WHITE), (10, 30, strike + int(0.58 * deep), H, BLUE), (60, 80, 0, 20, BLUE)])
    peaks = spark.createDataFrame([(0, 0, int(hue_of(BLUE)), 1.0)], "recording_id long, cluster int, hue int, share double")
    r = vision.key_lights(spark.createDataFrame([(0, 0, 0, W, H, bytearray(shown.tobytes()))], frames.SCHEMA), layout, peaks).first()
    assert (r.fill, r.lit, r.trip) == (1.0, 0, 0.0)


def test_sound_in_blocks_equals_sound_at_once(spark):
    rate, size, hop = 22_050, 2048, 512
    rng = np.random.default_rng(5)
    parts, want = [], set()
    for name, n in ((0, rate * 6), (1, rate * 2), (2, size + hop), (3, 0)):
        x = rng.normal(size=n) * 1e-3
        for t in rng.integers(0, max(1, n), 9 if n > rate else 0):
            m = min(3000, n - t)
            x[t : t + m] += (np.sin(np.arange(3000) * 0.2) * np.exp(-np.arange(3000) / 800))[:m] * rng.uniform(0.2, 1)
        parts += [(name, i, [float(v) for v in p]) for i, p in enumerate(np.array_split(x, 7))]
        steps = (len(x) - size) // hop + 1
        if steps < 3:
            continue
        mag = np.abs(np.fft.rfft(np.stack([x[i * hop : i * hop + size] for i in range(steps)]) * np.hanning(size), axis=1))
        flux = np.concatenate([[0.0], np.maximum(np.diff(mag, axis=0), 0).sum(axis=1)])
        flux /= flux.max()
        level = np.convolve(flux, np.ones(17) / 17, "same") + 0.06
        want |= {(name, round(i * hop / rate * 1e6)) for i in range(1, steps - 1) if flux[i] > level[i] and flux[i] >= flux[i - 1] and flux[i] > flux[i + 1]}
    table = spark.createDataFrame([*parts, (0, 99, None)], "recording_id long, chunk int, pcm array<double>")
    for block in (5, 40, 1024):
        got = vision.spectral_onsets(table, rate, size, hop, block)
        assert {tuple(r) for r in got.collect()} == want and want


def test_hands_of_bars_by_their_colour(spark):
    """The left hand plays above the right one at times: only the colour tells."""
    layout = notation.even_lanes(spark, 1040.0)
    truth = pieces.as_table(spark, [(60, 0.8, 1.1, "left", 80), (76, 0.8, 1.2, "right", 80), (62, 1.0, 1.3, "right", 90), (64, 1.5, 1.7, "left", 90)])
    pictures = frames.render(spark, truth, layout, 2.0, 60, 1040, 400, 320.0).checkpoint()
    themes = theme.theme(theme.tones(vision.sampled(pictures)).checkpoint()).checkpoint()
    assert themes.first().kind == "colours" and len(themes.first().colours) == 2
    found = bars.bar_notes(bars.lane_runs(pictures, layout, themes=themes), 300.0, 320.0)
    got = {(r.midi, r.hand) for r in hands.by_colour(found).collect()}
    assert got == {(60, "left"), (76, "right"), (62, "right"), (64, "left")}
    spread = spark.createDataFrame([(0, 60, f, f * 16_667, 100.0, 300.0, c) for f, c in enumerate([1, 0, 1, 0, 1])], "recording_id long, midi int, frame int, t_us long, y_top double, y_bottom double, cluster int")
    islands = bars.bar_islands(spread, 300.0, 6.0)
    assert [r.color_cluster for r in bars.bar_colours(spread, islands, 300.0, 6.0).collect()] == [1]
    assert [r.color_cluster for r in bars.bar_colours(spread.filter("frame < 4"), islands.withColumn("last_frame", F.lit(3)), 300.0, 6.0).collect()] == [0]
