"""What colours a recording's notes have: coloured, rainbow or colourless, with white notes and over a still backdrop.

tones() reads frames (a bounded sample of each recording, see vision.sampled) into small
histograms, theme() decides on those with grouped aggregates and column expressions, and
routed() gives each pixel of a frame its colour by the theme's row.  tones() is read
several times and should be checkpointed, as plans.analysis does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.frames import hsv, image

# fixed values that decide results: hues go round at 180, saturations and values end at 255
FLOOR_SAT, FLOOR_VAL, BRIGHT_VAL, CAP_SAT, STRONG_SAT = 30, 70, 120, 70, 120
STILL_VAL, STILL_SHARE, STILL_FRAMES, MOVED_VAL, MOVED_SAT = 12, 0.6, 8, 35, 40
FEWEST, RAINBOW_SHARE, RAINBOW_HUES = 100, 0.15, 90
APART, MERGE, CANDIDATES, COLOURS, COLUMN_REACH, SIDE_WEIGHT, SIDE_APART, NEAR = 6, 22, 8, 3, 3, 0.30, 0.15, 11
SHARE, FAMILY, FAMILY_SHARE = 0.12, 35, 0.10
WHITE_FEWEST, WHITE_SHARE, WHITE_SAT, WHITE_CHROMA = 400, 0.20, 40, 60
CLASSIFY_REACH, KEY_REACH, BAR_REACH = 22, 18, 20
DARK_SAT, DARK_VAL = 230, 55

TONES = "recording_id bigint, kind string, moved boolean, frame int, bin int, n bigint, sat double, val double, weight double, place double"
COLOUR = "struct<cluster:int,hue:double,sat:double,val:double,share:double,white:boolean>"


def tones(frames: DataFrame, strike_share: float = 0.75, strip: int = 16) -> DataFrame:
    """Histograms of the pixels above the keys: recording_id, kind, moved, frame, bin, n, sat, val, weight, place.

    kind `hue` (bin: the hue, a row a frame) counts vivid pixels with the sums of their
    saturation, value, squared saturation and that times their place across the image;
    `vivid` and `bright` (bin: saturation * 256 + value) count vivid ones and ones of any
    saturation; `still` holds the pixels (weight) and those that stay near their median
    over time (n).  Each stands once for all pixels, once for those that moved away from
    their median.  frames are a sample of bounded size of each recording: a strip of rows
    of all of them is a group, so that medians need no recording in one task.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                rgb = image(row.pixels, row.width, row.height)[: int(row.height * strike_share)]
                parts = [rgb[y : y + strip].tobytes() for y in range(0, len(rgb), strip)]
                yield pd.DataFrame({"recording_id": row.recording_id, "frame": row.frame, "width": row.width, "height": row.height, "strip": range(len(parts)), "pixels": parts})

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        name, numbers = pdf["recording_id"].iloc[0], pdf["frame"].to_numpy()
        stack = np.stack([np.frombuffer(p, np.uint8).reshape(-1, width, 3) for p in pdf["pixels"]])
        h, s, v = (x.astype(np.int32) for x in hsv(stack))
        away_s, away_v = np.abs(s - np.median(s, axis=0)), np.abs(v - np.median(v, axis=0))
        out = [pd.DataFrame({"kind": "still", "moved": [False], "frame": 0, "bin": 0, "n": int((away_v < STILL_VAL).sum()), "weight": float(v.size)})]
        vivid, bright = (s >= FLOOR_SAT) & (v >= FLOOR_VAL), v >= BRIGHT_VAL
        column = np.broadcast_to(np.arange(width) / width, s.shape)
        which = np.broadcast_to(np.arange(len(numbers))[:, None, None], s.shape)
        for moved in (False, True):
            seen = vivid & ((away_v >= MOVED_VAL) | (away_s >= MOVED_SAT)) if moved else vivid
            strong = (s[seen] / 255.0) ** 2
            cell = which[seen] * 180 + h[seen]
            sums = {"n": None, "sat": s[seen], "val": v[seen], "weight": strong, "place": strong * column[seen]}
            table = {k: np.bincount(cell, x, len(numbers) * 180) for k, x in sums.items()}
            at = np.flatnonzero(table["n"])
            out.append(pd.DataFrame({"kind": "hue", "moved": moved, "frame": numbers[at // 180], "bin": at % 180} | {k: x[at] for k, x in table.items()}))
            for kind, kept in (("vivid", seen), ("bright", bright & (away_v >= MOVED_VAL) if moved else bright)):
                counts = np.bincount(s[kept] * 256 + v[kept], minlength=1)
                at = np.flatnonzero(counts)
                out.append(pd.DataFrame({"kind": kind, "moved": moved, "frame": 0, "bin": at, "n": counts[at]}))
        rows = pd.concat([x for x in out if len(x)]).assign(recording_id=name)
        return rows.reindex(columns=[c.split()[0] for c in TONES.split(", ")]).fillna(0.0).astype({"n": np.int64, "frame": np.int32, "bin": np.int32})

    strips = frames.select("recording_id", "frame", "width", "height", "pixels").mapInPandas(cut, "recording_id bigint, frame int, width int, height int, strip int, pixels binary")
    rows = strips.groupBy("recording_id", "width", "height", "strip").applyInPandas(read, TONES)
    sums = [F.sum(c).alias(c) for c in ("n", "sat", "val", "weight", "place")]
    return rows.groupBy("recording_id", "kind", "moved", "frame", "bin").agg(*sums)


def _clip(x: Column, low: Any, high: Any) -> Column:
    return F.greatest(F.least(x, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def circle(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 180 - F.abs(a - b))


def theme(tones: DataFrame) -> DataFrame:
    """One row a recording: recording_id, kind, sat_min, val_min, white_sat_max, white_val_min, backdrop, colours.

    backdrop: most of the roll keeps near its median in eight frames or more; then only
    pixels that moved count.  kind `colourless`: fewer than 100 vivid pixels, notes are
    what is bright.  `rainbow`: more than 90 hues with 0.15 of the most frequent one's
    weight; one colour.  `colours`: up to three peaks of the hues, each frame weighing
    one, 22 apart or, if lower, in another part of the keyboard; the first stays, others
    with 0.12 of the weight or, in another family of hues, 0.10 of the pixels.  Beside a
    single chromatic colour white notes are one more, where a fifth of the bright pixels
    has little saturation.  colours: array of (cluster, hue, sat, val, share, white).
    """
    frames = tones.filter("kind = 'hue' and not moved").groupBy("recording_id").agg(F.count_distinct("frame").alias("__frames"))
    still = tones.filter("kind = 'still'").groupBy("recording_id").agg((F.sum("n") / F.sum("weight")).alias("__still"))
    still = still.join(frames, "recording_id", "left")
    still = still.select("recording_id", F.coalesce((F.col("__still") > STILL_SHARE) & (F.col("__frames") >= STILL_FRAMES), F.lit(False)).alias("backdrop"))
    chosen = tones.join(still, "recording_id").filter(F.col("moved") == F.col("backdrop"))

    s, v = F.floor(F.col("bin") / 256), F.col("bin") % 256
    strong = F.when(s >= STRONG_SAT, F.col("n")).otherwise(F.lit(0)).cast("bigint")
    vivid = chosen.filter("kind = 'vivid'").groupBy("recording_id").agg(
        F.sum("n").alias("__n"), F.sum(strong).alias("__strong"), F.percentile(v, F.lit(0.92), F.col("n")).alias("__core"), F.percentile(v, F.lit(0.12), strong).alias("__low"),
        F.percentile(s, F.lit(0.2), F.col("n")).alias("__pale"), (F.sum(s * F.col("n")) / F.sum("n")).alias("__sat"), (F.sum(v * F.col("n")) / F.sum("n")).alias("__val"),
    )

    frame = Window.partitionBy("recording_id", "frame")
    hues = chosen.filter("kind = 'hue'").withColumn("__w", F.col("weight") / F.sum("weight").over(frame))
    hues = hues.groupBy("recording_id", "bin").agg(F.round(F.sum("__w"), 12).alias("w"), F.sum("n").alias("n"), F.sum("sat").alias("sat"), F.sum("val").alias("val"), F.sum("weight").alias("weight"), F.sum("place").alias("place"))
    bins = hues.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("w", "n", "sat", "val", "weight", "place")))).alias("__m"))

    def around(hue: Column, reach: int, field: str) -> Column:
        each = lambda o: F.coalesce(F.try_element_at("__m", F.pmod(hue + o, F.lit(180)).cast("int"))[field].cast("double"), F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(-reach), F.lit(reach)), F.lit(0.0), lambda acc, o: acc + each(o))

    entries = F.transform(F.map_entries("__m"), lambda e: F.struct(e["value"]["w"].alias("w"), (-e["key"]).alias("h")))
    ranked = F.reverse(F.array_sort(F.filter(entries, lambda e: e["w"] > 0)))  # the heaviest first, of equal ones the smallest hue
    none = F.expr("cast(array() as array<struct<w:double,h:int>>)")
    apart = F.aggregate(ranked, none, lambda acc, x: F.when((F.size(acc) < CANDIDATES) & ~F.exists(acc, lambda p: circle(p["h"], x["h"]) < APART), F.array_append(acc, x)).otherwise(acc))
    spot = lambda p: F.try_divide(around(-p["h"], COLUMN_REACH, "place"), around(-p["h"], COLUMN_REACH, "weight"))
    placed = F.transform(apart, lambda p: F.struct(p["w"].alias("w"), (-p["h"]).alias("h"), spot(p).alias("x")))

    def pick(acc: Column, p: Column) -> Column:
        close = F.filter(acc, lambda q: circle(q["h"], p["h"]) < MERGE)
        aside = (p["w"] >= SIDE_WEIGHT * F.element_at(acc, 1)["w"]) & F.exists(close, lambda q: F.abs(q["x"] - p["x"]) >= SIDE_APART)
        return F.when((F.size(acc) < COLOURS) & ((F.size(close) == 0) | F.coalesce(aside, F.lit(False))), F.array_append(acc, p)).otherwise(acc)

    rows = still.join(vivid, "recording_id", "left").join(bins, "recording_id", "left").withColumn("__placed", placed)
    rows = rows.withColumn("__peaks", F.aggregate("__placed", F.expr("cast(array() as array<struct<w:double,h:int,x:double>>)"), pick))
    total = F.aggregate(F.map_values("__m"), F.lit(0.0), lambda acc, e: acc + e["w"])
    top = F.array_max(F.transform(F.map_values("__m"), lambda e: e["w"]))
    rows = rows.withColumn("__wide", F.size(F.filter(F.map_values("__m"), lambda e: e["w"] > RAINBOW_SHARE * top)) > RAINBOW_HUES)
    found = F.transform("__peaks", lambda p: F.struct(
        F.round(around(p["h"], NEAR, "w") / total, 6).alias("share"), (-p["h"]).alias("h"),
        (around(p["h"], NEAR, "sat") / around(p["h"], NEAR, "n")).alias("sat"), (around(p["h"], NEAR, "val") / around(p["h"], NEAR, "n")).alias("val"), (around(p["h"], NEAR, "n") / F.col("__n")).alias("count"),
    ))
    rows = rows.withColumn("__found", F.reverse(F.array_sort(found)))
    first = F.try_element_at("__found", F.lit(1))
    rows = rows.withColumn("__kept", F.filter("__found", lambda c, i: (i == 0) | (c["share"] >= SHARE) | ((circle(c["h"], first["h"]) >= FAMILY) & (c["count"] >= FAMILY_SHARE))))

    few = F.coalesce(F.col("__n") < FEWEST, F.lit(True))
    base = F.greatest(F.lit(float(FLOOR_VAL)), 0.55 * F.col("__core"))
    base = F.when(F.col("__strong") >= 200, F.least(base, F.col("__low") - 12.0)).otherwise(base)
    chroma = F.array_min(F.transform("__kept", lambda c: c["sat"]))
    rows = rows.withColumns({
        "kind": F.when(few, "colourless").when(F.col("__wide"), "rainbow").otherwise("colours"),
        "val_min": F.when(few, BRIGHT_VAL).otherwise(F.floor(_clip(F.greatest(F.lit(70.0), base), 55.0, 210.0))).cast("int"),
        "sat_min": F.when(few, 0).when(F.col("__wide"), F.floor(_clip(0.6 * F.col("__pale"), 30.0, float(CAP_SAT)))).otherwise(F.floor(_clip(0.55 * chroma, 30.0, float(CAP_SAT)))).cast("int"),
        "__chroma": chroma,
    })

    # white notes beside one chromatic colour: bright pixels of half its saturation at most
    alone = rows.filter((F.col("kind") == "colours") & (F.col("__chroma") >= WHITE_CHROMA) & (F.size("__kept") == 1)).select("recording_id", "val_min", "__chroma")
    pale = F.when(s < 0.5 * F.col("__chroma"), F.col("n")).otherwise(F.lit(0)).cast("bigint")
    bright = chosen.filter("kind = 'bright'").select("recording_id", "bin", "n").join(alone, "recording_id").filter(v >= F.greatest(F.col("val_min"), F.lit(BRIGHT_VAL)))
    white = bright.groupBy("recording_id").agg(F.sum("n").alias("__all"), F.sum(pale).alias("__white"), F.percentile(s, F.lit(0.5), pale).alias("__wsat"), F.percentile(v, F.lit(0.5), pale).alias("__wval"))
    white = white.filter((F.col("__all") >= WHITE_FEWEST) & (F.col("__white") / F.col("__all") >= WHITE_SHARE) & (F.col("__wsat") <= WHITE_SAT))
    rows = rows.join(white, "recording_id", "left")
    has = F.col("__white").isNotNull()
    one = lambda *x: F.array(F.struct(*(F.lit(c).cast(t).alias(n) for c, t, n in zip(x, ("int", "double", "double", "double", "double", "boolean"), ("cluster", "hue", "sat", "val", "share", "white")))))
    seen = F.transform("__kept", lambda c, i: F.struct(i.alias("cluster"), (-c["h"]).cast("double").alias("hue"), F.round(c["sat"], 6).alias("sat"), F.round(c["val"], 6).alias("val"), c["share"].alias("share"), F.lit(False).alias("white")))
    extra = one(F.size("__kept"), 0, F.col("__wsat"), F.col("__wval"), F.round(F.col("__white") / F.col("__all"), 6), True)
    colours = F.when(few, one(0, 0, 0, 200, 1, False)).when(F.col("__wide"), one(0, 90, F.round("__sat", 6), F.round("__val", 6), 1, False)).when(has, F.concat(seen, extra)).otherwise(seen)
    return rows.select(
        "recording_id", "kind", "sat_min", "val_min",
        F.when(has, F.floor(_clip(0.5 * F.col("__chroma"), 20.0, F.greatest(F.lit(21.0), F.col("__chroma") - 15)))).otherwise(0).cast("int").alias("white_sat_max"),
        F.when(has, F.floor(_clip(0.75 * F.col("__wval"), F.col("val_min").cast("double"), 245.0))).otherwise(0).cast("int").alias("white_val_min"),
        "backdrop", colours.cast(f"array<{COLOUR}>").alias("colours"),
    )


def of_peaks(peaks: DataFrame, sat_min: int = 80, val_min: int = 70) -> DataFrame:
    """vision.hue_peaks() as themes of plain colours."""
    c = F.struct("cluster", F.col("hue").cast("double").alias("hue"), F.lit(255.0).alias("sat"), F.lit(255.0).alias("val"), F.col("share").cast("double").alias("share"), F.lit(False).alias("white"))
    listed = peaks.groupBy("recording_id").agg(F.array_sort(F.collect_list(c)).cast(f"array<{COLOUR}>").alias("colours"))
    return listed.select("recording_id", F.lit("colours").alias("kind"), F.lit(sat_min).alias("sat_min"), F.lit(val_min).alias("val_min"), F.lit(0).alias("white_sat_max"), F.lit(0).alias("white_val_min"), F.lit(False).alias("backdrop"), "colours")


def routed(h: np.ndarray, s: np.ndarray, v: np.ndarray, row: Any, reach: float, sat_min: float | None = None, dark: bool = False) -> np.ndarray:
    """The cluster of each pixel by a theme's row, -1 for none.

    In order: any vivid pixel of a rainbow and any bright one of a colourless theme is
    cluster 0; a bright pixel of little saturation is white; others go to the chromatic
    colour with the nearest hue (of equal ones the first) if that is within reach and they
    are vivid or, with dark, dim but fully saturated.
    """
    sat_min = row.sat_min if sat_min is None else sat_min
    if row.kind != "colours":
        return np.where((v >= row.val_min) & ((s >= sat_min) | (row.kind == "colourless")), 0, -1)
    out = np.full(h.shape, -1)
    chromatic = [c for c in row.colours if not c["white"]]
    if chromatic:
        away = np.stack([np.minimum(np.abs(h - c["hue"]), 180 - np.abs(h - c["hue"])) for c in chromatic])
        vivid = (s >= sat_min) & (v >= row.val_min)
        if dark:
            vivid |= (s >= DARK_SAT) & (v >= DARK_VAL)
        out = np.where(vivid & (away.min(axis=0) <= reach), np.array([c["cluster"] for c in chromatic])[away.argmin(axis=0)], -1)
    for c in row.colours:
        if c["white"]:
            out = np.where((s < row.white_sat_max) & (v >= row.white_val_min), c["cluster"], out)
    return out
