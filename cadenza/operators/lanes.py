"""Lane signals to notes: edges, islands, restrikes and sub-frame times.

A lane signal has recording_id, midi, frame, t_us, fill (0 to 1), trip, lit (a
colour cluster or -1).  Everything is keyed by (recording_id, midi).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.operators.folds import chains, emitted, spaced

LANE = ("recording_id", "midi")


def _order() -> Window:
    return Window.partitionBy(*LANE).orderBy("frame")


def rising_edges(lane: DataFrame, value: str = "fill", threshold: float = DEFAULT.fill) -> DataFrame:
    """Frames where the value comes to the threshold; a first frame at it counts."""
    before = F.lag(value).over(_order())
    rows = lane.withColumn("__before", before)
    return rows.filter((F.col(value) >= threshold) & (F.col("__before").isNull() | (F.col("__before") < threshold))).drop("__before")


def rolling_median(lane: DataFrame, value: str = "fill", reach: int = 3) -> DataFrame:
    """lane with smooth: the median of the frames up to `reach` away (fewer at the ends); lanes of under 3 frames keep their values."""
    near = _order().rowsBetween(-reach, reach)
    n = F.count("*").over(Window.partitionBy(*LANE))
    return lane.withColumn("smooth", F.when(n < 3, F.col(value)).otherwise(F.percentile(F.col(value), F.lit(0.5)).over(near)))


def next_onset(lane: DataFrame, threshold: float = DEFAULT.fill) -> DataFrame:
    """lane with onset (a rising edge) and next_onset: the first frame strictly behind that is one, or one behind the lane's last."""
    w = _order()
    onset = (F.col("fill") >= threshold) & F.coalesce(F.lag("fill").over(w) < threshold, F.lit(True))
    rows = lane.withColumn("onset", onset)
    # from the lane's end backward: a frame that ends at a partition's end is computed anew for each row
    ahead = Window.partitionBy(*LANE).orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("next_onset", F.coalesce(F.min(F.when(F.col("onset"), F.col("frame"))).over(ahead), F.max("frame").over(Window.partitionBy(*LANE)) + 1))


def gap_islands(lane: DataFrame, gap: int = 3) -> DataFrame:
    """recording_id, midi, island, first_frame, last_frame, frames: lit frames at most `gap` frames apart."""
    lit = lane.filter("lit >= 0")
    new = F.coalesce(F.col("frame") - F.lag("frame").over(_order()) > gap, F.lit(True))
    rows = lit.withColumn("__new", new).withColumn("island", F.sum(F.col("__new").cast("int")).over(_order()).cast("bigint"))
    return rows.groupBy(*LANE, "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"))


def light_islands(lane: DataFrame, frame_us: int = 16_667, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, first_frame, last_frame: runs of lit frames that bridge flicker but end when the key goes dark.

    A run ends behind its last lit frame once two unlit frames in a row are dark, or
    once more unlit frames follow than 60 ms.  So more unlit frames than that cut a lane
    into stretches, each of which is one fold, in the JVM.
    """
    bridge = max(3, round(config.flicker_us / frame_us))
    w = _order()
    rows = lane.select(*LANE, "frame", "lit", "fill").withColumn("__n", F.row_number().over(w))
    before = F.last(F.when(F.col("lit") >= 0, F.col("__n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ((F.col("lit") >= 0) & F.coalesce(F.col("__n") - before > bridge + 1, F.lit(True))).cast("bigint")
    rows = rows.withColumn("__new", new).withColumn("__stretch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__stretch > 0")
    frames = rows.groupBy(*LANE, "__stretch").agg(F.sort_array(F.collect_list(F.struct("frame", "lit", "fill"))).alias("xs"))
    start = F.expr("named_struct('first', cast(null as int), 'last', cast(null as int), 'gap', 0, 'dark', 0)")
    nothing = F.lit(None).cast("int")

    def run(acc: Column) -> Column:
        return F.struct(acc["first"].alias("first_frame"), acc["last"].alias("last_frame"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        lit, running = x["lit"] >= 0, acc["first"].isNotNull()
        gap = F.when(lit, 0).otherwise(acc["gap"] + 1)
        dark = F.when(lit | (x["fill"] >= config.dark_fill), 0).otherwise(acc["dark"] + 1)
        ends = running & ~lit & ((dark >= config.dark_frames) | (gap > bridge))
        first = F.when(ends, nothing).when(lit & ~running, x["frame"]).otherwise(acc["first"])
        last = F.when(ends, nothing).when(lit, x["frame"]).otherwise(acc["last"])
        state = F.struct(first.alias("first"), last.alias("last"), F.when(running | lit, gap).otherwise(0).alias("gap"), F.when(running | lit, dark).otherwise(0).alias("dark"))
        return state, F.when(ends, run(acc))

    folded = emitted(F.col("xs"), start, step, "struct<first_frame:int,last_frame:int>", lambda acc: F.when(acc["first"].isNotNull(), run(acc)))
    runs = frames.select(*LANE, F.explode(folded).alias("r")).select(*LANE, "r.*")
    return runs.filter(F.col("last_frame") - F.col("first_frame") + 1 >= config.min_run)


def subframe_edges(runs: DataFrame, lane: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """runs with on_us and off_us: where the fill crosses the threshold between the frames at either end.

    Each run meets two pairs of frames by equi-joins; a run at the lane's end lasts one frame more.
    """
    w = _order()
    ends = lane.select(*LANE, "frame", "t_us", "fill", F.lag("t_us").over(w).alias("t0"), F.lag("fill").over(w).alias("f0"), F.lead("t_us").over(w).alias("t2"), F.lead("fill").over(w).alias("f2"))
    thr = config.fill
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    up = F.when(F.col("t0").isNull() | (F.col("fill") <= F.col("f0")) | (F.col("fill") < thr), F.col("t_us").cast("double")).otherwise(
        F.col("t0") + clip(F.try_divide(thr - F.col("f0"), F.col("fill") - F.col("f0"))) * (F.col("t_us") - F.col("t0")))
    down = F.when(F.col("t2").isNull(), F.col("t_us") + F.coalesce(F.col("t_us") - F.col("t0"), F.lit(0))).when(F.col("fill") <= F.col("f2"), F.col("t2")).otherwise(
        F.col("t_us") + clip(F.try_divide(F.col("fill") - thr, F.col("fill") - F.col("f2"))) * (F.col("t2") - F.col("t_us")))
    on = ends.select(*LANE, F.col("frame").alias("first_frame"), F.rint(up).cast("bigint").alias("on_us"))
    off = ends.select(*LANE, F.col("frame").alias("last_frame"), F.rint(down).cast("bigint").alias("off_us"))
    return runs.join(on, [*LANE, "first_frame"]).join(off, [*LANE, "last_frame"])


def in_runs(runs: DataFrame, lane: DataFrame) -> DataFrame:
    """The lane's frames that are inside a run, with first_frame and last_frame.

    The last run that has begun is the only one that a frame can be in, so one sorted
    pass finds it; runs and frames are never paired by range.
    """
    begins = runs.select(*LANE, F.col("first_frame").alias("frame"), F.struct("first_frame", "last_frame").alias("__run"))
    rows = lane.join(begins, [*LANE, "frame"], "left").withColumn("__run", F.last("__run", ignorenulls=True).over(_order()))
    return rows.filter(F.col("frame") <= F.col("__run.last_frame")).select(*lane.columns, "__run.*")


def trough_splits(runs: DataFrame, lane: DataFrame, frame_us: int = 16_667, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, first_frame, frame, t_us: troughs of the fill inside a run that are a new strike.

    A trough is at most 0.6 of the lower of the levels before and behind it, the
    level behind at least 0.85 of the one before, and far enough from the last split.
    """
    apart = max(config.min_run, 2, round(config.restrike_us / frame_us))
    reach = max(3, apart + 1)
    run = Window.partitionBy(*LANE, "first_frame").orderBy("frame")
    rows = in_runs(runs, lane).withColumns({
        "__pre": F.max("fill").over(run.rowsBetween(-reach, 0)), "__post": F.max("fill").over(run.rowsBetween(0, reach)),
        "__f0": F.lag("fill").over(run), "__f2": F.lead("fill").over(run),
    })
    base = F.least("__pre", "__post")
    low = (F.col("fill") <= F.col("__f0")) & (F.col("fill") < F.col("__f2")) & (base > 0) & (F.col("fill") <= config.trough_dip * base) & (F.col("__post") >= config.trough_rise * F.col("__pre"))
    found = rows.filter(low & (F.col("last_frame") - F.col("first_frame") + 1 >= 2 * apart))
    listed = found.groupBy(*LANE, "first_frame").agg(F.sort_array(F.collect_list(F.struct("frame", "t_us"))).alias("xs"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        far = x["frame"] - last >= apart
        return F.when(far, x["frame"]).otherwise(last), F.when(far, x)

    kept = emitted(F.col("xs"), F.col("first_frame"), step, "struct<frame:int,t_us:bigint>")
    return listed.select(*LANE, "first_frame", F.explode(kept).alias("x")).select(*LANE, "first_frame", "x.*")


def tripwire_edges(runs: DataFrame, lane: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, first_frame, frame, t_us: rises of the tripwire inside a run, behind its first frame."""
    before = F.lag("trip").over(_order())
    rows = in_runs(runs, lane.withColumn("__before", before))
    return rows.filter((F.col("frame") > F.col("first_frame")) & (F.col("trip") >= config.fill) & (F.col("__before") < config.fill)).select(*LANE, "first_frame", "frame", "t_us")


def dedupe(events: DataFrame, gap_us: int = DEFAULT.restrike_us) -> DataFrame:
    """recording_id, midi, t_us: events of a lane at least gap_us behind the last one kept."""
    # an event that far behind the one before is kept whatever was kept before
    rows = chains(events.select(*LANE, "t_us"), "t_us", gap_us - 1, LANE).groupBy(*LANE, "__chain").agg(F.sort_array(F.collect_list("t_us")).alias("xs"))
    return rows.select(*LANE, F.explode(spaced(F.col("xs"), gap_us)).alias("t_us"))


def lane_notes(lane: DataFrame, attacks: DataFrame | None = None, frame_us: int = 16_667, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, start_us, end_us, color_cluster, peak_fill, restrike, and detection, pitch, timing and duration confidence: the notes of lit keys.

    Islands with sub-frame ends, split at troughs and at tripwire edges (those near
    an attack, where there are attacks), with hits closer than a restrike joined.
    """
    from cadenza.operators.matching import nearest

    runs = subframe_edges(light_islands(lane, frame_us, config), lane, config)
    keys = [*LANE, "first_frame"]
    edges = tripwire_edges(runs.select(*LANE, "first_frame", "last_frame"), lane, config)
    if attacks is not None:
        edges = nearest(edges, attacks, "t_us", "attack_us").filter(F.abs(F.col("nearest_us") - F.col("t_us")) <= config.skew_window_us).drop("nearest_us")
    splits = trough_splits(runs.select(*LANE, "first_frame", "last_frame"), lane, frame_us, config).unionByName(edges)
    gap = max(frame_us * max(config.min_run, 2), config.restrike_us)
    listed = splits.groupBy(*keys).agg(spaced(F.sort_array(F.collect_list("t_us")), gap).alias("at"))
    inside = in_runs(runs.select(*LANE, "first_frame", "last_frame"), lane).groupBy(*keys).agg(F.max("fill").alias("peak_fill"), F.mode(F.when(F.col("lit") >= 0, F.col("lit")), True).alias("color_cluster"))
    rows = runs.join(listed, keys, "left").join(inside, keys)
    far = F.filter(F.coalesce("at", F.expr("cast(array() as array<bigint>)")), lambda s: (s - F.col("on_us") >= config.restrike_us) & (F.col("off_us") - s >= config.restrike_us))
    rows = rows.withColumn("at", far).withColumn("bounds", F.concat(F.array("on_us"), "at", F.array("off_us")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda i: F.struct(F.element_at("bounds", i).alias("s"), F.element_at("bounds", i + 1).alias("e")))
    parts = rows.withColumn("p", F.explode(F.filter(pairs, lambda p: p["e"] - p["s"] >= frame_us * 0.5)))
    sure = F.greatest(F.lit(0.5), F.least(F.lit(1.0), (F.col("last_frame") - F.col("first_frame") + 1) / 4))
    hit = F.struct(F.col("p.s").alias("s"), F.col("p.e").alias("e"), "color_cluster", "peak_fill", sure.alias("sure"), (F.size("at") > 0).alias("again"))
    near = chains(parts.withColumn("__s", F.col("p.s")), "__s", config.restrike_us - 1, LANE)
    hits = near.groupBy(*LANE, "__chain").agg(F.sort_array(F.collect_list(hit)).alias("xs"))

    def join(p: Column, x: Column) -> tuple[Column, Column]:
        grown = F.struct(p["s"].alias("s"), F.greatest(p["e"], x["e"]).alias("e"), p["color_cluster"].alias("color_cluster"), p["peak_fill"].alias("peak_fill"), p["sure"].alias("sure"), p["again"].alias("again"))
        close = F.coalesce(x["s"] - p["s"] < config.restrike_us, F.lit(False))
        return F.when(close, grown).otherwise(x), F.when(~close, p)

    kind = "struct<s:bigint,e:bigint,color_cluster:int,peak_fill:double,sure:double,again:boolean>"
    joined = hits.select(*LANE, F.explode(emitted(F.col("xs"), F.lit(None).cast(kind), join, kind, lambda p: p)).alias("x"))
    return joined.select(*LANE, F.col("x.s").alias("start_us"), F.col("x.e").alias("end_us"), "x.color_cluster", "x.peak_fill", F.col("x.sure").alias("detection_confidence"), F.lit(1.0).alias("pitch_confidence"), F.lit(0.7).alias("timing_confidence"), F.lit(0.8).alias("duration_confidence"), F.col("x.again").alias("restrike"))


def attach_lanes(notes: DataFrame, layout: DataFrame) -> DataFrame:
    """notes with lane_x, the centre of their pitch's lane, null where the layout has none; layout is one keyboard of at most 128 rows."""
    lanes_ = layout.groupBy("midi").agg(F.min("center").alias("lane_x"))
    return notes.drop("lane_x").join(F.broadcast(lanes_), "midi", "left").select(*(c for c in notes.columns if c != "lane_x"), "lane_x")


def fall_speed(edges: DataFrame, strike: float, band: float = 0.02) -> DataFrame:
    """recording_id, speed (pixels a second): median slope of falling edges (recording_id, midi, frame, t_us, y).

    A segment is at least 5 frames in which y grows by at most 15 % of the strike line
    a step.  The longest segments count, if there are 5 of them.
    """
    w = _order()
    step = F.col("y") - F.lag("y").over(w)
    rows = edges.filter(F.col("y") > band * strike).withColumn("__new", F.coalesce((step <= 0) | (step > 0.15 * strike), F.lit(True)))
    rows = rows.withColumn("segment", F.sum(F.col("__new").cast("int")).over(w))
    lines = rows.groupBy(*LANE, "segment").agg(F.count("*").alias("n"), F.regr_slope("y", F.col("t_us") / 1e6).alias("slope"), (F.max("y") - F.min("y")).alias("span")).filter("n >= 5 and slope > 1")
    found = lines.groupBy("recording_id").agg(
        *(F.median(F.when(F.col("span") >= s * strike, F.col("slope"))).alias(f"m{i}") for i, s in enumerate((0.3, 0.2, 0.1, 0.0))),
        *(F.count_if(F.col("span") >= s * strike).alias(f"n{i}") for i, s in enumerate((0.3, 0.2, 0.1))),
    )
    best = F.coalesce(*(F.when(F.col(f"n{i}") >= 5, F.col(f"m{i}")) for i in range(3)), F.col("m3"), F.lit(0.5 * strike))
    return edges.select("recording_id").distinct().join(found, "recording_id", "left").select("recording_id", best.alias("speed"))


def hit_level(edges: DataFrame, strike: float) -> DataFrame:
    """recording_id, level: the 90th percentile of the peaks of y in the lowest fifth, the strike line with fewer than 20."""
    w = _order()
    rows = edges.withColumns({"__b": F.lag("y").over(w), "__a": F.lead("y").over(w)})
    peaks = rows.filter((F.col("y") >= 0.8 * strike) & (F.col("y") >= F.col("__b")) & (F.col("y") >= F.col("__a")))
    found = peaks.groupBy("recording_id").agg(F.count("*").alias("n"), F.percentile("y", F.lit(0.9)).alias("p"))
    return edges.select("recording_id").distinct().join(found, "recording_id", "left").select("recording_id", F.when(F.col("n") >= 20, F.col("p")).otherwise(F.lit(strike)).alias("level"))
