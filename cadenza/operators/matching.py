"""Matching in time: nearest attacks, bars in view, lanes against lanes, notes against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.functions.note import bar, sounding
from cadenza.operators.folds import carried


def nearest(left: DataFrame, right: DataFrame, at: str, other: str, by: str = "recording_id", name: str = "nearest_us") -> DataFrame:
    """left with the value of right's `other` nearest to left's `at` in the same `by`; the earlier of two equally near ones, null without any.

    One sort of both sides together and two window functions: no pairs are made,
    however many rows a side has within reach.
    """
    mine = left.select("*", F.col(at).alias("__t"), F.lit(None).cast("bigint").alias("__o"), F.lit(1).alias("__side"))
    columns = [F.lit(None).cast(t).alias(n) for n, t in left.dtypes if n != by]
    theirs = right.filter(F.col(other).isNotNull()).select(F.col(by), *columns, F.col(other).alias("__t"), F.col(other).alias("__o"), F.lit(0).alias("__side"))
    both = mine.unionByName(theirs.select(mine.columns))
    behind = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    # from the end backward: a frame that ends at a partition's end is computed anew for each row
    ahead = Window.partitionBy(by).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last("__o", ignorenulls=True).over(behind), F.last("__o", ignorenulls=True).over(ahead)
    picked = F.when(after.isNull() | (F.col("__t") - before <= after - F.col("__t")), before).otherwise(after)
    return both.withColumn(name, picked).filter("__side = 1").select(*left.columns, name)


def within(left: DataFrame, right: DataFrame, at: str, other: str, tolerance_us: int, by: str = "recording_id") -> DataFrame:
    """Pairs with at - tolerance <= other < at + tolerance: an equi-join on time buckets of that width, then the range."""
    bucket = F.floor((F.col(at) - tolerance_us) / tolerance_us)
    near = left.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1, bucket + 2)))
    far = right.select(by, other).withColumn("__bucket", F.floor(F.col(other) / tolerance_us))
    return near.join(far, [by, "__bucket"]).filter((F.col(other) >= F.col(at) - tolerance_us) & (F.col(other) < F.col(at) + tolerance_us)).drop("__bucket")


def visible_bars(notes: DataFrame, times: DataFrame, strike: float = 600.0, speed: float = 320.0) -> DataFrame:
    """recording_id, t_us, midi, note_id, top, bottom: of each pitch the last note whose bar is in view.

    A bar is in view for strike / speed seconds before its note and until it ends,
    so notes meet times in buckets of that length.
    """
    width = int(strike / speed * 1e6)
    first, last = F.floor((F.col("start_us") - width) / width), F.floor(F.col("end_us") / width)
    spread = notes.withColumn("__bucket", F.explode(F.sequence(first, last)))
    moments = times.withColumn("__bucket", F.floor(F.col("t_us") / width))
    seen = spread.join(moments, ["recording_id", "__bucket"]).withColumn("bar", bar(F.col("t_us"), strike, speed)).filter("bar is not null")
    return seen.groupBy("recording_id", "t_us", "midi").agg(F.max(F.struct("start_us", "note_id", "bar")).alias("x")).select(
        "recording_id", "t_us", "midi", F.col("x.note_id").alias("note_id"), F.col("x.bar.top").alias("top"), F.col("x.bar.bottom").alias("bottom")
    )


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two spans, 0 for an empty union."""
    inside = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, inside / union).otherwise(0.0)


def compare_lanes(predicted: DataFrame, detected: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, t_us, matched, missing array<int>, false_positive array<int> of lanes with spans top, bottom.

    A detected lane whose predicted span overlaps too little is missing, as is one
    that nothing predicted.
    """
    keys = ["recording_id", "t_us", "midi"]
    p = predicted.select(*keys, F.col("top").alias("p0"), F.col("bottom").alias("p1"))
    d = detected.select(*keys, F.col("top").alias("d0"), F.col("bottom").alias("d1"))
    both = p.join(d, keys, "full_outer")
    good = F.col("p0").isNotNull() & F.col("d0").isNotNull() & (iou(F.col("p0"), F.col("p1"), F.col("d0"), F.col("d1")) >= config.iou)
    return both.groupBy("recording_id", "t_us").agg(
        F.count_if(good).alias("matched"),
        F.array_sort(F.collect_list(F.when(F.col("d0").isNotNull() & ~F.coalesce(good, F.lit(False)), F.col("midi")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("d0").isNull(), F.col("midi")))).alias("false_positive"),
    )


def greedy_truth(notes: DataFrame, truth: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, note_id, truth_id, onset_us, duration_us: notes in the order of their start each take the nearest unused truth.

    Notes meet the truths in reach in time buckets, and each pitch of a recording is
    gone along in order, with the used truths in reach carried on.
    """
    tolerance = config.truth_tol_us
    bucket = F.floor(F.col("start_us") / tolerance)
    mine = notes.select("recording_id", "midi", "note_id", "start_us", "end_us", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    theirs = truth.select("recording_id", "midi", "truth_id", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"), bucket.alias("__b"))
    away = F.abs(F.col("t_start") - F.col("start_us"))
    near = mine.join(theirs, ["recording_id", "midi", "__b"]).filter(away < tolerance)
    option = F.struct(away.alias("away"), "t_start", "truth_id", "t_end")
    listed = near.groupBy("recording_id", "midi", "note_id", "start_us", "end_us").agg(F.array_sort(F.collect_list(option)).alias("options"))

    def step(used, start_us, end_us, options):
        used = {t: at for t, at in used.items() if at > start_us - tolerance}
        o = next((o for o in options if o["truth_id"] not in used), None)
        if o is None:
            return used, (None, None, None)
        used[o["truth_id"]] = o["t_start"]
        return used, (o["truth_id"], o["away"], abs(o["t_end"] - o["t_start"] - max(0, end_us - start_us)))

    kinds = "truth_id bigint, onset_us bigint, duration_us bigint"
    found = carried(listed, ("recording_id", "midi"), ("start_us", "note_id", "end_us"), ("note_id",), ("start_us", "end_us", "options"), dict, step, kinds)
    return found.filter(F.col("truth_id").isNotNull())


def accuracy(notes: DataFrame, truth: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, true_positive, false_positive, false_negative, precision, recall, f1 and mean errors in ms."""
    found = greedy_truth(notes, truth, config).groupBy("recording_id").agg(F.count("*").alias("tp"), F.avg("onset_us").alias("onset"), F.avg("duration_us").alias("duration"))
    sizes = notes.groupBy("recording_id").agg(F.count("*").alias("n"))
    wanted = truth.groupBy("recording_id").agg(F.count("*").alias("m"))
    rows = sizes.join(wanted, "recording_id", "full_outer").join(found, "recording_id", "left").na.fill(0, ["n", "m", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "m"), F.lit(0.0))
    rows = rows.withColumn("p", p).withColumn("r", r)
    return rows.select(
        "recording_id", F.col("tp").alias("true_positive"), (F.col("n") - F.col("tp")).alias("false_positive"), (F.col("m") - F.col("tp")).alias("false_negative"),
        F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 4).alias("f1"),
        F.round(F.col("onset") / 1000, 2).alias("mean_onset_error_ms"), F.round(F.col("duration") / 1000, 2).alias("mean_duration_error_ms"),
    )


def hit_test(notes: DataFrame, points: DataFrame, slack_us: int = 20_000) -> DataFrame:
    """points (recording_id, midi, t_us) with note_id: the first note of that pitch at that time, give or take the slack; null without one.

    Notes and points meet in time buckets of two seconds.
    """
    width = 2_000_000
    first, last = F.floor((F.col("start_us") - slack_us) / width), F.floor((F.col("end_us") + slack_us) / width)
    n = notes.withColumn("__bucket", F.explode(F.sequence(first, last))).alias("n")
    p = points.withColumn("__bucket", F.floor(F.col("t_us") / width)).alias("p")
    same = (F.col("n.recording_id") == F.col("p.recording_id")) & (F.col("n.midi") == F.col("p.midi")) & (F.col("n.__bucket") == F.col("p.__bucket"))
    near = same & (F.col("p.t_us") >= F.col("n.start_us") - slack_us) & (F.col("p.t_us") <= F.col("n.end_us") + slack_us)
    hits = p.join(n, near).groupBy("p.recording_id", "p.midi", "p.t_us").agg(F.min(F.struct("n.start_us", "n.note_id")).alias("x"))
    return points.join(hits.select("recording_id", "midi", "t_us", F.col("x.note_id").alias("note_id")), ["recording_id", "midi", "t_us"], "left")


def sounding_at(notes: DataFrame, times: DataFrame) -> DataFrame:
    """Every note of the recording that sounds at a time (recording_id, t_us); they meet in time buckets of two seconds."""
    width = 2_000_000
    spread = notes.filter("end_us > start_us").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor(F.col("end_us") / width))))
    moments = times.select("recording_id", "t_us", F.floor(F.col("t_us") / width).alias("__bucket"))
    return spread.join(moments, ["recording_id", "__bucket"]).filter(sounding(F.col("t_us"))).drop("__bucket")


def triggered_at(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Each note with the move (recording_id, before_us, t_us) of playback that starts it: the next t_us at or behind its start.

    One sort of both sides together, so no pairs are made; the moves of a recording follow each other.
    """
    mine = notes.select("recording_id", "note_id", F.col("start_us").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("struct<before_us:bigint,t_us:bigint>").alias("__m"))
    theirs = moves.select("recording_id", F.lit(None).cast("bigint").alias("note_id"), F.col("t_us").alias("__t"), F.lit(1).alias("__side"), F.struct("before_us", "t_us").alias("__m"))
    ahead = Window.partitionBy("recording_id").orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs).withColumn("__m", F.last("__m", ignorenulls=True).over(ahead)).filter(F.col("note_id").isNotNull())
    return both.filter(F.col("__t") > F.col("__m.before_us")).select("recording_id", "note_id", "__m.*")


def nearest_lane(points: DataFrame, lanes: DataFrame, prefer_black: Column | None = None) -> DataFrame:
    """points (x) with midi and confidence: the lane whose centre is nearest, distances of the other colour counting 1.6 times.

    lanes is one keyboard, at most 128 rows, and travels as a broadcast array.
    """
    keys = lanes.agg(F.collect_list(F.struct("midi", "center", "half_width", "is_black")).alias("keys"))
    rows = points.crossJoin(F.broadcast(keys))
    bias = F.lit(1.0) if prefer_black is None else None

    def away(k: Column) -> Column:
        plain = F.abs(F.col("x") - k["center"])
        return plain * (bias if bias is not None else F.when(k["is_black"] != prefer_black, 1.6).otherwise(1.0))

    ranked = F.array_sort(F.transform("keys", lambda k: F.struct(away(k).alias("d"), k["midi"].alias("midi"), k["half_width"].alias("w"))))
    rows = rows.withColumn("__r", ranked)
    margin = (F.col("__r")[1]["d"] - F.col("__r")[0]["d"]) / F.col("__r")[0]["w"]
    return rows.select(*points.columns, F.col("__r")[0]["midi"].alias("midi"), F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.5 + 0.5 * margin)).alias("confidence"))
