"""Refinement passes over notes: merging, aligning, trimming, dropping.

Each pass is a pure function of its input; times are integer microseconds, and
every order ends in note_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Config
from cadenza.operators.folds import anchored_groups, carried, chains, emitted
from cadenza.operators.matching import nearest


def trim_same_pitch(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Ends a note a millisecond before the next one of its key, and drops what is then too short (never the last)."""
    key = Window.partitionBy("recording_id", "midi").orderBy("start_us", "note_id")
    rows = notes.withColumn("__next", F.lead("start_us").over(key))
    rows = rows.withColumn("end_us", F.when(F.col("__next").isNotNull(), F.least("end_us", F.col("__next") - config.trim_eps_us)).otherwise(F.col("end_us")))
    return rows.filter(F.col("__next").isNull() | (F.col("end_us") - F.col("start_us") >= config.drop_min_us)).drop("__next")


def merge_fragments(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, midi, note_id, start_us, end_us, detection_confidence, is_restrike, parts: a key's fragments merged in order.

    A note joins the last merged one (with the end that it has by then) if they
    overlap, if a short one is near, or if they touch; a restrike never joins.
    """
    # a note that starts merge_gap_us behind all ends so far joins nothing: it opens an island, and islands are folded apart
    key = Window.partitionBy("recording_id", "midi").orderBy("start_us", "note_id", "end_us")
    reached = F.max("end_us").over(key.rowsBetween(Window.unboundedPreceding, -1))
    rows = notes.withColumn("__new", F.coalesce(F.col("start_us") - reached >= max(config.merge_gap_us, config.continuous_us), F.lit(True)).cast("bigint"))
    rows = rows.withColumn("__island", F.sum("__new").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    x = F.struct("start_us", "note_id", "end_us", "detection_confidence", "is_restrike")
    rows = rows.groupBy("recording_id", "midi", "__island").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    kind = "struct<note_id:bigint,start_us:bigint,end_us:bigint,detection_confidence:double,is_restrike:boolean,parts:bigint>"

    def length(n: Column) -> Column:
        return F.greatest(F.lit(0), n["end_us"] - n["start_us"])

    def step(p: Column, n: Column) -> tuple[Column, Column]:
        """p is the note that is still open; it is given out by the one that doesn't join it."""
        gap = n["start_us"] - p["end_us"]
        joins = (gap < 0) | ((gap < config.merge_gap_us) & (F.least(length(n), length(p)) < config.sliver_us)) | ((gap > -config.far_overlap_us) & (gap < config.continuous_us))
        joins = F.coalesce(joins & ~p["is_restrike"] & ~n["is_restrike"], F.lit(False))
        grown = F.struct(p["note_id"].alias("note_id"), p["start_us"].alias("start_us"), F.greatest(p["end_us"], n["end_us"]).alias("end_us"),
                         F.greatest(p["detection_confidence"], n["detection_confidence"]).alias("detection_confidence"), p["is_restrike"].alias("is_restrike"), (p["parts"] + 1).alias("parts"))
        fresh = F.struct(n["note_id"].alias("note_id"), n["start_us"].alias("start_us"), n["end_us"].alias("end_us"), n["detection_confidence"].alias("detection_confidence"), n["is_restrike"].alias("is_restrike"), F.lit(1).cast("bigint").alias("parts"))
        return F.when(joins, grown).otherwise(fresh), F.when(~joins, p)

    folded = emitted(F.col("xs"), F.lit(None).cast(kind), step, kind, lambda p: p)
    merged = rows.select("recording_id", "midi", F.explode(folded).alias("n")).select("recording_id", "midi", "n.*")
    return merged.filter(F.col("end_us") - F.col("start_us") >= config.drop_min_us)


def chord_groups(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes with group_no: onsets within the chord window of the group's first."""
    return anchored_groups(notes, "start_us", config.chord_window_us, "note_id", ties=("midi",))


def align_chords(notes: DataFrame, attacks: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """notes with start_us and end_us moved to their group's onset, and moved.

    The onset is the group's median, or the attack nearest to it within the
    window.  Members are placed from the nearest to it outward; one within two
    semitones of a placed one stays, as does one that ends before the onset.
    """
    grouped = chord_groups(notes, config)
    x = F.struct("start_us", "midi", "note_id", "end_us")
    groups = grouped.groupBy("recording_id", "group_no").agg(F.floor(F.median("start_us")).cast("bigint").alias("target"), F.collect_list(x).alias("xs")).filter(F.size("xs") >= 2)
    if attacks is not None:
        groups = nearest(groups, attacks, "target", "attack_us")
        near = F.abs(F.col("nearest_us") - F.col("target")) <= config.chord_window_us
        groups = groups.withColumn("target", F.when(near, F.col("nearest_us")).otherwise(F.col("target")))
    order = F.array_sort(F.transform("xs", lambda n: F.struct(F.abs(n["start_us"] - F.col("target")).alias("d"), n["start_us"].alias("start_us"), n["midi"].alias("midi"), n["note_id"].alias("note_id"), n["end_us"].alias("end_us"))))
    start = F.expr("named_struct('placed', cast(array() as array<int>), 'out', cast(array() as array<bigint>))")

    def step(acc: Column, n: Column) -> Column:
        taken = F.exists(acc["placed"], lambda p: F.abs(n["midi"] - p) <= config.semitone_guard)
        still = n["d"] <= config.still_us
        moves = ~taken & ~still & (F.col("target") < n["end_us"])
        placed = F.when(~taken & (still | moves), F.array_append(acc["placed"], n["midi"])).otherwise(acc["placed"])
        return F.struct(placed.alias("placed"), F.when(moves, F.array_append(acc["out"], n["note_id"])).otherwise(acc["out"]).alias("out"))

    moved = groups.select("recording_id", F.col("target").alias("__to"), F.explode(F.aggregate(order, start, step, lambda acc: acc["out"])).alias("note_id"))
    rows = notes.join(moved, ["recording_id", "note_id"], "left")
    went = F.col("__to").isNotNull()
    return rows.withColumns({
        "end_us": F.when(went, F.col("__to") + F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).otherwise(F.col("end_us")),
        "start_us": F.coalesce("__to", "start_us"),
        "moved": went,
    }).drop("__to")


def align_releases(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes with end_us moved to the median end of their group of near ends, and duration_confidence raised where it moved."""
    grouped = anchored_groups(notes, "end_us", config.release_window_us, "note_id")
    group = Window.partitionBy("recording_id", "group_no")
    target = F.floor(F.median("end_us").over(group)).cast("bigint")
    rows = grouped.withColumn("__to", target).withColumn("__n", F.count("*").over(group))
    moves = (F.col("__n") >= 2) & (F.abs(F.col("end_us") - F.col("__to")) > config.still_us) & (F.col("__to") - F.col("start_us") >= config.release_min_us)
    return rows.withColumn("moved", moves).withColumns({
        "end_us": F.when(F.col("moved"), F.col("__to")).otherwise(F.col("end_us")),
        "duration_confidence": F.when(F.col("moved"), F.least(F.lit(1.0), F.greatest("duration_confidence", F.lit(0.8)))).otherwise(F.col("duration_confidence")),
    }).drop("__to", "__n", "group_no")


def duration_clusters(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, centers array<bigint>: medians of clusters of durations with enough members, where a recording has enough notes.

    A cluster holds durations up to a tenth above its shortest.
    """
    d = F.greatest(F.lit(100), F.col("end_us") - F.col("start_us")).cast("bigint")
    enough = notes.groupBy("recording_id").agg(F.count("*").alias("__all")).filter(F.col("__all") >= 2 * config.duration_members).select("recording_id")
    sizes = notes.select("recording_id", d.alias("d")).groupBy("recording_id", "d").agg(F.count("*").alias("n"))
    # a duration a tenth beyond the one before begins a cluster whatever the anchor, so chains of near ones are folded apart
    w = Window.partitionBy("recording_id").orderBy("d")
    apart = F.coalesce(F.col("d") > F.lag("d").over(w) * (1.0 + config.duration_tol), F.lit(False)).cast("bigint")
    near = sizes.withColumn("__apart", apart).withColumn("__chain", F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = near.groupBy("recording_id", "__chain").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("xs"))

    def step(anchor: Column, x: Column) -> tuple[Column, Column]:
        own = F.when(x["d"] <= anchor * (1.0 + config.duration_tol), anchor).otherwise(x["d"])
        return own, F.struct(own.alias("anchor"), x["d"].alias("d"), x["n"].alias("n"))

    placed = listed.select("recording_id", F.explode(emitted(F.col("xs"), F.lit(None).cast("bigint"), step, "struct<anchor:bigint,d:bigint,n:bigint>")).alias("x")).select("recording_id", "x.*")
    clusters = placed.groupBy("recording_id", "anchor").agg(F.sum("n").alias("n"), F.floor(F.percentile("d", F.lit(0.5), F.col("n"))).cast("bigint").alias("center")).filter(F.col("n") >= config.duration_members)
    return clusters.join(enough, "recording_id").groupBy("recording_id").agg(F.array_sort(F.collect_list("center")).alias("centers"))


def consolidate_durations(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes whose duration is within a tenth of the nearest cluster's take it over; moved, and duration_confidence raised."""
    rows = notes.join(duration_clusters(notes, config), "recording_id", "left")
    d = F.col("end_us") - F.col("start_us")
    center = F.array_min(F.transform("centers", lambda c: F.struct(F.abs(c - d).alias("away"), c.alias("c"))))
    rows = rows.withColumn("__c", center["c"])
    moves = F.coalesce((F.abs(F.col("__c") - d) <= config.duration_tol * F.col("__c")) & (F.abs(F.col("__c") - d) > config.still_us), F.lit(False))
    return rows.withColumn("moved", moves).withColumns({
        "end_us": F.when(F.col("moved"), F.col("start_us") + F.col("__c")).otherwise(F.col("end_us")),
        "duration_confidence": F.when(F.col("moved"), F.least(F.lit(1.0), F.greatest("duration_confidence", F.lit(0.85)))).otherwise(F.col("duration_confidence")),
    }).drop("__c", "centers")


def drop_silent_short(notes: DataFrame, attacks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes without the short ones that no attack is near; restrikes stay, and all notes of a recording without attacks."""
    rows = nearest(notes, attacks, "start_us", "attack_us")
    short = (F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")) <= config.silent_max_us) & ~F.col("is_restrike")
    far = F.abs(F.col("nearest_us") - F.col("start_us")) > config.silent_tol_us
    return rows.filter(~F.coalesce(short & far, F.lit(False))).drop("nearest_us")


def av_skew(notes: DataFrame, attacks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, matches, skew_us (median of note minus nearest attack, within the window), applied_us (0 if too small or too few)."""
    rows = nearest(notes, attacks, "start_us", "attack_us").withColumn("d", F.col("start_us") - F.col("nearest_us"))
    skew = F.floor(F.median(F.when(F.abs("d") <= config.skew_window_us, F.col("d")))).cast("bigint")
    found = rows.groupBy("recording_id").agg(F.count_if(F.abs("d") <= config.skew_window_us).alias("matches"), skew.alias("skew_us"))
    good = (F.col("matches") >= config.skew_matches) & (F.abs("skew_us") >= config.skew_min_us)
    return found.withColumn("applied_us", F.when(good, F.col("skew_us")).otherwise(F.lit(0)).cast("bigint"))


def snap_tolerance(attacks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """recording_id, tolerance_us from the median gap between attacks."""
    gap = F.col("attack_us") - F.lag("attack_us").over(Window.partitionBy("recording_id").orderBy("attack_us"))
    rows = attacks.withColumn("gap", gap).groupBy("recording_id").agg(F.median("gap").alias("gap"), F.count("*").alias("n"))
    clipped = F.greatest(F.lit(config.snap_low_us), F.least(F.lit(config.snap_high_us), F.floor(config.snap_share * F.col("gap"))))
    return rows.select("recording_id", F.when(F.col("n") >= 3, clipped).otherwise(F.lit(config.snap_default_us)).cast("bigint").alias("tolerance_us"))


def snap_onsets(notes: DataFrame, attacks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes with onsets moved to attacks, in the order of their starts; snapped, and timing_confidence raised.

    A note takes the nearest attack in reach that has no pitch within two semitones
    and whose first note was struck within 45 ms of it.  What an attack holds crosses
    pitches, so claims in reach are carried along a chain of notes: candidate lists are
    joined first by time buckets, only notes that have a candidate are looked at, and a
    gap that no attack's reach spans from both sides splits a recording.
    """
    reach = attacks.join(snap_tolerance(attacks, config), "recording_id")
    width = config.snap_high_us
    near = notes.withColumn("__b", F.explode(F.array(*(F.floor(F.col("start_us") / width) + k for k in (-1, 0, 1))))).join(
        reach.withColumn("__b", F.floor(F.col("attack_us") / width)).distinct(), ["recording_id", "__b"])
    near = near.filter((F.col("attack_us") >= F.col("start_us") - F.col("tolerance_us")) & (F.col("attack_us") < F.col("start_us") + F.col("tolerance_us")))
    listed = near.groupBy("recording_id", "note_id").agg(
        F.first("start_us").alias("start_us"), F.first("midi").alias("midi"),
        F.array_sort(F.collect_set(F.struct(F.abs(F.col("attack_us") - F.col("start_us")).alias("d"), "attack_us"))).alias("options"),
    )
    listed = chains(listed, "start_us", 2 * width, ties=("midi", "note_id"))

    def step(claims, start_us, midi, options):
        live = [c for c in claims if c[0] >= start_us - width]  # placed (attack, pitch, first claimant's start), those in reach

        def free(attack: int) -> bool:
            return not any(a == attack and (abs(m - midi) <= config.semitone_guard or abs(start_us - s) > config.together_us) for a, m, s in live)

        pick = next((o["attack_us"] for o in options if free(o["attack_us"])), None)
        if pick is not None:
            live.append((pick, midi, min((s for a, _, s in live if a == pick), default=start_us)))
        return live, (pick,)

    moves = carried(listed, ("recording_id", "__chain"), ("start_us", "midi", "note_id"), ("note_id",), ("start_us", "midi", "options"), list, step, "to bigint")
    moves = moves.select("recording_id", "note_id", F.col("to").alias("__to"))
    rows = notes.join(moves, ["recording_id", "note_id"], "left")
    went = F.coalesce(F.abs(F.col("__to") - F.col("start_us")) > config.still_us, F.lit(False))
    return rows.withColumn("snapped", went).withColumns({
        "end_us": F.when(F.col("snapped"), F.col("__to") + F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).otherwise(F.col("end_us")),
        "start_us": F.when(F.col("snapped"), F.col("__to")).otherwise(F.col("start_us")),
        "timing_confidence": F.when(F.col("snapped"), F.least(F.lit(1.0), F.greatest("timing_confidence", F.lit(0.9)))).otherwise(F.col("timing_confidence")),
    }).drop("__to")


def _neighbours(notes: DataFrame, value: str, config: Config) -> tuple[DataFrame, Column]:
    """Rows of other notes keyed by each pitch one or two semitones away, and the overlap condition with a note."""
    away = F.explode(F.array(*(F.col("midi") + k for k in (-2, -1, 1, 2))))
    other = notes.select("recording_id", away.alias("midi"), F.col("start_us").alias("o_start"), F.col("end_us").alias("o_end"), F.col(value).alias("o_value"))
    overlap = F.least("end_us", "o_end") - F.greatest("start_us", "o_start")
    return other, 2 * overlap > F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))


def _without(notes: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """notes without those with a neighbour on their pitch that meets the condition.

    Both stand in every time bucket that they reach into, so a note meets what is near
    it and not all of its pitch.
    """
    width = 2_000_000

    def bucketed(rows: DataFrame, start: str, end: str) -> DataFrame:
        return rows.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))

    n = bucketed(notes, "start_us", "end_us").alias("n")
    o = bucketed(other, "o_start", "o_end").alias("o")
    same = (F.col("n.recording_id") == F.col("o.recording_id")) & (F.col("n.midi") == F.col("o.midi")) & (F.col("n.__bucket") == F.col("o.__bucket"))
    gone = n.join(o, same & condition, "left_semi").select("recording_id", "note_id").distinct()
    return notes.join(gone, ["recording_id", "note_id"], "left_anti")


def drop_glow_bleed(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes without the dim ones beside a clearly brighter note that they overlap by more than half.

    An anti-join on recording and pitch: neighbours are exploded to the four pitches they bleed to.
    """
    other, over = _neighbours(notes, "peak_fill", config)
    return _without(notes, other, over & (F.col("peak_fill") <= config.bleed_fill) & (F.col("o_value") >= F.col("peak_fill") + config.bleed_brighter))


def drop_bloom(notes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes without those that no falling bar supports, beside a supported note that they overlap by more than half."""
    other, over = _neighbours(notes, "roll_support", config)
    mine, theirs = F.col("roll_support"), F.col("o_value")
    none = (mine < config.roll_support) & (theirs >= config.roll_support)
    weak = (theirs >= config.roll_strong) & (mine < config.roll_relative * theirs)
    return _without(notes, other, over & (none | weak))


def roll_support(notes: DataFrame, lane: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """notes with roll_support: the most that its lane's roll shows between 1 s and 50 ms before it, 0 without frames.

    A range join on (recording, pitch) in buckets of the window's length.
    """
    low, high = config.roll_lead_us
    width = high - low
    mine = notes.drop("roll_support").withColumn("__b", F.explode(F.array(F.floor((F.col("start_us") - high) / width), F.floor((F.col("start_us") - high) / width) + 1)))
    frames = lane.select("recording_id", "midi", "t_us", "roll").withColumn("__b", F.floor(F.col("t_us") / width))
    hits = mine.join(frames, ["recording_id", "midi", "__b"]).filter((F.col("t_us") >= F.col("start_us") - high) & (F.col("t_us") <= F.col("start_us") - low))
    best = hits.groupBy("recording_id", "note_id").agg(F.max("roll").alias("roll_support"))
    return notes.drop("roll_support").join(best, ["recording_id", "note_id"], "left").withColumn("roll_support", F.greatest(F.lit(0.0), F.coalesce("roll_support", F.lit(0.0))))


def correct(notes: DataFrame, edits: DataFrame, deleted: DataFrame) -> DataFrame:
    """notes with a user's edits (null columns keep the value) and without the deleted ones; manually_corrected."""
    keys = ["recording_id", "note_id"]
    changed = [c for c in edits.columns if c not in keys]
    rows = notes.join(deleted, keys, "left_anti").join(edits.select(*keys, *(F.col(c).alias(f"__{c}") for c in changed), F.lit(True).alias("__edited")), keys, "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in changed} | {"manually_corrected": F.coalesce("__edited", F.lit(False))}).drop("__edited", *(f"__{c}" for c in changed))


def renumber(notes: DataFrame) -> DataFrame:
    """notes with id 1, 2, ... by start and pitch within a recording."""
    return notes.withColumn("id", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_us", "midi", "note_id")))
