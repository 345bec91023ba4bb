"""Packets of media containers: statistics, seeks, cues, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed bits of a packet's flags.
KEYFRAME, CONFIG, DISCONTINUITY, DISCARDABLE, CORRUPT, ENCRYPTED = 1, 2, 4, 8, 16, 32


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def track_stats(packets: DataFrame) -> DataFrame:
    return packets.groupBy("track_id").agg(F.count(F.lit(1)).alias("packets"), F.min("pts").alias("min_pts"), F.max("pts").alias("max_pts"), F.count_if(has(KEYFRAME)).alias("keyframes"), F.count_if(has(CORRUPT)).alias("corrupt"), F.sum("size").alias("bytes"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def durations(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """Three notions of duration in ms: the largest pts over 1000, each track by its own scale (1000 if unknown), and the largest pts by the scale of the first track."""
    longest = packets.groupBy("track_id").agg(F.max("pts").alias("p"))
    scaled = longest.join(F.broadcast(tracks), "track_id", "left").withColumn("s", F.coalesce("timescale", F.lit(1000)))
    primary = F.min_by("s", "track_id")
    got = scaled.agg(F.max("p").alias("p"), F.max(F.expr("case when s = 0 then 0 else p * 1000 div s end")).alias("inspected_ms"), primary.alias("s"))
    return got.select(F.expr("p div 1000").alias("probed_ms"), "inspected_ms", F.expr("p * 1000 div s").alias("playback_ms"))


def seek(packets: DataFrame, targets: DataFrame, keyframes: bool) -> DataFrame:
    """For each target (track_id, target) the packet of largest pts at or before it, the last of ties.

    Packets and targets are merged in one sort of each track's hour-long bands, and what a band
    doesn't hold comes from the bands before through one row for each band: no pairs are made.
    """
    band = lambda c: F.expr(f"{c} div {BAND}")
    p = packets.where(has(KEYFRAME)) if keyframes else packets
    p = p.select("track_id", F.col("pts").alias("at"), band("pts").alias("band"), F.lit(0).alias("kind"), F.struct("pts", "sequence").alias("hit"), F.lit(None).cast("long").alias("target"))
    t = targets.select("track_id", F.col("target").alias("at"), band("target").alias("band"), F.lit(1).alias("kind"), F.lit(None).cast("struct<pts:bigint,sequence:bigint>").alias("hit"), "target")
    within = Window.partitionBy("track_id", "band").orderBy("at", "kind", "hit").rowsBetween(Window.unboundedPreceding, 0)
    found = p.unionByName(t).withColumn("found", F.last("hit", True).over(within)).where("kind = 1")
    ends = p.groupBy("track_id", "band").agg(F.max("hit").alias("last"))
    bands = ends.select("track_id", "band", "last").unionByName(t.select("track_id", "band", F.lit(None).cast("struct<pts:bigint,sequence:bigint>").alias("last")).distinct()).groupBy("track_id", "band").agg(F.max("last").alias("last"))
    before = Window.partitionBy("track_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = bands.withColumn("carried", F.last("last", True).over(before)).select("track_id", "band", "carried")
    hit = F.coalesce("found", "carried")
    return found.join(carried, ["track_id", "band"]).select("track_id", "target", hit["pts"].alias("pts"), hit["sequence"].alias("sequence"))


#: Ticks of a band of a seek.
BAND = 90_000 * 3600


def recover_range(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """How many packets of the track must be decoded from the keyframe to each target, and their bytes.

    A running count and sum at both ends gives the range without listing it.
    """
    keys = seek(packets, targets, True).where("pts is not null").select("track_id", "target", F.col("pts").alias("from_pts"))
    per = packets.groupBy("track_id", "pts").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).withColumn("band", F.expr(f"pts div {BAND}"))
    held = per.groupBy("track_id", "band").agg(F.sum("n").alias("band_n"), F.sum("b").alias("band_b"))
    ahead = Window.partitionBy("track_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("track_id", "band", F.coalesce(F.sum("band_n").over(ahead), F.lit(0)).alias("before_n"), F.coalesce(F.sum("band_b").over(ahead), F.lit(0)).alias("before_b"))
    w = Window.partitionBy("track_id", "band").orderBy("pts").rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(carried, ["track_id", "band"]).withColumn("rn", F.col("before_n") + F.sum("n").over(w)).withColumn("rb", F.col("before_b") + F.sum("b").over(w))
    low = run.select("track_id", F.col("pts").alias("from_pts"), (F.col("rn") - F.col("n")).alias("n0"), (F.col("rb") - F.col("b")).alias("b0"))
    ends = seek(packets, targets, False).select("track_id", "target", F.col("pts").alias("to_pts"))
    high = run.select("track_id", F.col("pts").alias("to_pts"), F.col("rn").alias("n1"), F.col("rb").alias("b1"))
    return keys.join(low, ["track_id", "from_pts"]).join(ends, ["track_id", "target"]).join(high, ["track_id", "to_pts"]).select("track_id", "target", "from_pts", (F.col("n1") - F.col("n0")).alias("packets"), (F.col("b1") - F.col("b0")).alias("bytes"))


#: Sequence numbers of a band: windows run within bands of a track, and one row for each band carries over what lies before or behind.
RUN = 65_536


def banded(packets: DataFrame) -> DataFrame:
    """Adds band, number (of the packet in its track), before_b (bytes in the bands before), and the nearest packet and keyframes in the bands before and behind."""
    own = packets.withColumn("band", F.expr(f"sequence div {RUN}"))
    key = F.when(has(KEYFRAME), F.col("sequence"))
    held = own.groupBy("track_id", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("sequence").alias("last"), F.max(key).alias("last_key"), F.min(key).alias("first_key"))
    order = Window.partitionBy("track_id").orderBy("band")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = held.select(
        "track_id", "band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_n"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before_b"),
        F.max("last").over(before).alias("before_last"), F.max("last_key").over(before).alias("before_key"), F.min("first_key").over(behind).alias("behind_key"),
    )
    return own.join(carried, ["track_id", "band"]).withColumn("number", F.col("before_n") + F.row_number().over(within()) - 1)


def within(first: int | None = None, last: int | None = None):
    """The window of a band, or of some rows of it."""
    w = Window.partitionBy("track_id", "band").orderBy("sequence")
    return w if first is None else w.rowsBetween(first, last)


def cues(packets: DataFrame, every: int = 32) -> DataFrame:
    """Cue blocks of a track: one for each run of so many packets in sequence, and a shorter one at the end."""
    numbered = banded(packets).withColumn("cue", F.expr(f"number div {every}"))
    return numbered.groupBy("track_id", "cue").agg(F.count(F.lit(1)).alias("entries"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.max("pts").alias("max_pts"))


def bytes_before() -> Column:
    return F.col("before_b") + F.coalesce(F.sum("size").over(within(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(packets: DataFrame, header: int) -> DataFrame:
    """Number and byte offset of each packet in its track's file."""
    return banded(packets).select("track_id", "sequence", "number", (bytes_before() + header).alias("file_offset"))


def rescale(packets: DataFrame, to: int) -> DataFrame:
    """pts in ticks of another scale, truncated and not below 0, and in ms."""
    return packets.select("track_id", "sequence", F.expr(f"greatest(us * {to} div 1000000, 0)").alias("ticks"), F.expr("us div 1000").alias("ms"))


def accumulated(packets: DataFrame) -> DataFrame:
    """Synthetic pts: the sum of the durations (here sizes) of all packets before in the track."""
    return banded(packets).select("track_id", "sequence", bytes_before().alias("pts"))


def gop(spark: SparkSession, n: int, keyint: int) -> DataFrame:
    """Kind, anchors and place in encode order of the frames of a clip.

    Frames at the key interval are I, other even ones P, odd ones B if an anchor follows, else P. A B frame is
    encoded right after the anchor that follows it.
    """
    f = spark.range(n).select(F.col("id").alias("frame"))
    anchors = lambda c: (c % 2 == 0) | (c % keyint == 0)
    is_b = lambda c: ~anchors(c) & (c + 1 < n) & (c >= 0)
    here = F.col("frame")
    ahead = F.when(anchors(here + 1), here + 1).otherwise(here + 2)
    behind = F.when(anchors(here - 1), here - 1).otherwise(here - 2)
    kind = F.when(here % keyint == 0, "I").when(is_b(here), "B").otherwise("P")
    place = F.when(is_b(here), here + 1).otherwise(here - F.when(is_b(here - 1), 1).otherwise(0))
    return f.select("frame", kind.alias("kind"), F.when(kind != "I", behind).alias("prev_anchor"), F.when(kind == "B", ahead).alias("next_anchor"), place.alias("encode_at"))


def missing(packets: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (track_id, sequence) that no packet has."""
    return expected.join(packets.select("track_id", "sequence"), ["track_id", "sequence"], "left_anti")


def unsupported(tracks: DataFrame) -> DataFrame:
    """One row: tracks that can't be converted, by id, and whether all can."""
    bad = F.col("codec").isin("native_video", "native_audio", "pcm")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~bad, F.struct("track_id", F.concat_ws(":", F.col("track_id").cast("string"), "codec").alias("s"))))), lambda x: x["s"]), ", ")
    return tracks.agg(said.alias("unsupported"), F.count_if(~bad).alias("n"), (F.count_if(~bad) == 0).alias("convertible"))


def rate_control(packets: DataFrame, start: int, low: int, high: int, step: int, target: int, run: int = 4096) -> DataFrame:
    """Quality parameter of each track after its packets in order: a step up above the target size (three times it for keyframes), a step down below.

    A step and the clamp after it map x to min(h, max(l, x + a)), and so does any number of them. Runs of
    sequence numbers are folded to such a map in parallel, and only the maps of a track meet in one row.
    """
    goal = F.when(has(KEYFRAME), 3 * target).otherwise(target)
    d = F.when(F.col("size") > goal, step).when(F.col("size") < goal, -step).otherwise(0)
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    state = lambda a, lo, hi: F.struct(a.cast("int").alias("a"), lo.cast("int").alias("l"), hi.cast("int").alias("h"))
    own = packets.select("track_id", "sequence", F.expr(f"sequence div {run}").alias("part"), d.alias("d"))
    runs = own.groupBy("track_id", "part").agg(F.array_sort(F.collect_list(F.struct("sequence", "d"))).alias("own"))
    folded = F.aggregate("own", state(F.lit(0), F.lit(low), F.lit(high)), lambda s, x: state(s["a"] + x["d"], clamp(s["l"] + x["d"]), clamp(s["h"] + x["d"])))
    maps = runs.select("track_id", "part", F.size("own").alias("n"), folded.alias("m")).groupBy("track_id").agg(F.sum("n").cast("long").alias("packets"), F.array_sort(F.collect_list(F.struct("part", "m"))).alias("all"))
    final = F.aggregate("all", F.lit(start), lambda qp, x: F.least(x["m"]["h"], F.greatest(x["m"]["l"], qp + x["m"]["a"])))
    return maps.select("track_id", "packets", final.cast("long").alias("qp"))


def reference_slots(packets: DataFrame, slots: int = 16) -> DataFrame:
    """For each packet of a track in order: the packet before it since the last keyframe, that itself included, and how many references are held, at most so many."""
    own = banded(packets)
    keys = own.where(has(KEYFRAME)).groupBy("track_id", "band").agg(F.max("number").alias("k"))
    order = Window.partitionBy("track_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = own.select("track_id", "band").distinct().join(keys, ["track_id", "band"], "left").select("track_id", "band", F.max("k").over(order).alias("before_k"))
    here = F.last(F.when(has(KEYFRAME), F.col("number")), True).over(within(Window.unboundedPreceding, 0))
    since = F.col("number") - F.coalesce(here, "before_k", F.lit(0))
    nearest = F.when(~has(KEYFRAME), F.coalesce(F.lag("sequence").over(within()), "before_last"))
    return own.join(bands, ["track_id", "band"]).select("track_id", "sequence", nearest.alias("nearest"), F.least(since, F.lit(slots)).cast("long").alias("held"))


def neighbours(packets: DataFrame) -> DataFrame:
    """The keyframes before and after each packet of a track, not itself."""
    key = F.when(has(KEYFRAME), F.col("sequence"))
    before = F.last(key, True).over(within(Window.unboundedPreceding, -1))
    after = F.first(key, True).over(within(1, Window.unboundedFollowing))
    return banded(packets).select("track_id", "sequence", F.coalesce(before, "before_key").alias("before"), F.coalesce(after, "behind_key").alias("after"))


def playable(tracks: DataFrame) -> DataFrame:
    """Whether a track's codec may be played without fees, and by the engine itself."""
    free = F.col("codec").isin("native_video", "native_audio", "pcm", "flac", "opus", "vorbis", "av1", "vp9")
    return tracks.select("track_id", "codec", free.alias("free"), F.col("codec").isin("native_video", "native_audio").alias("own"))
