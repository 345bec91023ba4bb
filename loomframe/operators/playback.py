"""Opening, checking and playing containers: guards, pairing of frames, and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits: side and samples of a picture, consecutive packets of other tracks, entries that are remembered.
MAX_SIDE, MAX_PIXELS, SKIP_BUDGET, SEEN = 8_192, 33_554_432, 65_536, 200
#: Fixed routes by a path's extension.
ROUTES = {"528": "play", "srsm": "play", "mp4": "import", "mkv": "import", "wav": "audio", "yuv": "raw"}


def route(path: Column) -> Column:
    """What a path's extension calls for, whatever its case; others are refused."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), extension), F.lit("refused"))


def picture_limits(tracks: DataFrame) -> DataFrame:
    """Why a track can't be opened, the first reason that holds, or ok: video by its sides, audio by its rate and channels, other kinds always open."""
    w, h = F.col("width"), F.col("height")
    video = F.when((w == 0) | (h == 0), "empty").when((w > MAX_SIDE) | (h > MAX_SIDE), "side").when(w * h > MAX_PIXELS, "pixels").otherwise("ok")
    audio = F.when(F.col("rate") == 0, "rate").when(~F.col("channels").isin(1, 2), "channels").otherwise("ok")
    return tracks.select("id", F.when(F.col("kind") == "video", video).when(F.col("kind") == "audio", audio).otherwise("ok").alias("reason"))


def silent_tracks(tracks: DataFrame, packets: DataFrame) -> DataFrame:
    """Tracks without a packet, which an import refuses."""
    return tracks.join(packets.select("track_id"), "track_id", "left_anti").select("track_id", "codec")


def unseen(new: DataFrame, seen: DataFrame, most: int = SEEN) -> DataFrame:
    """Notifications that aren't among the last so many seen ones of a licence, each once."""
    last = Window.partitionBy("license_id").orderBy(F.desc("created"), F.desc("email_id"))
    held = seen.withColumn("n", F.row_number().over(last)).where(F.col("n") <= most).select("license_id", "email_id")
    return new.select("license_id", "email_id").distinct().join(held, ["license_id", "email_id"], "left_anti")


def paired_frames(source: DataFrame, decoded: DataFrame) -> DataFrame:
    """Source and decoded frames one to one by clip and frame: what is missing on either side, what came twice, and what matches."""
    s = source.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("sources"))
    d = decoded.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("copies"), F.min("bytes").alias("bytes"))
    both = s.join(d, ["clip", "frame"], "full")
    fault = F.when(F.col("sources").isNull(), "out_of_range").when(F.col("copies").isNull(), "missing").when((F.col("copies") > 1) | (F.col("sources") > 1), "duplicate").otherwise("ok")
    return both.select("clip", "frame", fault.alias("fault"), "bytes")


def display_order(decoded: DataFrame, cap: int) -> DataFrame:
    """Frames of each clip in order of display, with the bytes before them, and whether the clip holds more frames than the buffer. Frames that came twice count once, the smaller."""
    once = decoded.groupBy("clip", "frame").agg(F.min("bytes").alias("bytes"))
    own = Window.partitionBy("clip")
    before = own.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return once.select("clip", "frame", (F.row_number().over(own.orderBy("frame")) - 1).cast("long").alias("place"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("file_offset"), (F.count(F.lit(1)).over(own) > cap).alias("exceeded"))


def ticks(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """Milliseconds as ticks of the track and back, rounded down; a track without a scale has 0 ms."""
    scaled = packets.join(F.broadcast(tracks.select("track_id", "timescale")), "track_id").withColumn("ms", F.expr("us div 1000")).withColumn("ticks", F.expr("ms * timescale div 1000"))
    return scaled.select("track_id", "sequence", "ticks", F.expr("case when timescale = 0 then 0 else ticks * 1000 div timescale end").alias("ms"))


def skips(packets: DataFrame, track: int, per: int, budget: int) -> DataFrame:
    """Of each stretch of so many sequence numbers the longest run of packets of other tracks than the wanted one, and whether it goes beyond the budget.

    Runs are counted within stretches, so no window spans a file.
    """
    own = packets.select(F.expr(f"sequence div {per}").alias("stretch"), "sequence", (F.col("track_id") == track).alias("wanted"))
    order = Window.partitionBy("stretch").orderBy("sequence")
    isles = own.withColumn("isle", F.sum(F.col("wanted").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = isles.groupBy("stretch", "isle").agg(F.count_if(~F.col("wanted")).alias("run"))
    return runs.groupBy("stretch").agg(F.max("run").alias("longest"), (F.max("run") > budget).alias("exceeded"))


#: What each command makes of a state; an ended or failed session only stops.
COMMANDS = {"signup": "play", "purchase": "pause", "error": "stop", "click": "end", "view": "step"}


def player_states(events: DataFrame) -> DataFrame:
    """The state of each session after its commands in order: stopped, playing, paused or ended.

    A command is a map of the four states, and maps compose: each session folds its own list of them.
    """
    own = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "command"))).alias("all"))

    def step(s: Column, x: Column) -> Column:
        c = x["command"]
        return F.when(c == "stop", "stopped").when((c == "play") & (s != "ended"), "playing").when((c == "pause") & (s == "playing"), "paused").when((c == "end") & (s == "playing"), "ended").otherwise(s)

    return own.select("user_id", F.size("all").cast("long").alias("commands"), F.aggregate("all", F.lit("stopped"), step).alias("state"))


def interleaved(samples: DataFrame) -> DataFrame:
    """Two streams of samples, 2k and 2k + 1, as one with both channels in turn: number of samples, a digest, and whether the channels can be had back."""
    one = samples.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("p", "s"))).alias("v")).select("stream", F.transform("v", lambda x: x["s"]).alias("v"))
    pairs = one.groupBy(F.expr("stream div 2").alias("pair")).agg(*[F.max(F.when(F.col("stream") % 2 == k, F.col("v"))).alias(c) for k, c in enumerate("lr")]).where("size(l) = size(r)")
    both = pairs.withColumn("both", F.flatten(F.zip_with("l", "r", lambda a, b: F.array(a, b))))
    back = lambda k: F.filter("both", lambda x, p: p % 2 == k)
    return both.select("pair", F.size("both").cast("long").alias("n"), F.sha2(F.array_join(F.transform("both", lambda x: x.cast("string")), " "), 256).alias("digest"), ((back(0) == F.col("l")) & (back(1) == F.col("r"))).alias("restored"))


def superchunks(frames: DataFrame, edge: int = 64) -> DataFrame:
    """Columns, rows and number of the square regions that cover a picture (id, width, height), and the luma and chroma bounds of the last one."""
    g = frames.select("id", "width", "height", F.expr(f"(width + {edge - 1}) div {edge}").alias("cols"), F.expr(f"(height + {edge - 1}) div {edge}").alias("rows"))
    x0, y0 = (F.col("cols") - 1) * edge, (F.col("rows") - 1) * edge
    half = lambda c: F.expr(f"({c} + 1) div 2")
    return g.select("id", "cols", "rows", (F.col("cols") * F.col("rows")).alias("regions"), x0.alias("x0"), y0.alias("y0"), F.expr(f"(cols - 1) * {edge} div 2").alias("cx0"), F.expr(f"(rows - 1) * {edge} div 2").alias("cy0"), half("width").alias("cx1"), half("height").alias("cy1"))


def regions(frames: DataFrame, edge: int = 64) -> DataFrame:
    """Every region's luma samples, summed by picture: the regions cover it once."""
    g = superchunks(frames, edge).select("id", "cols", "rows").join(frames, "id")
    each = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") * F.col("rows") - 1)))
    w = F.least((F.expr("i % cols") + 1) * edge, F.col("width")) - F.expr("i % cols") * edge
    h = F.least((F.expr("i div cols") + 1) * edge, F.col("height")) - F.expr("i div cols") * edge
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("regions"), F.sum(w * h).alias("samples"), F.min(w * h).alias("least"))
