"""Roll-ups that go into measurement reports, and the sentences in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.picks import ROW, valid


def first_min(rows: DataFrame, label: str) -> DataFrame:
    """Of each clip block the row of fewest bytes among those of a label, the first of ties: an aggregate that combines before it shuffles."""
    own = valid(rows).where(F.contains("cost_model", F.lit(label)))
    best = own.groupBy(F.expr("clip div 500").alias("clips")).agg(F.min(F.struct("bytes", "clip", "line", "part")).alias("b"))
    return best.select("clips", "b.bytes", "b.clip", "b.line", "b.part")


def candidates(rows: DataFrame) -> DataFrame:
    """Of each clip the cheapest and the best row; ties go to the better, or the cheaper, then to the first."""
    cheap = F.min(F.struct("bytes", (-F.col("ssim")).alias("s"), "line", "part"))
    good = F.min(F.struct((-F.col("ssim")).alias("s"), "bytes", "line", "part"))
    g = valid(rows).groupBy("clip").agg(cheap.alias("c"), good.alias("g"))
    return g.select("clip", F.col("c.bytes").alias("least_bytes"), F.col("c.line").alias("least_line"), (-F.col("g.s")).alias("best_ssim"), F.col("g.bytes").alias("best_bytes"), F.col("g.line").alias("best_line"))


def syntax_pairs(rows: DataFrame) -> DataFrame:
    """Rows of both versions of a syntax, paired by the name without the version; the fewest bytes of each count."""
    name = F.concat_ws("-", F.col("clip").cast("string"), "inter_partition", F.when(F.col("part") % 2 == 0, "v1").otherwise("v2"))
    own = valid(rows).select(name.alias("name"), "bytes")
    base = own.groupBy(F.regexp_replace("name", "-v[12]$", "").alias("base")).agg(*[F.min(F.when(F.endswith("name", F.lit(f"-{v}")), F.col("bytes"))).alias(v) for v in ("v1", "v2")])
    return base.where("v1 is not null and v2 is not null").select("base", "v1", "v2", (F.col("v2") - F.col("v1")).alias("delta"))


def grid_with_extras(grid: DataFrame, extras: DataFrame) -> DataFrame:
    """The sweep's cases and some more, each once."""
    return grid.unionByName(extras).distinct()


def b_modes(rows: DataFrame) -> DataFrame:
    """Per block of clips, over the clips measured in all three modes of bidirectional frames (whole, half and weighted): how often half and weighted need fewer bytes than whole, and the sums of both kinds of block. The last row of a mode counts."""
    mode = F.when(F.col("line") % 3 == 0, "whole").when(F.col("line") % 3 == 1, "half").otherwise("weighted")
    last = valid(rows).groupBy("clip", mode.alias("mode")).agg(F.max(F.struct("line", "part", "bytes")).alias("r"))
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("r.bytes"))).alias(m)
    wide = last.groupBy("clip").agg(of("whole"), of("half"), of("weighted"), F.sum(F.col("r.part") % 100).alias("wb"), F.sum(F.col("r.part") % 10).alias("hb")).where("whole is not null and half is not null and weighted is not null")
    return wide.groupBy(F.expr("clip div 500").alias("clips")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("half < whole")).alias("half_lower"), F.count_if(F.expr("weighted < whole")).alias("weighted_lower"), F.sum("wb").alias("weighted_blocks"), F.sum("hb").alias("half_blocks"))


def rate_report(rows: DataFrame, fps: int, target_kbps: int) -> DataFrame:
    """Per clip block: least, largest and mean qp, the rate reached and its error in percent of the target, 0 for a target of 0."""
    g = rows.groupBy(F.expr("clip div 1000").alias("clips")).agg(F.min("qp").alias("min_qp"), F.max("qp").alias("max_qp"), F.avg("qp").alias("avg"), F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    reached = F.col("b") * 8.0 * fps / F.greatest("n", F.lit(1))
    error = (reached - target_kbps * 1000.0) / (target_kbps * 1000.0) * 100 if target_kbps else F.lit(0.0)
    return g.select("clips", "min_qp", "max_qp", F.round("avg", 6).alias("avg_qp"), F.round(reached, 6).alias("rate"), F.round(error, 6).alias("error_percent"))


def quality_steps(deltas: DataFrame, base: int, low: int, high: int) -> DataFrame:
    """Of groups of blocks the quality steps taken: blocks up, down and unchanged, extremes and mean, and the rounded mean within limits."""
    qp = F.least(F.greatest(F.col("frame_delta") + base, F.lit(low)), F.lit(high))
    g = deltas.select(F.expr("block div 100").alias("frame"), qp.alias("qp")).groupBy("frame")
    s = g.agg(F.count_if(F.col("qp") > base).alias("up"), F.count_if(F.col("qp") < base).alias("down"), F.count_if(F.col("qp") == base).alias("unchanged"), F.min("qp").alias("low"), F.max("qp").alias("high"), F.sum("qp").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.col("s") / F.col("n")
    return s.select("frame", "up", "down", "unchanged", "low", "high", F.round(mean, 6).alias("mean"), F.least(F.greatest(F.floor(mean + 0.5), F.lit(low)), F.lit(high)).cast("long").alias("effective"))


def merged_steps(steps: DataFrame) -> DataFrame:
    """Frames' steps put together without rounding in between: counts and sums add, extremes combine."""
    n = F.col("up") + F.col("down") + F.col("unchanged")
    return steps.groupBy((F.col("frame") % 3).alias("plane")).agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("unchanged").alias("unchanged"), F.min("low").alias("low"), F.max("high").alias("high"), F.round(F.sum(F.round(F.col("mean") * n)) / F.sum(n), 6).alias("mean"))


def decisions(choices: DataFrame) -> DataFrame:
    """Per qp the counters of decisions between two candidates: how many were compared, their side bytes, and which won."""
    return choices.groupBy("qp").agg((2 * F.count(F.lit(1))).alias("compared"), F.sum("side_bytes").alias("side_bytes"), F.count_if(F.expr("chosen = 0")).alias("still_wins"), F.count_if(F.expr("chosen = 1")).alias("searched_wins"))


def still_or_searched(rows: DataFrame) -> DataFrame:
    """Whether each row does better without motion or with the vector that was found: distortion plus lambda times rate; no motion is listed first and wins ties."""
    e = F.least(F.greatest(F.expr("(qp - 12) div 3"), F.lit(-8)), F.lit(16)).cast("int")
    lam = F.expr("(217 * case when e >= 0 then shiftleft(256L, e) else shiftright(256L, -e) end) div 256")
    zig = lambda c: F.when(c >= 0, 2 * c).otherwise(-2 * c - 1)
    size = lambda c: F.when(zig(c) < 128, 1).when(zig(c) < 16384, 2).otherwise(3)
    dx, dy = F.col("part") % 200 - 100, F.col("clip") % 90 - 45
    r = valid(rows).withColumn("e", e).withColumn("lam", lam)
    searched = F.floor(F.col("bytes") / 16) + F.floor(F.col("lam") * (size(dx) + size(dy)) / 256)
    still = F.floor(F.col("bytes") / 16) + F.col("part") % 7 + F.floor(F.col("lam") * 2 / 256)
    return r.select("clip", "line", "part", "bytes", "qp", F.when(searched < still, 1).otherwise(0).cast("long").alias("chosen"), (2 + size(dx) + size(dy)).cast("long").alias("side_bytes"))


def vector_statistics(deltas: DataFrame) -> DataFrame:
    """Of each frame's differences to predicted vectors, both parts alike: zeros, others, sum and mean of sizes."""
    zero = lambda c: (F.col(c) == 0).cast("long")
    g = deltas.groupBy("frame").agg(F.sum(zero("dx") + zero("dy")).alias("zero"), F.sum(2 - zero("dx") - zero("dy")).alias("others"), F.sum(F.abs("dx") + F.abs("dy")).alias("sizes"), F.count(F.lit(1)).alias("n"))
    return g.select("frame", "zero", "others", "sizes", F.round(F.col("sizes") / (2 * F.greatest("n", F.lit(1))), 6).alias("mean"))


def motion_telemetry(vectors: DataFrame) -> DataFrame:
    """Of each frame the blocks that move, and the sum of their vectors' lengths along both axes in whole samples."""
    return vectors.groupBy("frame").agg(F.count_if(F.expr("mvx <> 0 or mvy <> 0")).alias("moving"), F.sum(F.expr("(abs(mvx * 4) + abs(mvy * 4)) div 4")).alias("length"), F.count(F.lit(1)).alias("blocks"))


def activity_scores(blocks: DataFrame) -> DataFrame:
    """Scores of each block by which its quality may be set: by activity, by edges, and for screens. Edges and gradients are the same sum."""
    edge = F.col("gradient")
    return blocks.select("frame", "by", "bx", F.expr("variance_sum div 256 + gradient div 16").alias("activity"), (edge * 2 + F.expr("variance_sum div 512")).alias("edges"), (edge * 2 + F.expr("gradient div 4")).alias("screen"))


def side_bytes(rows: DataFrame) -> DataFrame:
    """Estimated bytes beside the residual, by prediction units of a block and syntax: header, partition map, transform tags, quality steps."""
    units = F.element_at(F.array(*map(F.lit, (1, 2, 2, 4))), (F.col("part") % 4 + 1).cast("int"))
    n = F.col("units")
    header = F.when(F.col("inter_syntax") == "compact", 9).otherwise(10) + F.when(F.col("ok"), 2).otherwise(0)
    parts = F.when(n == 1, 0).when(n == 2, 1).otherwise(4)
    tags = F.when(n == 1, 0).when(n == 2, 2).otherwise(4)
    steps = F.when(F.col("ok"), n - 1).otherwise(0)
    return rows.withColumn("units", units).groupBy("units", "inter_syntax").agg(F.count(F.lit(1)).alias("n"), F.sum(header).alias("header"), F.sum(parts).alias("partition"), F.sum(tags).alias("transform"), F.sum(steps).alias("steps")).withColumn("units", n.cast("long"))


def sentence(context: Column, static: Column) -> Column:
    """What a report says of two totals."""
    d = context - static
    s = lambda c: c.cast("string")
    return F.when(d < 0, F.concat(F.lit("context needs "), s(-d), F.lit(" bytes less than static ("), s(context), F.lit(")"))).when(d > 0, F.concat(F.lit("context needs "), s(d), F.lit(" bytes more than static ("), s(context), F.lit(")"))).otherwise(F.concat(F.lit("context and static tie at "), s(static)))


def sentences(rows: DataFrame) -> DataFrame:
    g = valid(rows).groupBy("qp").agg(*[F.sum(F.when(F.col("entropy_model") == m, F.col("bytes")).otherwise(0)).alias(m) for m in ("static", "context")])
    return g.select("qp", sentence(F.col("context"), F.col("static")).alias("summary"))


def markdown(rows: DataFrame, most: int = 50) -> DataFrame:
    """The lines of a report's table for its first rows, most bytes first."""
    top = valid(rows).orderBy(F.desc("bytes"), "clip", "line", "part").limit(most)
    return top.select("clip", "line", "part", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ROW[:5]]), F.lit(" |")).alias("text"))


def lists_encoder(text: Column, name: str) -> Column:
    """Whether a listing names an encoder as a word of its own."""
    return F.array_contains(F.split(F.lower(text), r"\s+"), name)
