"""Block kernels: closed forms over pixels, 8 by 8 blocks and displacements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.tiles import let


def block_variance(blocks: DataFrame) -> DataFrame:
    """Mean of squares minus the square of the mean, all in integers rounded down."""
    s = blocks.groupBy("block").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return s.select("block", F.expr("s div 64").alias("mean"), F.expr("q div 64 - (s div 64) * (s div 64)").alias("variance"))


def adaptive_deltas(variances: DataFrame, strength: int, limit: int = 6) -> DataFrame:
    """Steps of quality by complexity against the floor of the median: of frames (complex blocks up) and of blocks (complex blocks down), truncated and clamped."""
    median = variances.agg(F.floor(F.percentile("variance", F.lit(0.5))).alias("med"))
    j = variances.crossJoin(F.broadcast(median))  # one row
    clamp = lambda e: F.least(F.greatest(F.expr(e), F.lit(-limit)), F.lit(limit))
    return j.select("block", "variance", clamp(f"((variance - med) * {strength}) div (greatest(med, 1) * 4 + 1)").alias("frame_delta"), clamp(f"(-(variance - greatest(med, 1)) * {strength}) div (greatest(med, 1) * 4 + 1)").alias("block_delta"))


def activity(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Of each whole 16 by 16 block: the sum of squares about the integer mean, the gradients of its inner pixels, and a flatness flag."""
    line, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    gx = F.abs(F.lead("v").over(line) - F.lag("v").over(line))
    gy = F.abs(F.lead("v").over(column) - F.lag("v").over(column))
    inner = (F.col("x") % 16).between(1, 14) & (F.col("y") % 16).between(1, 14)
    own = pixels.withColumn("g", F.when(inner, gx + gy).otherwise(0)).where(f"x < {width // 16 * 16} and y < {height // 16 * 16}")
    s = own.groupBy("frame", F.expr("y div 16").alias("by"), F.expr("x div 16").alias("bx")).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.sum("g").alias("gradient"))
    # sum (v - m)^2 = q - 2 m s + 256 m^2 for the integer mean m
    spread = F.expr("q - 2 * (s div 256) * s + 256 * (s div 256) * (s div 256)")
    return s.select("frame", "by", "bx", spread.alias("variance_sum"), "gradient", F.when(spread < 16 * 256, 1024).otherwise(0).cast("long").alias("flatness"))


#: Side of a coding block.
SIDE = 16


def windows(pixels: DataFrame, margin: int, width: int, height: int) -> DataFrame:
    """frame, by, bx, c (the block's samples) and r (those of the frame before around it, by so many places on each side; 128 outside) of every block of every frame but the first.

    A sample goes to its own block and, of the frame before, to the blocks whose surroundings it is in: four at most for margins up to half a block.
    """
    side = SIDE + 2 * margin
    ordered = lambda pos: F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("v").alias("v"))))
    inside = pixels.where(f"y < {height // SIDE * SIDE} and x < {width // SIDE * SIDE}").withColumn("by", F.expr(f"y div {SIDE}")).withColumn("bx", F.expr(f"x div {SIDE}"))
    cur = inside.where("frame > 0").groupBy("frame", "by", "bx").agg(F.transform(ordered((F.col("y") % SIDE * SIDE + F.col("x") % SIDE).cast("int")), lambda e: e["v"]).alias("c"))
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - margin) / SIDE), F.lit(0)), F.least(F.floor((F.col(c) + margin) / SIDE), F.lit(n // SIDE - 1))))
    around = pixels.where(f"y < {height // SIDE * SIDE + margin} and x < {width // SIDE * SIDE + margin}").withColumn("by", near("y", height)).withColumn("bx", near("x", width))
    place = ((F.col("y") - F.col("by") * SIDE + margin) * side + F.col("x") - F.col("bx") * SIDE + margin).cast("int")
    ref = around.groupBy((F.col("frame") + 1).alias("frame"), "by", "bx").agg(ordered(place).alias("e"))
    # inner blocks have all samples, in order; those at the frame's edge are filled up
    fill = lambda e: let(lambda m: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda p: F.coalesce(F.element_at(m, p), F.lit(128).cast("long"))), m=F.map_from_entries(e))
    dense = let(lambda e: F.when(F.size(e) == side * side, F.transform(e, lambda x: x["v"])).otherwise(fill(e)), e="e")
    return cur.join(ref.select("frame", "by", "bx", dense.alias("r")), ["frame", "by", "bx"])


def difference(c: Column, sample: Callable[[Column], Column]) -> Column:
    """Sum of absolute differences between a block's samples and those that are told by place."""
    return F.aggregate(F.transform(c, lambda v, p: F.abs(v - sample(p))), F.lit(0).cast("long"), lambda s, x: s + x)


def motion(pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """For each 16 by 16 block of every frame but the first, the displacement of least absolute difference to the frame before; outside counts as 128. Ties go to the smaller mvx, then mvy."""
    side = SIDE + 2 * radius
    at = lambda r, x, y: lambda p: F.get(r, F.floor(p / SIDE).cast("int") * side + p % SIDE + (y + radius) * side + x + radius)
    steps = range(-radius, radius + 1)
    best = lambda c, r: F.array_min(F.array(*[F.struct(difference(c, at(r, x, y)).alias("sad"), F.lit(x).alias("mvx"), F.lit(y).alias("mvy")) for x in steps for y in steps]))
    found = windows(pixels, radius, width, height).select("frame", "by", "bx", let(best, c="c", r="r").alias("b"))
    return found.select("frame", "by", "bx", F.col("b.mvx").cast("long").alias("mvx"), F.col("b.mvy").cast("long").alias("mvy"), F.col("b.sad").alias("sad"))


#: Fixed order in which half places about a vector are tried, in quarters of a sample; the vector itself comes first.
HALVES = ((0, 0), (-2, -2), (0, -2), (2, -2), (-2, 0), (2, 0), (-2, 2), (0, 2), (2, 2))


def half_places(pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """The vectors of motion() refined to half places, in quarters of a sample: samples between others are weighted from the four around them, and only a smaller difference moves a vector."""
    margin = radius + 1
    side = SIDE + 2 * margin

    def best(c: Column, r: Column, mvx: Column, mvy: Column) -> Column:
        def sample(qx: int, qy: int) -> Callable[[Column], Column]:
            fx, fy = qx % 4, qy % 4
            tap = lambda p, dx, dy: F.get(r, F.floor(p / SIDE).cast("int") * side + p % SIDE + (mvy + (qy // 4 + dy + margin)) * side + mvx + (qx // 4 + dx + margin))
            taps = [(dx, dy, (fx if dx else 4 - fx) * (fy if dy else 4 - fy)) for dy in (0, 1) for dx in (0, 1)]
            return lambda p: F.floor((sum((tap(p, dx, dy) * w for dx, dy, w in taps if w), F.lit(0)) + 8) / 16)

        return F.array_min(F.array(*[F.struct(difference(c, sample(x, y)).alias("sad"), F.lit(k).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(HALVES)]))

    whole = motion(pixels, radius, width, height).select("frame", "by", "bx", F.col("mvx").cast("int").alias("mvx"), F.col("mvy").cast("int").alias("mvy"))
    found = windows(pixels, margin, width, height).join(whole, ["frame", "by", "bx"]).select("frame", "by", "bx", "mvx", "mvy", let(best, c="c", r="r", mvx="mvx", mvy="mvy").alias("b"))
    return found.select("frame", "by", "bx", (F.col("mvx") * 4 + F.col("b.dx")).cast("long").alias("qx"), (F.col("mvy") * 4 + F.col("b.dy")).cast("long").alias("qy"), F.col("b.sad").alias("sad"))


def predicted(vectors: DataFrame) -> DataFrame:
    """Each block's vector less the median of its left, upper and upper right neighbours (0 outside), the bits' zigzag code and its length in bytes."""
    near = {"l": (0, -1), "u": (-1, 0), "r": (-1, 1)}
    out = vectors
    for name, (dy, dx) in near.items():
        other = vectors.select("frame", (F.col("by") - dy).alias("by"), (F.col("bx") - dx).alias("bx"), F.col("mvx").alias(f"{name}x"), F.col("mvy").alias(f"{name}y"))
        out = out.join(other, ["frame", "by", "bx"], "left")
    median = lambda c: F.sort_array(F.array(*[F.coalesce(f"{n}{c}", F.lit(0)) for n in near]))[1]
    d = out.select("frame", "by", "bx", (F.col("mvx") - median("x")).alias("dx"), (F.col("mvy") - median("y")).alias("dy"))
    zig = lambda c: F.when(F.col(c) >= 0, F.col(c) * 2).otherwise(-F.col(c) * 2 - 1)
    size = lambda e: F.when(e < 128, 1).when(e < 16384, 2).otherwise(3)
    bucket = lambda c: F.when(F.abs(c) == 0, 0).when(F.abs(c) <= 8, 1).when(F.abs(c) <= 32, 2).otherwise(3)
    return d.select("frame", "by", "bx", "dx", "dy", zig("dx").alias("zx"), zig("dy").alias("zy"), (size(zig("dx")) + size(zig("dy"))).cast("long").alias("bytes"), (bucket("dx") * 4 + bucket("dy")).cast("long").alias("context"))


def quantise(coefficients: DataFrame, qp: int) -> DataFrame:
    """Whole coefficients (halves away from 0) divided by the step with rounding away from 0, and scaled back."""
    whole = F.when(F.col("c") < 0, -F.floor(-F.col("c") + 0.500001)).otherwise(F.floor(F.col("c") + 0.500001))
    w = coefficients.withColumn("w", whole.cast("long"))
    level = F.expr(f"(w + {qp // 2} * cast(sign(w) as bigint)) div {qp}")
    return w.select("block", "ky", "kx", "w", level.alias("level"), (level * qp).alias("back"))


def zigzag_place(c: str = "ky", d: str = "kx"):
    """Place of a coefficient in the diagonal scan of an 8 by 8 block, by a closed form."""
    a = f"({c} + {d})"
    before = f"(case when {a} < 8 then {a} * ({a} + 1) div 2 else 64 - (15 - {a}) * (16 - {a}) div 2 end)"
    inside = f"(case when {a} % 2 = 0 then {d} - greatest({a} - 7, 0) else {c} - greatest({a} - 7, 0) end)"
    return F.expr(f"{before} + {inside}")


#: Fixed limits of a sparse block: non-zero samples and variance.
SPARSE_SAMPLES, SPARSE_VARIANCE = 10, 120.0


def residual_class(blocks: DataFrame, about: int = 128) -> DataFrame:
    """Class of each block's difference to a flat one: zero, dc_only if constant, sparse if few samples differ by little, else dense."""
    r = blocks.withColumn("r", F.col("v") - about)
    g = r.groupBy("block").agg(F.count_if(F.expr("r <> 0")).alias("nonzero"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    variance = F.greatest(F.col("q") / 64.0 - F.col("s") / 64.0 * (F.col("s") / 64.0), F.lit(0.0))
    kind = F.when(F.col("nonzero") == 0, "zero").when(F.col("lo") == F.col("hi"), "dc_only").when((F.col("nonzero") <= SPARSE_SAMPLES) & (variance < SPARSE_VARIANCE), "sparse").otherwise("dense")
    return g.select("block", "nonzero", F.round(variance, 6).alias("variance"), kind.alias("kind"))


def coefficient_cost(levels: DataFrame) -> DataFrame:
    """Of each block: the last place in scan order that isn't 0, the cost of sending each level with its place, and the levels of each band."""
    at = levels.withColumn("place", zigzag_place())
    g = at.groupBy("block").agg(F.count_if(F.expr("level <> 0 and place > 0")).alias("ac"), F.max(F.when(F.col("level") != 0, F.col("place"))).alias("last"), F.count_if(F.expr("level <> 0 and place between 1 and 21")).alias("low"), F.count_if(F.expr("level <> 0 and place between 22 and 42")).alias("mid"), F.count_if(F.expr("level <> 0 and place > 42")).alias("high"))
    return g.select("block", F.coalesce("last", F.lit(-1)).cast("long").alias("last"), (2 + 3 * F.col("ac")).alias("cost"), "low", "mid", "high")


def delta_runs(blocks: DataFrame) -> DataFrame:
    """Differences from the sample before (128 at first), and the runs of zeros among them, of each block."""
    w = Window.partitionBy("block").orderBy("p")
    d = blocks.withColumn("d", F.col("v") - F.lag("v", 1, 128).over(w)).withColumn("isle", F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).over(w))
    runs = d.groupBy("block", "isle").agg(F.count_if(F.expr("d = 0")).alias("zeros"))
    return d.groupBy("block").agg(F.sum(F.abs("d")).alias("sum_abs"), F.count_if(F.expr("d = 0")).alias("zeros")).join(runs.groupBy("block").agg(F.max("zeros").alias("longest"), F.count_if(F.expr("zeros > 0")).alias("runs")), "block")


def run_lengths(blocks: DataFrame) -> DataFrame:
    """Run-length code of each block's samples in four levels, in scan order."""
    w = Window.partitionBy("block").orderBy("p")
    m = blocks.withColumn("mode", F.expr("v div 64")).withColumn("new", F.when(F.col("mode") == F.lag("mode").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    r = m.groupBy("block", "run").agg(F.max("mode").alias("mode"), F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "mode", "n"))), lambda x: F.concat(x["mode"].cast("string"), F.lit("x"), x["n"].cast("string"))), " ")
    return r.groupBy("block").agg(F.count(F.lit(1)).alias("runs"), said.alias("code"))


def deblock(blocks: DataFrame, strength: int = 32) -> DataFrame:
    """Softens the vertical edge between blocks 2k and 2k + 1 (side by side): where the pixels are near, each moves to their mean, rounded up, by strength / 256."""
    limit = min(120, max(4, 96 - strength * 3 // 2))
    k = min(128, max(1, strength))
    own = blocks.withColumn("pair", F.expr("block div 2"))
    left = own.where("block % 2 = 0 and x = 7").select("pair", "y", F.col("v").alias("a"))
    right = own.where("block % 2 = 1 and x = 0").select("pair", "y", F.col("v").alias("b"))
    soft = lambda c: F.when(F.abs(F.col("a") - F.col("b")) > limit, F.col(c)).otherwise(F.expr(f"({c} * {256 - k} + (a + b + 1) div 2 * {k}) div 256"))
    return left.join(right, ["pair", "y"]).select("pair", "y", "a", "b", soft("a").alias("new_a"), soft("b").alias("new_b"))


def blend(blocks: DataFrame, weight: int) -> DataFrame:
    """Weighted mean of blocks 2k and 2k + 1 with weights that add to 256, rounded, and the sum of each result."""
    own = blocks.withColumn("pair", F.expr("block div 2"))
    a = own.where("block % 2 = 0").select("pair", "p", F.col("v").alias("a"))
    b = own.where("block % 2 = 1").select("pair", "p", F.col("v").alias("b"))
    v = F.expr(f"shiftright(a * {weight} + b * {256 - weight} + 128, 8)")
    return a.join(b, ["pair", "p"]).groupBy("pair").agg(F.sum(v).alias("blended"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("sad"))


#: Fixed pairs of weights, out of 256, in the order that they are tried.
WEIGHTS = ((64, 192), (95, 161), (128, 128), (161, 95), (192, 64))


def blend_pick(blocks: DataFrame) -> DataFrame:
    """For blocks 3k (current), 3k + 1 (forward) and 3k + 2 (backward) the prediction of least difference.

    Average, forward and backward win ties in that order; a weighted one only counts if strictly better.
    """
    own = blocks.withColumn("trio", F.expr("block div 3"))
    v = own.groupBy("trio", "p").agg(*[F.max(F.when(F.col("block") % 3 == k, F.col("v"))).alias(n) for k, n in enumerate("cfb")]).where("c is not null and f is not null and b is not null")
    cases = {"average": "(f + b + 1) div 2", "forward": "f", "backward": "b", **{f"weighted{x}": f"shiftright(f * {x} + b * {y} + 128, 8)" for x, y in WEIGHTS}}
    sums = v.groupBy("trio").agg(*[F.sum(F.abs(F.col("c") - F.expr(e))).alias(n) for n, e in cases.items()])
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("sad"), F.lit(k).alias("k"), F.lit(n).alias("mode")) for k, n in enumerate(cases)]))
    return sums.select("trio", best["mode"].alias("mode"), best["sad"].alias("sad"))


def luma_chroma(blocks: DataFrame) -> DataFrame:
    """Full-range BT.709 luma and chroma, rounded and clamped, of pixels whose red, green and blue stand in blocks 3k, 3k + 1 and 3k + 2; sums of each trio."""
    own = blocks.withColumn("trio", F.expr("block div 3"))
    c = own.groupBy("trio", "p").agg(*[F.max(F.when(F.col("block") % 3 == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")]).where("r is not null and g is not null and b is not null")
    y = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    byte = lambda e: F.least(F.greatest(F.floor(e + 0.5), F.lit(0)), F.lit(255))
    return c.groupBy("trio").agg(F.sum(byte(y)).alias("y"), F.sum(byte((F.col("b") - y) / 1.8556 + 128)).alias("u"), F.sum(byte((F.col("r") - y) / 1.5748 + 128)).alias("v"))
