"""Quality and size measures of pictures, sound and streams, summed in integers and divided once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reports give identical pictures this PSNR in place of infinity.
IDENTICAL = 100.0


def clip(spark: SparkSession, pattern: str, width: int, height: int, frames: int) -> DataFrame:
    """frame, y, x and v of the luma plane of a deterministic pattern."""
    n = width * height
    pixel = spark.range(n * frames).select(F.expr(f"id div {n}").alias("frame"), F.expr(f"id % {n} div {width}").alias("y"), F.expr(f"id % {width}").alias("x"))
    frame, y, x = F.col("frame"), F.col("y"), F.col("x")
    side = 32
    ox, oy = frame * 8 % max(width - side, 1), frame * 4 % max(height - side, 1)
    patterns = {
        "flat": F.lit(128),
        "ramp": (x + frame * 3) % 256,
        "square": F.when((x >= ox) & (x < ox + side) & (y >= oy) & (y < oy + side), 220).otherwise(16),
        "bars": (F.when((y + frame * 7 % height) % 64 < 32, 200).otherwise(40) + x % 16) % 256,
        "checker": F.when((F.expr("x div 8") + F.expr("y div 8") + frame) % 2 == 0, 240).otherwise(20),
        "cut": F.when(frame < max(frames // 2, 1), 210).otherwise(45),
    }
    return pixel.withColumn("v", patterns[pattern].cast("long"))


def quantised(pixels: DataFrame, step: int) -> DataFrame:
    """A coarser copy, the usual stand-in for a decoded clip."""
    return pixels.withColumn("v", F.least(F.expr(f"v div {step} * {step} + {step // 2} + (x + y) % 3"), F.lit(255)))


def paired(reference: DataFrame, measured: DataFrame) -> DataFrame:
    return reference.join(measured.withColumnRenamed("v", "m"), ["frame", "y", "x"])


def psnr(squares: Column, n: Column, peak: int = 255) -> Column:
    return F.when(squares == 0, IDENTICAL).otherwise(F.round(10 * F.log10(F.lit(float(peak * peak)) / (squares / n)), 6))


def clip_psnr(reference: DataFrame, measured: DataFrame) -> DataFrame:
    """Mean squared error and PSNR over all pixels of a clip."""
    d = F.col("v") - F.col("m")
    s = paired(reference, measured).agg(F.sum(d * d).alias("squares"), F.count(F.lit(1)).alias("pixels"))
    return s.select("pixels", "squares", F.round(F.col("squares") / F.col("pixels"), 6).alias("mse"), psnr(F.col("squares"), F.col("pixels")).alias("psnr"))


def clip_ssim(reference: DataFrame, measured: DataFrame, width: int, height: int) -> DataFrame:
    """Mean over the frames of each frame's mean over whole 8 by 8 windows; edges that fill no window are left out."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    inside = paired(reference, measured).where(f"y < {height // 8 * 8} and x < {width // 8 * 8}")
    w = inside.groupBy("frame", F.expr("y div 8").alias("wy"), F.expr("x div 8").alias("wx")).agg(
        F.sum("v").alias("r"), F.sum("m").alias("m"), F.sum(F.col("v") * F.col("v")).alias("rr"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("v") * F.col("m")).alias("rm")
    )
    mr, mm = F.col("r") / 64.0, F.col("m") / 64.0
    vr, vm = F.greatest(F.col("rr") / 64.0 - mr * mr, F.lit(0.0)), F.greatest(F.col("mm") / 64.0 - mm * mm, F.lit(0.0))
    one = (2 * mr * mm + c1) * (2 * (F.col("rm") / 64.0 - mr * mm) + c2) / ((mr * mr + mm * mm + c1) * (vr + vm + c2))
    frames = w.groupBy("frame").agg(F.avg(one).alias("ssim"))
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("ssim"), 6).alias("ssim"))


def snr(samples: DataFrame, step: int) -> DataFrame:
    """Signal to noise in dB of each stream against a copy with so many levels merged; 100 without noise."""
    d = F.expr(f"s - s div {step} * {step}")
    s = samples.groupBy("stream").agg(F.sum(F.col("s") * F.col("s")).alias("signal"), F.sum(d * d).alias("noise"))
    return s.select("stream", "signal", "noise", F.when(F.col("noise") == 0, IDENTICAL).when(F.col("signal") == 0, 0.0).otherwise(F.round(10 * F.log10(F.col("signal") / F.col("noise")), 6)).alias("snr"))


def autocorrelation(samples: DataFrame, order: int) -> DataFrame:
    """Sums of s[i] * s[i - lag] of each stream for every lag up to the order: one window over a stream, whose rows then are where its sums are taken."""
    own = Window.partitionBy("stream").orderBy("p")
    each = samples.select("stream", *[(F.col("s") * (F.lag("s", k).over(own) if k else F.col("s"))).alias(str(k)) for k in range(order + 1)])
    sums = each.groupBy("stream").agg(*[F.sum(str(k)).alias(str(k)) for k in range(order + 1)])
    return sums.unpivot("stream", [str(k) for k in range(order + 1)], "lag", "r").where("r is not null").withColumn("lag", F.col("lag").cast("long"))


def bitrate(packets: DataFrame, fps: int) -> DataFrame:
    """Bits a second, average and guarded ratios of each track."""
    g = packets.groupBy("track_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("frames"), F.count_if(F.expr("flags % 2 = 1")).alias("keys"))
    return g.select("track_id", "bytes", "frames", F.round(F.col("bytes") * 8.0 * fps / F.greatest("frames", F.lit(1)), 6).alias("bitrate"), F.round(F.col("bytes") / F.greatest("keys", F.lit(1)), 6).alias("bytes_per_key"), F.round(F.coalesce(F.try_divide(F.col("bytes") * 1.0, F.col("frames")), F.lit(0.0)), 6).alias("average"))


def qp_histogram(rows: DataFrame) -> DataFrame:
    """One line per clip block: qp and count, in order."""
    n = rows.groupBy(F.expr("clip div 1000").alias("clips"), "qp").agg(F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qp", "n"))), lambda x: F.concat(F.lit("qp"), x["qp"].cast("string"), F.lit(":"), x["n"].cast("string"))), ", ")
    return n.groupBy("clips").agg(said.alias("histogram"))


def bytes_summary(rows: DataFrame) -> DataFrame:
    """Sum, extremes and average of the bytes of each qp, and the average of valid rows, 0 if there are none."""
    return rows.groupBy("qp").agg(F.sum("bytes").alias("total"), F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.round(F.avg("bytes"), 6).alias("average"), F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col("bytes"))), F.lit(0.0)), 6).alias("average_ok"))


def revisions(packets: DataFrame, most: int = 33) -> DataFrame:
    """Packets of each track by payload revision, in fixed columns; revisions past the last column aren't counted there."""
    code = F.col("size") % 38
    return packets.groupBy("track_id").agg(*[F.count_if(code == k).alias(f"rev{k}") for k in (1, 2, 3, 7, 10, 29, most)], F.count_if((code > most) | (code == 0)).alias("outside"))
