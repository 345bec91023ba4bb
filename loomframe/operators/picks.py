"""Choosing and comparing rows of parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the sweep grid, in the order of enumeration.
QPS = (18, 22, 26, 30, 34)
SYNTAXES, MODELS = ("compact", "entropy"), ("static", "context")
COSTS, PARTITIONS = ("header-aware", "rdo-fast"), ("fixed16x16", "auto-fast")

ROW = ("clip", "line", "part", "qp", "bytes", "ssim", "psnr")


def first_by(rows: DataFrame, *order: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first row in order, of each key if there are any (then in ascending order of plain expressions). Without keys the limit is pushed to every partition."""
    if not keys:
        return rows.orderBy(*order).limit(1)
    # an aggregate combines before it shuffles, where a window would sort every row of a key in one task
    least = F.min_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(least.alias("__row")).select("__row.*")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("ok and bytes is not null")


def smallest_at_quality(rows: DataFrame, ssim: float) -> DataFrame:
    """Fewest bytes among valid rows of this quality; ties go to the first row."""
    return first_by(valid(rows).where(F.col("ssim") >= ssim), F.col("bytes"), F.col("clip"), F.col("line"), F.col("part")).select(*ROW)


def best_under_budget(rows: DataFrame, measure: str, budget: int) -> DataFrame:
    """Highest measure among valid rows of at most so many bytes; ties go to fewer bytes, then the last row."""
    return first_by(valid(rows).where(F.col("bytes") <= budget), F.desc(measure), F.col("bytes"), F.desc("clip"), F.desc("line"), F.desc("part")).select(*ROW)


def best_overall(rows: DataFrame) -> DataFrame:
    """Highest ssim, then psnr; exact ties go to the most bytes and the last row."""
    return first_by(valid(rows), F.desc("ssim"), F.desc("psnr"), F.desc("bytes"), F.desc("clip"), F.desc("line"), F.desc("part")).select(*ROW)


def closest_rate(rows: DataFrame, target: float) -> DataFrame:
    """The row of each qp nearest to a rate; missing tie keys count as largest. error_percent is null for a target near 0."""
    near = first_by(valid(rows).where(~F.isnan("psnr")), F.abs(F.col("bytes") - F.lit(target)), F.coalesce("line", F.lit(255)), F.coalesce("bytes", F.lit((1 << 63) - 1)), F.col("clip"), F.col("part"), keys=("qp",))
    error = F.when(F.abs(F.lit(target)) > 1e-9, F.round(100 * (F.col("bytes") - target) / target, 6))
    return near.select("qp", "bytes", "clip", "line", error.alias("error_percent"))


def grid(spark: SparkSession, most: int | None = None) -> DataFrame:
    """The sweep's cases in order of enumeration: the context model needs entropy syntax. A literal of at most 80 rows."""
    out = spark.range(1, numPartitions=1).select()
    axes = {"qp": QPS, "inter_syntax": SYNTAXES, "entropy_model": MODELS, "cost_model": COSTS, "inter_partition": PARTITIONS}
    for name, values in axes.items():
        kind = "long" if name == "qp" else "string"
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(f"{name}_at", name))
    out = out.where("entropy_model <> 'context' or inter_syntax = 'entropy'").orderBy(*[f"{n}_at" for n in axes])
    return (out if most is None else out.limit(most)).select(*axes)


def paired_wins(rows: DataFrame) -> DataFrame:
    """How often either partition mode needs fewer bytes at the same settings; the last row of a setting and mode counts."""
    keys = ("clip", "inter_syntax", "qp", "entropy_model", "cost_model")
    last = first_by(valid(rows), -F.col("line"), -F.col("part"), -F.col("bytes"), keys=(*keys, "inter_partition"))
    wide = last.groupBy(*keys).agg(*[F.max(F.when(F.col("inter_partition") == p, F.col("bytes"))).alias(n) for p, n in (("fixed16x16", "fixed"), ("auto-fast", "auto"))]).where("fixed is not null and auto is not null")
    return wide.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.expr("auto < fixed")).alias("auto_wins"), F.count_if(F.expr("auto > fixed")).alias("fixed_wins"), F.count_if(F.expr("auto = fixed")).alias("equal"), F.sum(F.col("auto") - F.col("fixed")).alias("delta"))


def paired_modes(rows: DataFrame) -> DataFrame:
    """Per qp: settings measured under both entropy models, with wins, losses, ties and the sum of differences."""
    keys = ("clip", "qp", "cost_model", "inter_partition")
    best = valid(rows).groupBy(*keys).agg(*[F.min(F.when(F.col("entropy_model") == m, F.col("bytes"))).alias(m) for m in MODELS]).where("`static` is not null and context is not null")
    d = F.col("context") - F.col("static")
    return best.groupBy("qp").agg(F.count(F.lit(1)).alias("compared"), F.count_if(d < 0).alias("lower"), F.count_if(d > 0).alias("higher"), F.count_if(d == 0).alias("equal"), F.sum(d).alias("delta"))


BUCKETS = ("residual", "intra", "motion", "header")


def byte_shares(rows: DataFrame) -> DataFrame:
    """Per qp: bytes by use, what no use accounts for (not below 0), the shares of the total, and the largest use; ties go to the fixed order."""
    parts = {"residual": F.col("bytes") * 5, "intra": F.col("bytes") * 2, "motion": F.col("part") % 1000, "header": F.col("line") * 20}
    sums = rows.groupBy("qp").agg(F.sum(F.col("bytes") * 8).alias("total"), *[F.sum(e).cast("long").alias(n) for n, e in parts.items()])
    rest = F.greatest(F.col("total") - sum((F.col(b) for b in BUCKETS), F.lit(0)), F.lit(0))
    each = sums.withColumn("unaccounted", rest).unpivot(["qp", "total"], [*BUCKETS, "unaccounted"], "bucket", "bytes")
    shared = each.withColumn("share", F.round(F.col("bytes") / F.greatest("total", F.lit(1)), 6))
    top = shared.groupBy("qp").agg(F.max(F.struct("bytes", F.element_at(F.create_map(*[F.lit(x) for k, b in enumerate([*BUCKETS, "unaccounted"]) for x in (b, -k)]), F.col("bucket")).alias("k"), "bucket")).alias("t")).select("qp", F.col("t.bucket").alias("bottleneck"))
    return shared.join(top, "qp").select("qp", "bucket", "bytes", "share", "bottleneck")


def rdo_pick(rows: DataFrame) -> DataFrame:
    """Per clip the case of least cost distortion + lambda * rate div 256; lambda grows with 2 ** ((qp - 12) div 3)."""
    e = F.least(F.greatest(F.expr("(qp - 12) div 3"), F.lit(-8)), F.lit(16)).cast("int")
    weight = F.expr("(217 * pow256) div 256")
    scored = valid(rows).withColumn("e", e).withColumn("pow256", F.expr("case when e >= 0 then shiftleft(256L, e) else shiftright(256L, -e) end")).withColumn("lam", weight)
    cost = F.expr("cast((1 - ssim) * 1000000 + 0.5 as bigint) + lam * greatest(bytes, 0) div 256")
    return first_by(scored.withColumn("cost", cost), F.col("cost"), F.col("line"), F.col("part"), F.col("bytes"), keys=("clip",)).select("clip", "line", "part", "qp", "lam", "cost")


def primary(rows: DataFrame, wanted: str) -> DataFrame:
    """Of each clip block the row that stands for it: the wanted partition if there is one, else the fewest bytes; ties go to the first row."""
    block = rows.where("ok").withColumn("clips", F.expr("clip div 500"))
    return first_by(block, F.col("inter_partition") != wanted, F.col("bytes"), F.col("clip"), F.col("line"), F.col("part"), keys=("clips",)).select("clips", "clip", "line", "part", "inter_partition", "bytes")


def ratios(rows: DataFrame, raw: int) -> DataFrame:
    """Compression ratio and frames a second of each qp, with guarded divisors."""
    g = rows.groupBy("qp").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("psnr").alias("s"))
    return g.select("qp", F.round(F.col("n") * float(raw) / F.greatest("b", F.lit(1)), 6).alias("ratio"), F.round(F.col("n") / F.greatest("s", F.lit(1e-9)), 6).alias("fps"))
