"""Kernels over whole 8 by 8 blocks, each one row with its 64 samples as an array, in raster order.

Nothing is exploded or shuffled inside a block. Where a kernel needs the blocks beside one, these send
their edges alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks stand in a plane of so many columns.
COLUMNS = 8
#: Samples outside the plane.
OUTSIDE = 128


def places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def let(f: Callable[..., Column], **values: Column | str) -> Column:
    """An expression over values that are worked out once: lambdas would work out a column's own expression for every element."""
    names = list(values)
    bound = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
    return F.transform(F.array(bound), lambda s: f(*[s[n] for n in names]))[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def total_double(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def div(a: Column, b: int) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.floor(a / F.lit(b)).cast("int")


def basis(n: int, inverse: bool) -> Column:
    """Weights of a cosine transform of n points by output and input, scaled as stored streams are: by alpha / sqrt(n)."""
    weight = lambda k, x: (math.sqrt(0.5) if k == 0 else 1.0) * math.cos(math.pi / (2 * n) * k * (2 * x + 1)) / math.sqrt(n)
    return F.array(*[F.lit(weight(i, o) if inverse else weight(o, i)) for o in range(n) for i in range(n)])


def two_passes(v: Column, n: int, inverse: bool = False) -> Column:
    """A transform over the rows and then the columns of an array of n * n."""
    b = basis(n, inverse)
    rows = lambda v: F.transform(places(n * n), lambda p: total_double(F.transform(places(n), lambda i: F.get(v, p - p % n + i) * F.get(b, p % n * n + i))))
    columns = lambda t: F.transform(places(n * n), lambda p: total_double(F.transform(places(n), lambda i: F.get(t, i * n + p % n) * F.get(b, div(p, n) * n + i))))
    return let(lambda v: let(columns, t=rows(v)), v=v)


def whole(c: Column) -> Column:
    """The nearest whole number, halves away from 0; six decimals decide, as sums may be taken in any order."""
    c = F.round(c, 6)
    return F.when(c < 0, -F.floor(-c + 0.500001)).otherwise(F.floor(c + 0.500001)).cast("long")


def dct(tiles: DataFrame) -> DataFrame:
    """block, ky, kx and c of the 8-point transform of every block."""
    c = two_passes(F.col("v"), 8)
    return tiles.select("block", F.posexplode(c).alias("k", "c")).select("block", F.expr("cast(k div 8 as bigint)").alias("ky"), F.expr("cast(k % 8 as bigint)").alias("kx"), F.round("c", 6).alias("c"))


def coefficients(tiles: DataFrame) -> DataFrame:
    """block, v and w: the whole coefficients of every block, in raster order."""
    return tiles.select("block", "v", F.transform(two_passes(F.col("v"), 8), whole).alias("w"))


def idct(tiles: DataFrame) -> DataFrame:
    """block, y, x and s: what the whole coefficients of every block give back. The scaling of stored streams leaves a quarter of each sample."""
    s = two_passes(F.col("w"), 8, True)
    return coefficients(tiles).select("block", F.posexplode(s).alias("k", "s")).select("block", F.expr("cast(k div 8 as bigint)").alias("y"), F.expr("cast(k % 8 as bigint)").alias("x"), F.round("s", 6).alias("s"))


def quadrant(v: Column, q: int) -> Column:
    top, left = q // 2 * 4, q % 2 * 4
    return F.array(*[F.get(v, F.lit((top + y) * 8 + left + x)) for y in range(4) for x in range(4)])


def dct4(tiles: DataFrame) -> DataFrame:
    """block, quadrant, k, c and s: coefficients of the 4-point transform of each quadrant, and the samples that the whole ones give back."""
    parts = tiles.select("block", F.posexplode(F.array(*[quadrant(F.col("v"), q) for q in range(4)])).alias("quadrant", "v"))
    c = parts.withColumn("c", two_passes(F.col("v"), 4))
    both = c.withColumn("s", two_passes(F.transform("c", whole), 4, True))
    return both.select("block", "quadrant", F.posexplode(F.arrays_zip("c", "s")).alias("k", "z")).select("block", F.col("quadrant").cast("long").alias("quadrant"), F.col("k").cast("long").alias("k"), F.round("z.c", 6).alias("c"), F.round("z.s", 6).alias("s"))


def edges(tiles: DataFrame) -> DataFrame:
    """The outer samples of every block: left, right, top and bottom, eight each."""
    side = lambda f: F.transform(places(8), f)
    four = lambda v: F.struct(side(lambda i: F.get(v, i * 8)).alias("left"), side(lambda i: F.get(v, i * 8 + 7)).alias("right"), F.slice(v, 1, 8).alias("top"), F.slice(v, 57, 8).alias("bottom"))
    return tiles.select("block", let(four, v="v").alias("e")).select("block", "e.*")


def beside(tiles: DataFrame, shift: int, edge: str, name: str, inside: str) -> DataFrame:
    """Adds an edge of the block that stands shift places on, null where there is none in the plane."""
    other = edges(tiles).select((F.col("block") - shift).alias("block"), F.col(edge).alias(name))
    return tiles.join(other, "block", "left").withColumn(name, F.when(F.expr(inside), F.col(name)))


LEFT, RIGHT, ABOVE, BELOW = (-1, f"block % {COLUMNS} > 0"), (1, f"block % {COLUMNS} < {COLUMNS - 1}"), (-COLUMNS, "true"), (COLUMNS, "true")


def deblock(tiles: DataFrame, strength: int = 32) -> DataFrame:
    """Softens the edges between the blocks of a plane: all vertical ones, then all horizontal ones. Sums of the result and of what changed, by block.

    Two samples across an edge move to their mean, rounded up, by strength / 256 where they are near.
    """
    limit, k = min(120, max(4, 96 - strength * 3 // 2)), min(128, max(1, strength))

    def soft(a: Column, b: Column) -> Column:
        return F.when(b.isNull() | (F.abs(a - b) > limit), a).otherwise(F.floor((a * (256 - k) + F.floor((a + b + 1) / 2) * k) / 256).cast("long"))

    first = beside(beside(tiles, *[LEFT[0], "right", "l", LEFT[1]]), RIGHT[0], "left", "r", RIGHT[1])
    across = let(lambda v, l, r: F.transform(v, lambda x, p: F.when(p % 8 == 0, soft(x, F.get(l, div(p, 8)))).when(p % 8 == 7, soft(x, F.get(r, div(p, 8)))).otherwise(x)), v="v", l="l", r="r")
    first = first.select("block", F.col("v").alias("before"), across.alias("v"))
    second = beside(beside(first, ABOVE[0], "bottom", "a", ABOVE[1]), BELOW[0], "top", "b", BELOW[1])
    down = lambda v, a, b: F.transform(v, lambda x, p: F.when(p < 8, soft(x, F.get(a, p))).when(p >= 56, soft(x, F.get(b, p - 56))).otherwise(x))
    sums = lambda v, before: F.struct(total(F.transform(v, lambda x, p: x * (p + 1))).alias("weighted"), total(F.zip_with(v, before, lambda a, b: F.abs(a - b))).alias("moved"))
    return second.select("block", let(sums, v=let(down, v="v", a="a", b="b"), before="before").alias("s")).select("block", "s.*")


MODES = ("dc", "horizontal", "vertical", "planar", "diagonal")


def intra(tiles: DataFrame) -> DataFrame:
    """Of every block the prediction from the blocks above and to the left, as they are, that differs least; the first listed wins ties."""
    near = beside(beside(tiles, *[LEFT[0], "right", "l", LEFT[1]]), ABOVE[0], "bottom", "t", ABOVE[1])
    corner = edges(tiles).select((F.col("block") + COLUMNS + 1).alias("block"), F.get("bottom", F.lit(7)).alias("c"))
    near = near.join(corner, "block", "left").withColumn("c", F.when(F.expr(LEFT[1]), F.col("c")))
    none = F.array_repeat(F.lit(OUTSIDE).cast("long"), 8)
    near = near.select("block", "v", F.coalesce("l", none).alias("l"), F.coalesce("t", none).alias("t"), F.coalesce("c", F.lit(OUTSIDE)).alias("c"))

    def best(v: Column, l: Column, t: Column, c: Column) -> Column:
        left, top = lambda p: F.get(l, div(p, 8)), lambda p: F.get(t, p % 8)
        mean = F.array_repeat(F.floor((total(l) + total(t)) / 16), 64)
        guess = {
            "dc": mean,
            "horizontal": F.transform(places(64), left),
            "vertical": F.transform(places(64), top),
            "planar": F.transform(places(64), lambda p: F.floor((top(p) + left(p)) / 2)),
            "diagonal": F.transform(places(64), lambda p: F.least(F.greatest(top(p) + left(p) - c, F.lit(0)), F.lit(255))),
        }
        sad = lambda g: total(F.zip_with(v, g, lambda x, y: F.abs(x - y).cast("long")))
        return F.array_min(F.array(*[F.struct(sad(guess[m]).alias("sad"), F.lit(k).alias("k"), F.lit(m).alias("mode")) for k, m in enumerate(MODES)]))

    return near.select("block", let(best, v="v", l="l", t="t", c="c").alias("b")).select("block", "b.mode", "b.sad")


#: Fixed limits from which four small transforms are taken, and the factor of a quadrant's variance.
DETAIL_VARIANCE, DETAIL_ENERGY, QUADRANT_SCALE = 400.0, 5_000.0, 64.0


def variance(v: Column, n: int) -> Column:
    mean = total(v) / float(n)
    return F.greatest(total(F.transform(v, lambda x: x * x)) / float(n) - mean * mean, F.lit(0.0))


def transform_choice(tiles: DataFrame, about: int = 128) -> DataFrame:
    """Size of the transform and order of the scan of each block's difference to a flat one.

    Much variance, differences to the neighbours, or one lively quadrant call for four small transforms. A long tail of zeros
    among the whole coefficients calls for a scan of the others first, few others for a scan of low ones first.
    """

    def measures(v: Column, w: Column) -> Column:
        def step(p: Column, by: int, inside: Column) -> Column:
            return F.when(inside, F.abs(F.get(v, p) - F.get(v, p + by)).cast("double"))

        def roughness(p: Column) -> Column:
            near = F.array_compact(F.array(step(p, -8, p >= 8), step(p, 8, p < 56), step(p, -1, p % 8 > 0), step(p, 1, p % 8 < 7)))
            return let(lambda n: total_double(n) / F.size(n), n=near)

        quarter = F.array_max(F.array(*[let(lambda x: variance(x, 16), x=quadrant(v, q)) for q in range(4)]))
        last = F.array_max(F.transform(F.transform(zigzag(8), lambda k: F.get(w, k)), lambda x, p: F.when(x != 0, p)))
        return F.struct(
            F.round(variance(v, 64), 6).alias("variance"), F.round(total_double(F.transform(places(64), roughness)), 6).alias("laplacian"), F.round(quarter, 6).alias("quarter"),
            F.size(F.filter(w, lambda x: x != 0)).cast("long").alias("nonzero"), (63 - F.coalesce(last, F.lit(-1))).cast("long").alias("tail"),
        )

    difference = F.transform("v", lambda x: x - about)
    m = tiles.select("block", let(lambda v: let(measures, v=v, w=F.transform(two_passes(v, 8), whole)), v=difference).alias("m")).select("block", "m.*")
    small = (F.col("variance") >= DETAIL_VARIANCE) | (F.greatest("laplacian", F.col("quarter") * QUADRANT_SCALE) >= DETAIL_ENERGY)
    scan = F.when(F.col("tail") >= 48, "run_first").when(F.col("nonzero") <= 8, "low_first").otherwise("zigzag")
    return m.select("block", "variance", "laplacian", "quarter", "nonzero", "tail", F.when(small, "four4x4").otherwise("single8x8").alias("grouping"), scan.alias("scan"))


def zigzag(n: int) -> Column:
    """Raster places in the order of the diagonal scan."""
    order = sorted(range(n * n), key=lambda p: (p // n + p % n, (p % n if (p // n + p % n) % 2 == 0 else p // n)))
    return F.array(*map(F.lit, order))


def low_first(n: int) -> Column:
    """Raster places by distance from the first coefficient along rows and columns."""
    return F.array(*map(F.lit, sorted(range(n * n), key=lambda p: (p // n + p % n, p))))


def scans(tiles: DataFrame) -> DataFrame:
    """The whole coefficients of each block in three orders (diagonal, low ones first, others than zero first), as digests, and whether each order gives them back."""

    def orders(w: Column) -> Column:
        said = lambda order: F.sha2(F.array_join(F.transform(order, lambda k: F.get(w, k).cast("string")), " "), 256)
        back = lambda order: F.transform(F.array_sort(F.transform(order, lambda k: F.struct(k.alias("k"), F.get(w, k).alias("w")))), lambda x: x["w"])
        both = lambda order: F.struct(said(order).alias("said"), (back(order) == w).alias("same"))
        runs = F.concat(F.filter(zigzag(8), lambda k: F.get(w, k) != 0), F.filter(zigzag(8), lambda k: F.get(w, k) == 0))
        return F.struct(both(zigzag(8)).alias("a"), both(low_first(8)).alias("b"), let(both, order=runs).alias("c"))

    o = coefficients(tiles).select("block", let(orders, w="w").alias("o"))
    return o.select("block", F.col("o.a.said").alias("zigzag"), F.col("o.b.said").alias("low_first"), F.col("o.c.said").alias("run_first"), (F.col("o.a.same") & F.col("o.b.same") & F.col("o.c.same")).alias("restored"))


#: Fixed symbols: runs of up to 62 zeros, then values in zigzag code, and the end.
LONGEST, END = 62, 317


def tokens(tiles: DataFrame, qp: int = 16) -> DataFrame:
    """Symbols of each block's quantised coefficients but the first, in scan order: runs of zeros, values up to 127, and an end mark; and the coefficients that they give back.

    A block with a larger value has no symbols. Runs are found from the places of the values, not one by one.
    """

    def levels(w: Column) -> Column:
        return F.transform(F.slice(zigzag(8), 2, 63), lambda k: F.floor((F.abs(F.get(w, k)) + qp // 2) / qp).cast("long") * F.signum(F.get(w, k).cast("double")).cast("long"))

    def spell(ac: Column) -> Column:
        at = F.concat(F.array(F.lit(-1)), F.filter(F.transform(ac, lambda x, p: F.when(x != 0, p)), lambda p: p.isNotNull()), F.array(F.lit(63)))
        run = lambda z: F.concat(F.array_repeat(F.lit(LONGEST), div(z, LONGEST)), F.filter(F.array(z % LONGEST), lambda r: r > 0))
        value = lambda x: F.when(x > 0, 2 * x).otherwise(-2 * x - 1).cast("int") + LONGEST
        last = lambda p: F.filter(F.array(F.when(p < 63, value(F.get(ac, p)))), lambda s: s.isNotNull())
        each = lambda at: F.flatten(F.transform(F.slice(at, 2, F.size(at) - 1), lambda p, k: F.concat(run(p - F.get(at, k) - 1), last(p))))
        return F.when(F.array_max(F.transform(ac, F.abs)) <= 127, F.concat(let(each, at=at), F.array(F.lit(END))))

    def read(symbols: Column) -> Column:
        unzig = lambda z: F.when(z % 2 == 0, F.floor(z / 2)).otherwise(-F.floor((z + 1) / 2)).cast("long")
        return F.flatten(F.transform(F.filter(symbols, lambda x: x != END), lambda x: F.when(x <= LONGEST, F.array_repeat(F.lit(0).cast("long"), F.least(x, F.lit(LONGEST)))).otherwise(F.array(unzig(x - LONGEST)))))

    both = let(lambda ac: let(lambda s, ac: F.struct(s.alias("s"), (read(s) == ac).alias("same")), s=spell(ac), ac=ac), ac=let(levels, w="w"))
    s = coefficients(tiles).select("block", both.alias("b")).select("block", "b.*")
    return s.select("block", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("symbols"), F.coalesce("same", F.lit(True)).alias("restored"))


def coefficient_bytes(tiles: DataFrame) -> DataFrame:
    """Estimated bytes of each block's whole coefficients in the plain and the compact layout, and what the compact one saves in percent, by groups of blocks.

    Plain: two bits for a zero, four and its magnitude's bits for others, and a frame of ten bytes; compact: a frame of ten, a map of eight and two for each.
    """
    c = coefficients(tiles)
    bits = lambda w: total(F.transform(w, lambda x: F.when(x == 0, 2).otherwise(4 + F.length(F.bin(F.abs(x)))).cast("long")))
    sizes = let(lambda w: F.struct((F.ceil(bits(w) / 8) + 10).alias("plain"), (18 + 2 * F.size(F.filter(w, lambda x: x != 0))).cast("long").alias("compact")), w="w")
    each = c.select(F.expr("block div 64").alias("blocks"), sizes.alias("s")).select("blocks", "s.*")
    g = each.groupBy("blocks").agg(F.sum("plain").alias("plain"), F.sum("compact").alias("compact"))
    return g.select("blocks", "plain", "compact", (F.col("plain") - F.col("compact")).alias("saved"), F.round(F.when(F.col("plain") > 0, 100.0 * (F.col("plain") - F.col("compact")) / F.col("plain")).otherwise(0.0), 6).alias("percent"))


def colours(tiles: DataFrame) -> DataFrame:
    """Red, green and blue of blocks 3k to 3k + 2 as luma and chroma of a quarter of the samples, in full and limited range, and back with the nearest chroma; weighted sums of each trio."""
    trio = tiles.groupBy(F.expr("block div 3").alias("trio")).agg(*[F.max(F.when(F.col("block") % 3 == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")]).where("r is not null and g is not null and b is not null")
    byte = lambda e: F.least(F.greatest(F.floor(F.round(e, 6) + 0.5), F.lit(0)), F.lit(255)).cast("long")
    small = 224.0 / 255.0
    first = lambda q: div(q, 4) * 16 + q % 4 * 2
    at = lambda p: div(p, 16) * 4 + div(p % 8, 2)
    each = lambda f: F.transform(places(64), f)

    def quarter(c: Column, scale: float) -> Column:
        return F.transform(places(16), lambda q: byte(total(F.array(*[byte(F.get(c, first(q) + d) * scale + 128) for d in (0, 1, 8, 9)])) / 4.0))

    def planes(l: Column, cb: Column, cr: Column) -> Column:
        limited = lambda p: byte(F.get(l, p) * (219.0 / 255.0) + 16)
        return F.struct(F.transform(l, byte).alias("y"), quarter(cb, 1.0).alias("u"), quarter(cr, 1.0).alias("v"), each(limited).alias("ly"), quarter(cb, small).alias("lu"), quarter(cr, small).alias("lv"))

    def chroma(r: Column, b: Column, l: Column) -> Column:
        return let(planes, l=l, cb=F.zip_with(b, l, lambda x, y: (x - y) / 1.8556), cr=F.zip_with(r, l, lambda x, y: (x - y) / 1.5748))

    luma = lambda r, g, b: each(lambda p: 0.2126 * F.get(r, p) + 0.7152 * F.get(g, p) + 0.0722 * F.get(b, p))
    full = trio.select("trio", let(lambda r, g, b: let(chroma, r=r, b=b, l=luma(r, g, b)), r="r", g="g", b="b").alias("f")).select("trio", "f.*")

    def back(y: Column, u: Column, v: Column) -> Column:
        cu, cv = lambda p: F.get(u, at(p)) - 128, lambda p: F.get(v, at(p)) - 128
        rgb = {"red": lambda p: F.get(y, p) + 1.5748 * cv(p), "green": lambda p: F.get(y, p) - 0.1873 * cu(p) - 0.4681 * cv(p), "blue": lambda p: F.get(y, p) + 1.8556 * cu(p)}
        weigh = lambda f: total(each(lambda p: byte(f(p)) * (p + 1)))
        return F.struct(*[weigh(f).alias(n) for n, f in rgb.items()])

    weighted = lambda a: total(F.transform(a, lambda x, p: x * (p + 1)))
    return full.select("trio", *[weighted(F.col(c)).alias(c) for c in ("y", "u", "v", "ly", "lu", "lv")], let(back, y="y", u="u", v="v").alias("b")).select("trio", "y", "u", "v", "ly", "lu", "lv", "b.*")
