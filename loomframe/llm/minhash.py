"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document's sketch is the k smallest hashes of
its set. Documents with equal sets form a class, of which the smallest id goes on.
The smallest LISTS values of each sketch go to inverted lists. Within a list the sketches of a pair tell how many of the k smallest values of
the union both hold; pairs far from the threshold are out, the others make groups.
In each group the exact Jaccard similarity of full sets decides. Long lists and large
groups first meet their centre; only rows not linked with it meet the others, in blocks.
Each unit of work returns a spanning forest of its links in place of all pairs.

A pair at the threshold t misses all lists with probability (1 - t) ** LISTS, and the
estimate's bound with that of a binomial five deviations below its mean; both are under
one in a million for t = 0.85.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import Lexicon, ascii_lower, by_key, cut, mix, scratch, small, table, tidied
from loomframe.llm.components import Forest, components

#: Words of a shingle, values of a sketch, values with an inverted list, rows of a block.
SHINGLE, SKETCH, LISTS, BLOCK = 5, 64, 8, 768
_words = re.compile(r"[^\x20\x09-\x0D]+")
_lexicon = Lexicon()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle; no words, none."""
    words = _words.findall(ascii_lower(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = _lexicon.hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for j in range(min(size, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (fingerprint of the whole set), first (the smallest values) and sketch (packed 32-bit parts)."""
    import hashlib

    @tidied
    def run(batches):
        for batch in batches:
            n, prints, first, packed = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                first.append(s[:LISTS].view(np.int64))
                packed.append((s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "print", "first", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, first array<long>, sketch binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, by a product of incidence matrices over shared values."""
    sizes = [len(x) for x in left], [len(x) for x in right]
    rows = [np.repeat(np.arange(len(x)), n) for x, n in zip((left, right), sizes, strict=True)]
    value = [np.concatenate(x) if len(x) else np.empty(0, np.uint64) for x in (left, right)]
    both = np.intersect1d(*value)
    out = np.zeros((len(left), len(right)), np.float32)
    keep = [np.isin(v, both) for v in value]
    at = [np.searchsorted(both, v[k]) for v, k in zip(value, keep, strict=True)]
    rows = [r[k] for r, k in zip(rows, keep, strict=True)]
    for a in range(0, len(both), 4096):
        m = []
        for x, r, n in zip(at, rows, out.shape, strict=True):
            here = (x >= a) & (x < a + 4096)
            one = np.zeros((n, min(4096, len(both) - a)), np.float32)
            one[r[here], x[here] - a] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def packed_matrix(sketch: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows, the largest value behind them."""
    out = np.full((len(sketch), SKETCH), np.uint32(0xFFFFFFFF))
    for row, s in zip(out, sketch, strict=True):
        row[: len(s)] = s
    return out


def union_overlap(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many of the k smallest values of the union of two sketches both hold, row by row."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.uint32(0xFFFFFFFF))
    return (again & (np.cumsum(~again, 1) <= k[:, None])).sum(1)


class Sketches:
    """Judges pairs by the k smallest values of the union of their sketches."""

    def __init__(self, data: list[bytes], size: np.ndarray, percent: int):
        self.values, self.size, self.t, self.percent = [np.frombuffer(x, "<u4") for x in data], size, percent / 100, percent
        self.rows = packed_matrix(self.values)

    def least(self, k: np.ndarray) -> np.ndarray:
        return np.maximum(1, self.t * k - 5 * np.sqrt(k * self.t * (1 - self.t)))

    def maybe(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs can reach the threshold by their sizes and by all values that their sketches share."""
        shared = overlaps([self.values[k] for k in left], [self.values[k] for k in right])
        a, b = self.size[left][:, None], self.size[right][None]
        small, large = np.minimum(a, b), np.maximum(a, b)
        # sketches that hold whole sets decide at once
        return (100 * small >= self.percent * large) & np.where(large <= SKETCH, 100 * shared >= self.percent * (small + large - shared), shared >= self.least(np.minimum(SKETCH, large)))

    def sure(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs one by one: those of which the union's smallest values tell enough in common."""
        large = np.maximum(self.size[left], self.size[right])
        k = np.minimum(SKETCH, large)
        return (large <= SKETCH) | (union_overlap(self.rows[left], self.rows[right], k) >= self.least(k))


class Sets:
    """Judges pairs by exact similarity of their whole sets."""

    def __init__(self, data: list[bytes], size: np.ndarray, percent: int):
        self.values, self.size, self.percent = [np.frombuffer(x, np.uint64) for x in data], np.array([len(x) // 8 for x in data], np.int64), percent

    def maybe(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shared = overlaps([self.values[k] for k in left], [self.values[k] for k in right]).astype(np.int64)
        return 100 * shared >= self.percent * (self.size[left][:, None] + self.size[right][None] - shared)

    def sure(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.ones(len(left), bool)


def banded(lists: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """Cuts the inverted lists (doc_id, n_shingles, value) of over BLOCK documents by size. Gives list (the value and a band), doc_id and __n, without lists of one document, and whether any list is longer than BLOCK.

    Documents of a pair are in the same band of sizes or in neighbouring ones, so each band
    also gets the documents of the band below; a band without own documents is left out.
    Sizes of lists are written apart, so that Spark can split the join of a common value.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    lists = lists.select("doc_id", "value", band.alias("__band"))
    counts = lists.groupBy("value", "__band").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(counts.groupBy("value").agg(F.sum("n").alias("__total"), F.map_from_entries(F.collect_list(F.struct("__band", "n"))).alias("__of")).where("__total > 1"))
    cold = F.col("__total") <= BLOCK
    each = lists.join(sizes, "value").withColumn("__at", F.explode(F.when(cold, F.array(F.lit(-1))).otherwise(F.array(F.col("__band"), F.col("__band") + 1))))
    own = F.try_element_at("__of", F.col("__at"))
    sized = each.withColumn("__n", F.when(cold, F.col("__total")).otherwise(own + F.coalesce(F.try_element_at("__of", F.col("__at") - 1), F.lit(0)))).where("__n > 1")
    return sized.select(F.xxhash64("value", "__at").alias("list"), "doc_id", "__n"), not sizes.where(F.col("__total") > BLOCK).isEmpty()


def pairs_of_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Gives each row, of which block is its own and others the blocks it meets, to every such pair of blocks. Adds unit, i and j (the pair's blocks)."""
    each = rows.withColumn("other", F.explode("others"))
    return each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("unit", F.xxhash64(key, "i", "j")).drop("others", "other", "__n")


def units(batch: pa.Table, names: tuple[str, ...], key: str):
    """The columns of a group, and the rows of each different key in it: hashes of keys may collide."""
    t = {c: batch.column(c).to_numpy() for c in names}
    tag = np.stack([t[key].astype(np.int64), t["i"].astype(np.int64), t["j"].astype(np.int64)])
    if (tag == tag[:, :1]).all():
        return t, [np.arange(tag.shape[1])]
    _, at = np.unique(tag, axis=1, return_inverse=True)
    return t, [np.flatnonzero(at == k) for k in range(at.max() + 1)]


def spanning(judge, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of rows."""
    forest, out = Forest(), []
    x, y = np.nonzero(judge.maybe(left, right))
    step = 1_000
    at = 0
    while at < len(x):
        one, two = left[x[at : at + step]], right[y[at : at + step]]
        at, step = at + step, min(20_000, 2 * step)
        # pairs within a tree need no look
        roots = [np.fromiter((forest.root(k) for k in side.tolist()), np.int64, len(side)) for side in (one, two)]
        some = np.flatnonzero(roots[0] != roots[1])
        some = some[judge.sure(one[some], two[some])]
        out += [(int(ids[a]), int(ids[b])) for a, b in zip(one[some].tolist(), two[some].tolist(), strict=True) if forest.join(a, b)]
    return [(a, b) for a, b in out if a != b]


def in_units(rows: DataFrame, key: str, kind: type, percent: int) -> DataFrame:
    """Links (a, b) that span what is linked in each pair of blocks; rows have key, doc_id, size, data, block and others."""

    def run(tables):
        for batch in tables:
            t, each = units(batch, (key, "i", "j", "block", "doc_id", "size"), key)
            judge, out = kind(batch.column("data").to_pylist(), t["size"], percent), []
            for members in each:
                i, j = t["i"][members[0]], t["j"][members[0]]
                left, right = (members, members) if i == j else (members[t["block"][members] == i], members[t["block"][members] == j])
                if len(left) and len(right) and len(members) > 1:
                    out += spanning(judge, t["doc_id"], left, right)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return by_key(pairs_of_blocks(rows, key), "unit", run, "a long, b long")


def linked(rows: Callable[[Column], DataFrame], key: str, kind: type, percent: int, hot: bool) -> DataFrame:
    """Links (a, b) that span the linked rows of each key; rows gives those that fulfil a condition on __n, the number of the key's rows, with key, doc_id, size and data.

    Keys of up to BLOCK rows are one unit of work. In larger ones, where hot tells that there are any, each row first meets
    the key's centre, its smallest doc_id, through a join that Spark can split. Rows linked with the centre need
    no more comparisons with each other; the rest, in blocks, meet all rows.
    """
    one = F.lit(0).cast("int")
    cold = in_units(rows(F.col("__n") <= BLOCK).withColumn("block", one).withColumn("others", F.array(one)), key, kind, percent)
    if not hot:
        return cold
    spark = cold.sparkSession
    path, met = scratch(spark, "members"), scratch(spark, "met")
    rows(F.col("__n") > BLOCK).select(key, "doc_id", "size", "data").write.parquet(path)
    large = spark.read.parquet(path)
    centre = cut(large.groupBy(key).agg(F.min_by(F.struct("doc_id", "size", "data"), "doc_id").alias("c"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    # the centre goes to every part of its key, and a part holds about BLOCK rows
    dealt = large.join(small(centre.select(key, "parts")), key).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))
    centres = centre.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.select(key, "part", "doc_id", "size", "data", F.lit(False).alias("is_centre")).union(centres.select(key, "part", "c.doc_id", "c.size", "c.data", F.lit(True).alias("is_centre")))

    def meet(tables):
        for t in tables:
            keys, parts, size, lead = (t.column(c).to_numpy() for c in (key, "part", "size", "is_centre"))
            judge, on, of = kind(t.column("data").to_pylist(), size, percent), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
            ids = t.column("doc_id").to_numpy()
            for c in np.flatnonzero(lead):
                own = np.flatnonzero((keys == keys[c]) & (parts == parts[c]) & ~lead)
                if len(own):
                    on[own] = judge.maybe(own, np.array([c]))[:, 0] & judge.sure(own, np.full(len(own), c)) | (ids[own] == ids[c])
                    of[own] = ids[c]
            out = pa.table([*(t.column(c) for c in (key, "doc_id", "size", "data")), pa.array(of), pa.array(on)], names=[key, "doc_id", "size", "data", "centre", "on"])
            yield from out.filter(pa.array(~lead)).combine_chunks().to_batches()

    by_key(both.withColumn("unit", F.xxhash64(key, "part")), "unit", meet, f"{key} long, doc_id long, size long, data binary, centre long, on boolean").write.parquet(met)
    done = spark.read.parquet(met)
    sides = cut(done.groupBy(key).agg(F.sum((~F.col("on")).cast("long")).alias("rest"), F.sum(F.col("on").cast("long")).alias("joined")).where("rest > 0"))
    b_rest, b_all = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("rest") / BLOCK).cast("int") + F.ceil(F.col("joined") / BLOCK).cast("int")
    draw = F.xxhash64("doc_id", F.lit(3))
    left = done.join(small(sides), key)
    left = left.withColumn("block", F.when(F.col("on"), b_rest + F.pmod(draw, b_all - b_rest)).otherwise(F.pmod(draw, b_rest)).cast("int"))
    left = left.withColumn("others", F.when(F.col("on"), F.sequence(F.lit(0), b_rest - 1)).otherwise(F.sequence(F.lit(0), b_all - 1)))
    met_links = done.where("on and doc_id != centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    return cold.union(met_links).union(in_units(left.select(key, "doc_id", "size", "data", "block", "others"), key, kind, percent))


#: Values of a sketch whose lists are compared first; lists of the others are skipped where these have put all documents into one group.
FIRST = 2


def candidates(reps: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the groups of representatives (doc_id, n_shingles, first) which the sketches can't tell apart. Sketches are joined to what is left of the lists."""

    def compared(values: Column, known: DataFrame | None) -> DataFrame:
        lists, hot = banded(reps.select("doc_id", "n_shingles", F.explode(values).alias("value")), percent)
        if known is not None:
            label = F.coalesce("component", "doc_id")
            groups = lists.join(small(known.withColumnRenamed("id", "doc_id")), "doc_id", "left").groupBy("list").agg(F.min(label).alias("low"), F.max(label).alias("high"))
            lists = lists.join(cut(groups.where("low < high").select("list")), "list", "left_semi")
        rows = lists.join(drawn.select("doc_id", F.col("n_shingles").alias("size"), F.col("sketch").alias("data")), "doc_id").select("list", "doc_id", "size", "data", "__n")
        return linked(rows.where, "list", Sketches, percent, hot)

    links = cut(compared(F.slice("first", 1, FIRST), None))
    rest = F.slice("first", FIRST + 1, LISTS - FIRST)
    return cut(links.union(compared(rest, components(links))))


def confirm(groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) by exact similarity that span the true components within each group. Texts of the groups' documents alone are read again."""

    @tidied
    def sets(batches):
        for batch in batches:
            packed = [shingles(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 8 for x in packed], pa.int64()), pa.array(packed, pa.binary())], ["component", "doc_id", "size", "data"])

    def full(which: Column) -> DataFrame:
        return docs.join(small(members.where(which)), "doc_id").select("component", "doc_id", "text").mapInArrow(sets, "component long, doc_id long, size long, data binary")

    counts = cut(groups.groupBy("component").agg(F.count(F.lit(1)).alias("__n")))
    members = cut(groups.join(counts, "component"))
    return linked(full, "component", Sets, percent, not counts.where(F.col("__n") > BLOCK).isEmpty())


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of five-word shingles.
    component_id is the smallest doc_id reachable. Null texts and texts without words have no set
    and are linked with nothing: component_id is their own id. Rows that share a doc_id are one
    document, linked by any of its texts, and one row each in the result. A null doc_id is linked with nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch(spark, "sketches")
    sketches(docs).write.parquet(path)
    drawn = spark.read.parquet(path)
    members = drawn.select("doc_id", "n_shingles", "print")
    known = drawn.where("print is not null and doc_id is not null")
    reps = cut(known.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "first")).alias("x")).select("print", "x.*"))
    classes = reps.select("print", F.col("doc_id").alias("rep"))
    again = repeated(known)
    groups = components(candidates(reps, drawn, percent)).withColumnRenamed("id", "doc_id")
    links = cut(confirm(groups, docs, percent))
    if again:
        links = links.union(known.select("doc_id", "print").join(again, "doc_id").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    whole = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = members.join(whole, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def repeated(docs: DataFrame) -> DataFrame | None:
    """The ids that several rows share; None where there are none."""
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    return None if again.isEmpty() else again


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: keeps one document of each group of near-duplicates, the one with the smallest id, and one row of each id: that with the smallest text. Rows without an id all stay."""
    gone = cut(near_duplicates(docs, 80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    left = docs.join(small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")
    again = repeated(left)
    if again is None:
        return left
    again = again.withColumnRenamed("doc_id", "__again")
    some = left.join(again, left["doc_id"] == F.col("__again"), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*left.columns), F.coalesce("text", F.lit(""))).alias("__row"))
    return left.join(again, left["doc_id"] == F.col("__again"), "left_anti").unionByName(some.select("__row.*"))
