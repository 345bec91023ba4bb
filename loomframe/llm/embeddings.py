"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on PROJECTIONS random directions. Around a query's value on a
sorted projection lies a window; a pair's count is the number of projections on which one
falls into the other's window. Two unit vectors at the threshold differ on a random
direction by a normal variable of known deviation, so the window of WIDE deviations
fixes the chance of a collision and the binomial distribution the least count that pairs
at the threshold reach with probability RECALL. Pairs that reach it are verified.

Equal vectors form a class and are compared once. Classes are sorted by the first
projection and cut into blocks of up to ROWS; blocks too far apart there aren't compared.
Up to BAND neighbouring blocks travel together. Pairs are counted within pairs of bands,
in memory, and never written out: the others in a query's window are a row of bits, and
rows of all projections are added up bit by bit, 64 pairs at a time (Windows). Those rows
take in the whole cells that a window touches, so a few more pairs come through, and the
pairs that are near enough are counted once more without cells.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import by_key, cut, partitions, table
from loomframe.llm.components import Forest, components

PROJECTIONS, WIDE, RECALL, ROWS = 32, 1.5, 0.9995, 16_384
#: Pairs of blocks for each shuffle partition, while blocks stay below ROWS: more of them keep more tasks busy, fewer copy less.
UNITS = 6
#: Neighbouring blocks that travel together, at most. A vector goes to as many tasks' groups as there are bands.
BAND = 4
#: Cells of a projection of one block, words of a tile's row of bits, and what rounding may take from a window's edge.
CELLS, TILE, SLACK = 128, 16_384, 1e-9
#: Numbers that tell whether a pair's cosine can reach the threshold.
HEAD = 16
#: Deviations on the first projection beyond which blocks aren't compared.
FAR = 4.0


@lru_cache(maxsize=64)
def directions(dim: int) -> np.ndarray:
    """Random directions of independent normal parts, for any number of parts."""
    return np.random.default_rng([dim, 9_001]).standard_normal((PROJECTIONS, dim)) / math.sqrt(dim)


def deviation(threshold: float, dim: int) -> float:
    return math.sqrt(2 * (1 - threshold) / dim)


def least_count() -> int:
    """The largest count that a pair at the threshold reaches with probability RECALL."""
    p = math.erf(WIDE / math.sqrt(2))
    tail, k = 0.0, PROJECTIONS + 1
    while tail < RECALL:
        k -= 1
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
    return k


def in_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each projection's points, in ascending order."""
    lines = np.ascontiguousarray(points.T)
    order = np.argsort(lines, axis=1)
    return order.astype(np.int32), np.take_along_axis(lines, order, 1)


class Windows:
    """The others in a query's window on each projection, to whole cells, as rows of bits. Queries and others come in order."""

    def __init__(self, others: tuple[np.ndarray, np.ndarray], width: float):
        m = others[0].shape[1]
        self.words = -(-m // 64)
        step = -(-m // CELLS)
        self.rows = []
        for order, line in zip(*others, strict=True):
            cell = np.empty(m, np.intp)
            cell[order] = np.arange(m) // step
            cells = cell[order[-1]] + 1
            # row k: the others in the first k cells
            below = np.zeros((cells + 1, 8 * self.words), np.uint8)
            for bit in range(8):
                at = cell[bit::8]
                below[at + 1, np.arange(len(at))] |= np.uint8(1 << bit)
            np.bitwise_or.accumulate(below, axis=0, out=below)
            # from where to where a query's window touches a cell
            enter, leave = line[::step] - width - SLACK, line[np.minimum(np.arange(1, cells + 1) * step, m) - 1] + width + SLACK
            edges = np.sort(np.concatenate((enter, leave)))
            start = np.concatenate(([-np.inf], edges))
            rows = below[np.searchsorted(enter, start, "right")] ^ below[np.searchsorted(leave, start, "right")]
            self.rows.append((edges, rows.view(np.uint64)))

    def colliding(self, queries: tuple[np.ndarray, np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of others that share at least so many (1 or more) windows."""
        n_queries = queries[0].shape[1]
        at = np.empty(queries[0].shape, np.intp)
        for k, order, line, (edges, _) in zip(at, *queries, self.rows, strict=True):
            k[order] = np.repeat(np.arange(len(edges) + 1), np.diff(np.searchsorted(line, edges, "left"), prepend=0, append=n_queries))
        tile = max(1, TILE // self.words)
        adder = Adder((min(tile, n_queries), self.words), least)
        for a in range(0, n_queries, tile):
            n = min(tile, n_queries - a)
            if n < adder.shape[0]:
                adder = Adder((n, self.words), least)
            for (_, rows), k in zip(self.rows, at, strict=True):
                np.take(rows, k[a : a + n], axis=0, out=(row := adder.room()), mode="clip")
                adder.add(row)
            found = adder.reached().view(np.uint8).reshape(-1)
            where = np.flatnonzero(found != 0)
            bits = np.flatnonzero(np.unpackbits(found[where], bitorder="little").view(np.bool_))
            x, y = np.divmod(where[bits >> 3], 8 * self.words)
            yield x + a, (y << 3) + (bits & 7)


class Adder:
    """Adds up bits by carry-save addition: the k-th list holds rows that count 2**k each."""

    def __init__(self, shape: tuple[int, int], least: int):
        self.shape, self.least = shape, least
        self.levels: list[list[np.ndarray]] = [[]]
        self.free: list[np.ndarray] = []

    def room(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.shape, np.uint64)

    def add(self, row: np.ndarray, k: int = 0) -> None:
        """Takes over the row."""
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(row)
        if len(self.levels[k]) == 3:
            a, b, c = self.levels[k]
            x = np.bitwise_xor(a, b, out=self.room())
            a &= b
            np.bitwise_xor(x, c, out=b)
            x &= c
            a |= x
            self.free += [x, c]
            self.levels[k] = [b]
            self.add(a, k + 1)

    def reached(self) -> np.ndarray:
        """Bits of the places whose sum is at least the least, to be read before the next row is added; the sums start anew."""
        out, k = None, 0
        while k < len(self.levels) or self.least >> k:
            rows = self.levels[k] if k < len(self.levels) else []
            if len(rows) == 2:
                both = np.bitwise_and(*rows, out=self.room())
                rows[0] ^= rows[1]
                self.free.append(rows.pop())
                self.add(both, k + 1)
            if not rows:
                rows.append(self.room())
                rows[0].fill(0)
            # out: where the digits so far reach those of the least; None while these are zero
            if out is None:
                out = rows[0] if self.least >> k & 1 else None
            elif self.least >> k & 1:
                out &= rows[0]
            else:
                out |= rows[0]
            k += 1
        self.free += [row for rows in self.levels for row in rows]
        self.levels = [[]]
        return out


def near(v: np.ndarray, p: np.ndarray, left: np.ndarray, right: np.ndarray, queries: tuple[np.ndarray, np.ndarray], windows: Windows, heads: np.ndarray, threshold: float, width: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of left and right that share at least so many windows and whose cosine reaches the threshold; queries are left's points in order, windows those of right."""
    ours, theirs = heads[left], heads[right]
    for x, y in windows.colliding(queries, least):
        for c in range(0, len(x), 32_768):
            k, m = x[c : c + 32_768], y[c : c + 32_768]
            able = np.einsum("ij,ij->i", ours[k], theirs[m]) >= threshold - 1e-4
            k, m = left[k[able]], right[m[able]]
            keep = (np.einsum("ij,ij->i", v[k], v[m]) >= threshold) & (k != m)
            k, m = k[keep], m[keep]
            keep = ((p[m] >= p[k] - width) & (p[m] <= p[k] + width)).sum(1) >= least
            yield k[keep], m[keep]


def heads_of(v: np.ndarray) -> np.ndarray:
    """The first parts of unit vectors and the length of the rest: their product is no less than the cosine (but for single precision)."""
    few = v[:, : HEAD - 1]
    return np.column_stack((few, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", few, few))))).astype(np.float32)


def blocks_of(classes: DataFrame, n: int, spark: SparkSession) -> np.ndarray:
    """Values of the first projection between blocks of about as many classes."""
    few = math.isqrt(2 * UNITS * partitions(spark))
    blocks = max(-(-n // ROWS), min(few, -(-n // 1024)))
    found = classes.select(F.percentile_approx("first", [k / blocks for k in range(1, blocks)], max(10_000, 20 * blocks))).first()[0] if blocks > 1 else []
    return np.unique(np.array(found, np.float64))


def band_width(blocks: int, parts: int) -> int:
    """Blocks of a band: BAND, or fewer where there would be too few pairs of bands for all partitions."""
    return max(1, min(BAND, round(blocks / (math.isqrt(2 * parts) + 2))))


def reach(edges: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """For each block the first and the last block whose ranges come within reach of its own."""
    low, high = np.append(-np.inf, edges), np.append(edges, np.inf)
    return np.searchsorted(edges, low - far, "left"), np.searchsorted(edges, high + far, "right")


def work_of(start: np.ndarray, end: np.ndarray, wide: int, bands: int) -> np.ndarray:
    """Pairs of blocks within reach in every pair of bands, by the pair's number."""
    own = np.arange(len(start))
    out = []
    for apart in range(bands):
        # for each block the part of its reach in the band that is so far above its own
        first = (own // wide + apart) * wide
        many = np.minimum(end, first + wide - 1) - np.maximum(np.maximum(start, own), first) + 1
        out.append(np.bincount(own // wide, np.maximum(many, 0), bands).astype(np.int64)[: bands - apart])
    return np.concatenate(out)


def evenly(work: np.ndarray, parts: int) -> np.ndarray:
    """A partition for each piece of work: the largest pieces first, each to the partition with the least so far."""
    heap = [(0, p) for p in range(parts)]
    out = np.zeros(len(work), np.int64)
    for k in np.argsort(-work, kind="stable").tolist():
        sofar, out[k] = heap[0]
        heapq.heapreplace(heap, (sofar + int(work[k]), int(out[k])))
    return out


def keys_of(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of so many partitions a key that Spark deals to it."""
    many = int(parts * (math.log(parts) + 12))
    at = spark.sql(f"select transform(sequence(0L, {many}L), x -> pmod(hash(x), {parts})) as at").first().at
    keys = np.arange(parts)
    keys[at] = np.arange(many + 1)
    return keys


def unit(v: np.ndarray) -> np.ndarray:
    """Rows that aren't zero, at length 1."""
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def pack(v: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return [s.tobytes() if exact else d.tobytes() for s, d, exact in zip(single, v, (single == v).all(1).tolist(), strict=True)]


def unpack(packed: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = packed.to_pylist()
    v = np.empty((len(rows), dim))
    single = np.fromiter((len(x) == 4 * dim for x in rows), bool, len(rows))
    for kind, at in ((np.float32, single), (np.float64, ~single)):
        v[at] = np.frombuffer(b"".join(rows[k] for k in np.flatnonzero(at).tolist()), kind).reshape(-1, dim)
    return v


def links(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    Two rows are linked if the cosine of their vectors, in double precision, reaches the threshold.
    Vectors that are null, empty, zero or hold null or non-finite parts are linked with nothing, as are
    vectors of different lengths. Rows that share a vec_id are separate vectors. A row with a null vec_id
    counts in no other's links and has none.
    """
    spark = vectors.sparkSession

    def prepare(batches):
        for batch in batches:
            n, lists = batch.num_rows, batch.column(1)
            prints, dims, first, packed = (np.full(n, None, object) for _ in range(4))
            starts, parts = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null parts become NaN
            lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                v = parts[starts[at][:, None] + np.arange(dim)]
                fine = np.isfinite(v).all(1) & v.any(1)
                at, v = at[fine], v[fine]
                prints[at] = [hashlib.blake2b(x, digest_size=16).digest() for x in v]
                dims[at], first[at], packed[at] = dim, unit(v) @ directions(dim)[0], pack(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(dims, pa.int32()), pa.array(first, pa.float64()), pa.array(packed, pa.binary())], ["vec_id", "print", "dim", "first", "vector"])

    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(prepare, "vec_id long, print binary, dim int, first double, vector binary")
    valid = ready.where("print is not null and vec_id is not null")
    classes = cut(valid.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("dim").alias("dim"), F.first("first").alias("first"), F.first("vector").alias("vector")))

    edges = {r.dim: blocks_of(classes.where(F.col("dim") == r.dim), r.n, spark) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not edges:
        return ready.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = partitions(spark)
    bands, before, work = {}, {}, [np.zeros(0, np.int64)]
    for dim, e in edges.items():
        before[dim] = sum(map(len, work))
        wide = band_width(len(e) + 1, parts)
        bands[dim] = wide, -(-(len(e) + 1) // wide)
        work.append(work_of(*reach(e, FAR * deviation(threshold, dim)), *bands[dim]))
    keys = keys_of(spark, parts)[evenly(np.concatenate(work), parts)]
    # a few numbers for each block go to all tasks, outside the plan
    sent = spark.sparkContext.broadcast({dim: (e, FAR * deviation(threshold, dim), *bands[dim], before[dim]) for dim, e in edges.items()})
    sent_keys = spark.sparkContext.broadcast(keys)

    def meet(batches):
        """Each row with every pair of bands that its own is in."""
        for batch in batches:
            dims, first = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                e, far, wide, n, gone = sent.value[dim]
                rows = np.flatnonzero(dims == dim)
                own = np.searchsorted(e, first[rows], "left")
                start, end = reach(e, far)
                low, high = start[own] // wide, end[own] // wide
                many = high - low + 1
                at = np.repeat(np.arange(len(rows)), many)
                them, mine = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many), own[at] // wide
                i, j = np.minimum(mine, them), np.maximum(mine, them)
                # pairs of bands are numbered by their distance, then by the first
                number = gone + (j - i) * n - (j - i) * (j - i - 1) // 2 + i
                for a in range(0, len(at), 20_000):
                    some = slice(a, a + 20_000)
                    t = batch.take(pa.array(rows[at[some]]))
                    yield pa.RecordBatch.from_arrays([*(t.column(c) for c in (0, 1, 2, 4)), *(pa.array(x[some].astype(np.int32)) for x in (own[at], i, j)), pa.array(number[some]), pa.array(sent_keys.value[number[some]])], ["rep", "size", "dim", "vector", "block", "i", "j", "unit", "dealt"])

    units = classes.select("rep", "size", "dim", "first", "vector").mapInArrow(meet, "rep long, size long, dim int, vector binary, block int, i int, j int, unit long, dealt long")
    least = least_count()

    def run(tables):
        for t in tables:
            dim = t.column("dim")[0].as_py()
            rep, size, block = (t.column(c).to_numpy() for c in ("rep", "size", "block"))
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            e, far, wide, *_ = sent.value[dim]
            start, end = reach(e, far)
            v = unit(unpack(t.column("vector"), dim))
            p, heads, width = v @ directions(dim).T, heads_of(v), WIDE * deviation(threshold, dim)
            at = {b: np.flatnonzero(block == b) for b in np.unique(block).tolist()}
            lines = {b: in_order(p[rows]) for b, rows in at.items()}
            forest, got, pairs = Forest(), np.zeros(len(rep), np.int64), []
            for b in at:
                if b // wide != j:
                    continue
                others = Windows(lines[b], width)
                for a in at:
                    if a // wide != i or a > b or not start[a] <= b <= end[a]:
                        continue
                    for k, m in near(v, p, at[a], at[b], lines[a], others, heads, threshold, width, least):
                        for one, two in ((k, m),) if a == b else ((k, m), (m, k)):
                            np.add.at(got, one, size[two])
                        pairs += [(int(rep[s]), int(rep[d])) for s, d in zip(k.tolist(), m.tolist(), strict=True) if forest.join(s, d)]
            on = np.flatnonzero(got)
            none = [None] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([*rep[on].tolist(), *none], pa.int64()), pa.array([*got[on].tolist(), *none], pa.int64()), pa.array([None] * len(on) + [a for a, _ in pairs], pa.int64()), pa.array([None] * len(on) + [b for _, b in pairs], pa.int64())], ["rep", "n", "a", "b"])

    found = cut(by_key(units, "unit", run, "rep long, n long, a long, b long", "dealt"))
    more = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("more"))
    whole = components(found.where("a is not null").select("a", "b")).withColumnRenamed("id", "rep")
    told = classes.select("print", "rep", "size").join(more, "rep", "left").join(whole, "rep", "left").select("print", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = ready.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("print")).alias("print")).join(told, "print", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"), 0.9)
