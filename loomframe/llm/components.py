"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import cut


class Forest:
    """Union-find over the keys of one task or block."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def shrink(batches):
    """Replaces the links of a task by one star for each of its own components."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    rows = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
    for k in range(0, len(rows), 50_000):
        part = np.array(rows[k : k + 50_000], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (smallest id reachable) of every id that a link (a, b) names; nulls and loops are left out.

    Alternates large and small stars, each round's links written to the shared folder, until every id has one
    link, to an id without one. Fails if that isn't reached in most_rounds: a round at least halves long chains.
    The smallest neighbours are written apart, so that Spark can split the join of a much linked id.
    """
    e = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a is not null and b is not null and a != b")
    e = cut(e.mapInArrow(shrink, "a long, b long").distinct())
    for _ in range(most_rounds):
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        if least.count() == e.count() and e.select("b").distinct().join(least.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        # large star: every larger neighbour of a node goes to the smallest id around the node
        large = e.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: a node and its smaller neighbours, at most one for each task above, go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = cut(small)
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
