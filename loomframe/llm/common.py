"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts: runs of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, a local session (tests) gets a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if told is None:
        told = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="loomframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small frame with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows, of ids and a few numbers each, up to which a side of a join is broadcast; they are counted first.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast if its rows, counted here, are few enough; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for a table that is written and read again. clear() removes all of an application."""
    return f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomframe-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no frame will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that operators have written in the shared folder; call it once their results are read or written."""
    drop_scratch(spark, own_folder(spark))


#: Rows of an Arrow batch. Whole texts of 10,000 rows, Spark's default, would take hundreds of MB of each worker.
BATCH_ROWS = 1_000


def lean(spark: SparkSession) -> None:
    """Has Spark send texts to Python in small batches from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Gives free memory back to the system when a task ends: workers live on through later stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z alone."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


def held(bucket: int, modulus: int, column: str = "doc_id"):
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == bucket, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def xxhash64(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for a long, as signed integers."""
    # fixed values of the algorithm
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def left(v, n):
        return (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    with np.errstate(over="ignore"):
        h = (np.uint64(seed) + p5 + np.uint64(8)) ^ (left(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = left(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


class Lexicon(dict):
    """word -> 64-bit hash, filled on demand and emptied when it holds too many words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal keys in batches sorted by key, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, f: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, dealt: str | None = None) -> DataFrame:
    """Deals rows by key, or by a column that depends on the key alone, and hands each task its groups one after the other."""

    @tidied
    def run(batches):
        yield from f(groups(batches, key))

    return df.repartition(partitions(df.sparkSession), dealt or key).sortWithinPartitions(key).mapInArrow(run, schema)
