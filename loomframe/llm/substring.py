"""Exact repeats across documents, by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of half a window, and probes
the index with every rolling window of that length: a whole window always holds a
block of the document it repeats. Hits are extended to all whole windows around them;
the windows' hashes tell the smallest document that each starts in, so the union of
windows with a smaller document is that of the maximal repeats.

Hashes travel packed: one row for each batch of documents and bucket of hashes, with a
hash once for each document, and answers one row for each bucket of hashes and of documents.
What a batch of documents can decide alone it does: of a hash that several of its documents
share, one entry travels, so a passage in a third of all documents has an entry for each
batch and not for each document. Windows are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.bpe import pieces_of
from loomframe.llm.common import Lexicon, by_key, mix, partitions, table, xxhash64

WINDOW = 50
#: Characters of the documents whose hashes are packed together, at least one document.
TOGETHER = 8_000_000
PACKED = "bucket int, hash binary, rest binary, size int"
_words = re.compile(r"[^\x20\x09-\x0D]+")
_lexicon = Lexicon()
_base = 0x9E3779B97F4A7C15
#: Sets the second half of a window's hash apart from the first.
OTHER = np.uint64(0xA0761D6478BD642F)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 4096)
        _powers = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64)))) for b in (_base, pow(_base, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    s = np.concatenate(([np.uint64(0)], np.cumsum(h * up)))
    return mix((s[n:] - s[:-n]) * down[: len(h) - n + 1])


def pack(docs: np.ndarray, numbers: np.ndarray) -> bytes:
    """Ids, in runs, and a number below 2**32 for each row, compressed."""
    edge = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    runs = np.diff(np.append(edge, len(docs))).astype("<u4")
    data = b"".join([len(runs).to_bytes(4, "little"), docs[edge].astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), runs.view("u1").reshape(-1, 4).T.tobytes(), numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()])
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    n = int.from_bytes(data[:4], "little")
    flat = np.frombuffer(data, np.uint8)[4:]
    ids = np.ascontiguousarray(flat[: 8 * n].reshape(8, -1).T).view("<i8").ravel()
    runs = np.ascontiguousarray(flat[8 * n : 12 * n].reshape(4, -1).T).view("<u4").ravel()
    numbers = np.ascontiguousarray(flat[12 * n :].reshape(4, -1).T).view("<u4").ravel()
    return np.repeat(ids, runs), numbers


def rows_by_bucket(bucket: np.ndarray, docs: np.ndarray, numbers: np.ndarray, hashes: np.ndarray | None, kind: str) -> pa.RecordBatch:
    """A packed row for each bucket; hashes have a row of the matrix for each part of a hash."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, docs, numbers = bucket[order], docs[order], numbers[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, int)
    ends = np.append(edge[1:], len(bucket)) if len(bucket) else edge
    own = hashes[:, order].astype(kind) if hashes is not None else None
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array([own[:, a:b].tobytes() if own is not None else b"" for a, b in zip(edge, ends, strict=True)], pa.binary()), pa.array([pack(docs[a:b], numbers[a:b]) for a, b in zip(edge, ends, strict=True)], pa.binary()), pa.array((ends - edge).astype(np.int32))], ["bucket", "hash", "rest", "size"])


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of a document and the first place of each."""
    return np.unique(h, return_index=True)


def column(t: pa.Table, name: str) -> list[bytes]:
    return t.column(name).to_pylist()


def gathered(t: pa.Table, kind: str, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, a row of the matrix for each part, with the ids and numbers."""
    rest = [unpack(x) for x in column(t, "rest")]
    return np.concatenate([np.frombuffer(x, kind).reshape(parts, -1) for x in column(t, "hash")], 1), np.concatenate([d for d, _ in rest]), np.concatenate([x for _, x in rest])


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, the starts of its runs, and the run of each row in that order."""
    order = np.argsort(h[0], kind="stable") if len(h) == 1 else np.lexsort(h[::-1])
    own = h[:, order]
    new = np.concatenate(([True], (own[:, 1:] != own[:, :-1]).any(0))) if h.shape[1] else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def places(t: pa.Table) -> dict[int, np.ndarray]:
    """The numbers of each document in packed rows."""
    if not t.num_rows:
        return {}
    rest = [unpack(x) for x in column(t, "rest")]
    docs, numbers = np.concatenate([d for d, _ in rest]), np.concatenate([x for _, x in rest])
    order = np.argsort(docs, kind="stable")
    docs, numbers = docs[order], numbers[order]
    edge = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return dict(zip(docs[edge].tolist(), np.split(numbers, edge[1:]), strict=True))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a blank) of every row of docs (doc_id, text).

    A word goes if a window of so many words covers it whose words also start in a document with a
    smaller doc_id. Null or empty texts have no words. Rows that share a doc_id are one document:
    none repeats the other, and what goes from one goes at the same places from the other. A null
    doc_id is neither smaller nor larger: its row stays whole and removes nothing.
    """
    spark = docs.sparkSession
    half = window // 2
    n = min(partitions(spark) * 7 // 5, 1 << 15)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket"), "doc_id", "text")

    def hashes(text: str | None) -> np.ndarray:
        return _lexicon.hashes(_words.findall(text)) if text else np.empty(0, np.uint64)

    def probe(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pieces_of(texts, TOGETHER):
                h, doc, number = [], [], []
                for i, t in zip(ids[a:b], texts[a:b], strict=True):
                    all_h = rolling(hashes(t), half)
                    if i is None or not len(all_h):
                        continue
                    own, first = distinct(all_h)
                    block = np.zeros(len(own), bool)
                    block[np.searchsorted(own, all_h[::half])] = True
                    back = np.argsort(first)  # places ascend, so they pack well
                    h.append(own[back]), doc.append(np.full(len(own), i, np.int64)), number.append(2 * first[back] + block[back])
                if h:
                    h, doc, number = map(np.concatenate, (h, doc, number))
                    order, edge, run = runs(h[None])
                    # met more than once here, and a block of the index among them: all are hits, and one entry travels, with the block
                    good = (np.diff(np.append(edge, len(h))) > 1) & np.bitwise_or.reduceat(number[order] & 1, edge).astype(bool)
                    here = good[run]
                    at = order[here]
                    yield from answers(doc[at], number[at] >> 1, n)
                    stays = ~here | (np.maximum.reduceat(np.where(number[order] & 1, np.arange(len(order)), -1), edge)[run] == np.arange(len(order)))
                    at = np.sort(order[stays])
                    h, doc, number = h[at], doc[at], number[at]
                    yield rows_by_bucket(bucket_of(h, n), doc, number, h[None], "<u4")

    def hit(tables):
        for t in tables:
            if t.column("bucket")[0].as_py() >= n:
                yield from passed(t)
                continue
            h, doc, number = gathered(t, "<u4", 1)
            order, edge, run = runs(h)
            # met more than once, and a block of the index among them
            good = (np.diff(np.append(edge, len(run))) > 1) & np.bitwise_or.reduceat(number[order] & 1, edge).astype(bool)
            at = order[good[run]]
            yield from answers(doc[at], number[at] >> 1)

    def answers(doc: np.ndarray, number: np.ndarray, early: int = 0):
        """Rows by bucket of documents; early ones are told apart by n on top."""
        order = np.argsort(doc, kind="stable")
        if len(order):
            yield rows_by_bucket(early + np.mod(xxhash64(doc[order]), n), doc[order], number[order], None, "")

    def passed(t: pa.Table):
        """Answers that were known early."""
        for b in t.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() - n, pa.int32()), *b.columns[1:]], b.schema.names)

    def extend(own: pa.Table, hits: pa.Table) -> pa.Table:
        """Hashes of the whole windows that hold a hit."""
        where = places(hits)
        h, doc, number = [np.empty((2, 0), np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, text in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), strict=True) if where else ():
            if i in where and text:
                words = hashes(text)
                near = rolling(words, half)
                whole = rolling(words, window)
                at = where[i]
                on = np.isin(near, near[at[at < len(near)]])
                reach = np.concatenate(([0], np.cumsum(on)))
                start = np.arange(len(whole))
                live = np.flatnonzero(reach[np.minimum(start + window - half + 1, len(near))] > reach[start])
                if len(live):
                    first = np.sort(distinct(whole[live])[1])
                    h.append(np.stack([whole[live[first]], rolling(mix(words ^ OTHER), window)[live[first]]])), doc.append(np.full(len(first), i, np.int64)), number.append(live[first])
        h, doc, number = np.concatenate(h, 1), np.concatenate(doc), np.concatenate(number)
        gone, at = decided(h, doc)
        early = list(answers(doc[gone], number[gone], n))
        h, doc, number = h[:, at], doc[at], number[at]
        return pa.Table.from_batches([rows_by_bucket(bucket_of(h[0], n), doc, number, h, "<u8"), *early])

    def decided(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a smaller document of the same hash, and those of the smallest."""
        if not len(doc):
            return np.empty(0, int), np.empty(0, int)
        order, edge, run = runs(h)
        least = np.minimum.reduceat(doc[order], edge)
        smaller = doc[order] > least[run]
        return order[smaller], np.sort(order[~smaller])

    def smallest(tables):
        for t in tables:
            if t.column("bucket")[0].as_py() >= n:
                yield from passed(t)
                continue
            h, doc, number = gathered(t, "<u8", 2)
            at, _ = decided(h, doc)
            yield from answers(doc[at], number[at])

    def remove(own: pa.Table, found: pa.Table) -> pa.Table:
        where = places(found)
        size, gone, kept = [], [], []
        for i, text in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), strict=True):
            words = _words.findall(text) if text else []
            size.append(len(words))
            if i is not None and i in where and len(words) >= window:
                whole = rolling(_lexicon.hashes(words), window)
                at = where[i]
                starts = np.flatnonzero(np.isin(whole, whole[at[at < len(whole)]]))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                kept.append(" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]))
                gone.append(int((~stay).sum()))
            else:
                kept.append(" ".join(words))
                gone.append(0)
        return pa.table([own.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    grouped = keyed.groupBy("bucket")
    hits = by_key(docs.mapInArrow(probe, PACKED), "bucket", hit, PACKED)
    live = grouped.cogroup(hits.groupBy("bucket")).applyInArrow(extend, PACKED)
    found = by_key(live, "bucket", smallest, PACKED)
    return grouped.cogroup(found.groupBy("bucket")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
