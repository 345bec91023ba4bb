"""Byte-level BPE encoding and decoding by padded numpy matrices.

Pieces of text are grouped by length into padded matrices. In each round every
row finds its leftmost pair of minimum rank through a hashed pair table, merges
it, and is compacted by one column; rows without a pair leave the matrix.
Ranks come from a file of base64 tokens and ranks, whose path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import table, tidied

NONE = np.int32(np.iinfo(np.int32).max)
#: Cells of one matrix, and pieces and chunks that a worker remembers, at most.
CELLS, REMEMBERED = 2_000_000, 100_000
#: Characters of the documents encoded together, at least one document.
TOGETHER = 1_000_000


class PairTable:
    """(left, right) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 4))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        value, at = np.array(merged, np.int32), self.slot(key)
        while len(key):
            free = self.key[at] == -1
            self.key[at[free]] = key[free]
            won = self.key[at] == key
            self.value[at[won]] = value[won]
            key, value, at = key[~won], value[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no token. Shapes are kept; a right of -1 is padding."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        at, out = self.slot(key), np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero(right.ravel() >= 0)
        at = at[todo]
        while len(todo):
            there = self.key[at]
            hit = there == key[todo]
            out[todo[hit]] = self.value[at[hit]]
            go = ~hit & (there != -1)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Coder:
    """Encodes and decodes by one rank file and one split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.size = np.zeros(max(self.tokens) + 1, np.int64)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.size))), np.uint8)
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: text -> its ids in decimal, joined by a blank, and as packed 32-bit integers
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.chunks: dict[str, tuple[str, bytes] | None] = {}

    def forget(self) -> None:
        """Drops what was remembered, so that a worker holds none of it through other stages."""
        self.pieces.clear()
        self.chunks.clear()

    def merge(self, ids: np.ndarray) -> list[bytes]:
        """Merges every row of a matrix padded with -1, and packs its ids."""
        out: list = [None] * len(ids)
        row, size = np.arange(len(ids)), (ids >= 0).sum(1)
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(1)
            best = rank[np.arange(len(ids)), at]
            over = best == NONE
            if over.any():
                for k, x, n in zip(row[over].tolist(), ids[over], (4 * size[over]).tolist(), strict=True):
                    out[k] = x.tobytes()[:n]
                ids, rank, row, at, best, size = ids[~over], rank[~over], row[~over], at[~over], best[~over], size[~over]
            size = size - 1
            if len(ids):
                every, column = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
                ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
                rank = np.where(column < at[:, None], rank[:, :-1], rank[:, 1:])
                ids[every, at] = best
                # only the pairs on both sides of the merged token are new
                for k in (at - 1, at):
                    rows = np.flatnonzero((k >= 0) & (k + 1 < ids.shape[1]))
                    rank[rows, k[rows]] = self.pairs.find(ids[rows, k[rows]], ids[rows, k[rows] + 1])
                last = np.flatnonzero(at + 1 >= ids.shape[1])
                rank[last, at[last]] = NONE
        return out

    def long(self, ids: np.ndarray) -> bytes:
        """One piece too long for a padded round at every merge: the same order of merges through a heap."""
        import heapq

        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        look = lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b])
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else len(ids)
            if j >= len(ids) or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j] = r, -1
            after[k] = after[j]
            if after[k] < len(ids):
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < len(ids) and (q := look(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; a piece that is a token is that token."""
        out: list = [self.ranks[p].to_bytes(4, "little") if p in self.ranks else None for p in pieces]
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if out[k] is None and p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
            elif not p:
                out[k] = b""
        for width, at in by_width.items():
            if width > 1024:
                for k in at:
                    out[k] = self.long(self.byte[np.frombuffer(pieces[k], np.uint8)])
                continue
            step = max(1, CELLS // width)
            for a in range(0, len(at), step):
                some = at[a : a + step]
                size = np.array([len(pieces[k]) for k in some])
                ids = np.full((len(some), size.max()), -1, np.int32)
                ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)]
                for k, x in zip(some, self.merge(ids), strict=True):
                    out[k] = x
        return out

    def ids_of(self, texts: Iterable[str]) -> list[tuple[str, bytes]]:
        """Decimal and packed ids of every text, split by the pattern."""
        split = [self.pattern.findall(t) for t in texts]
        new = list(set().union(*split).difference(self.pieces))
        if len(self.pieces) + len(new) > REMEMBERED:
            self.pieces.clear()
            new = list(set().union(*split))
        packed = self.encode_pieces([p.encode("utf-8") for p in new])
        self.pieces.update((p, (" ".join(map(str, memoryview(x).cast("i"))), x)) for p, x in zip(new, packed, strict=True))
        look = self.pieces.__getitem__
        out = []
        for parts in split:
            if len(parts) == 1:
                out.append(look(parts[0]))
            else:
                got = [look(p) for p in parts]
                out.append((" ".join([x[0] for x in got]), b"".join([x[1] for x in got])))
        return out

    def learn(self, chunks: list[str]) -> None:
        """Remembers chunks, each a blank and what follows up to the next blank.

        Where single blanks alone lie between chunks, no piece crosses them. A chunk that is
        empty or starts or ends with white space is remembered as None: its text is split whole.
        """
        good = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        self.chunks.update(dict.fromkeys(chunks))
        self.chunks.update(zip(good, self.ids_of([f" {c}" for c in good]), strict=True))

    def encode(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each text its chunks as decimal and packed ids."""
        split = [t.split(" ") for t in texts]
        new = set().union(*(p[1:] for p in split)).difference(self.chunks)
        if len(self.chunks) + len(new) > REMEMBERED:
            self.chunks.clear()
            new = set().union(*(p[1:] for p in split))
        self.learn(list(new))
        out: list = []
        whole = []
        look = self.chunks.__getitem__
        for k, parts in enumerate(split):
            got = [look(p) for p in parts[1:]]
            regular = None not in got and not (parts[0] and parts[0][-1].isspace())
            out.append(got if regular else [])
            whole.append(parts[0] if regular else texts[k])
        for k, first in enumerate(self.ids_of(whole)):
            if first[1]:
                out[k] = [first, *out[k]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens in order."""
        size = self.size[ids]
        if not size.all():
            raise ValueError("an id is in no token file")
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        return self.flat[at].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def public_ranks() -> tuple[str, str]:
    """The rank file and split pattern that the query uses."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pieces_of(texts: list[str], most: int) -> Iterable[tuple[int, int]]:
    """Slices of a batch with about so many characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Replaces the text column by n_tokens and ids, in place of columns of these names. Null or empty text: no ids.

    Every row is encoded alone and whole, and fails unless its ids decode to its bytes; repeated rows are encoded alike.
    """
    docs = docs.drop("n_tokens", "ids")
    keep = [c for c in docs.columns if c != text]

    @tidied
    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in pieces_of(texts, TOGETHER):
                rows = [np.frombuffer(b"".join([x[1] for x in doc]), np.int32) for doc in c.encode(texts[a:b])]
                if any(c.decode(r) != t.encode() for r, t in zip(rows, texts[a:b], strict=True)):
                    raise ValueError("ids don't decode to their text")
                sizes = np.array([len(r) for r in rows])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(sizes), ids], [*keep, "n_tokens", "ids"])
        c.forget()

    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes if c != text), "n_tokens long, ids array<int>"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Replaces ids by the bytes they stand for, as text, in place of a column of that name. A null list gives the empty text; an unknown id fails."""
    encoded = encoded.drop("text")
    keep = [c for c in encoded.columns if c != ids]

    @tidied
    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            got = [c.decode(np.array(x or (), np.int64)).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string())], [*keep, "text"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in encoded.dtypes if c != ids), "text string"])
    return encoded.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes doc_id and text, and returns the count and the digests of ids and decoded bytes."""

    @tidied
    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, said, decoded = [], [], []
            for a, b in pieces_of(texts, TOGETHER):
                for doc in c.encode(texts[a:b]):
                    ids = np.frombuffer(b"".join([x[1] for x in doc]), np.int32)
                    n.append(len(ids))
                    said.append(hashlib.sha256(" ".join([x[0] for x in doc]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_ranks())


def token_ids(docs: DataFrame) -> DataFrame:
    """Pipeline stage: doc_id, n_tokens and ids of every document."""
    return encode(docs.select("doc_id", "text"), *public_ranks())
