"""Token ids in a content-addressed store.

A document's ids are cut where a rolling hash of the last ids hits a mask, so equal
runs of ids give equal chunks wherever they stand. Each chunk is named by a digest
of its bytes and stored once; a document is a recipe of chunk names under a Merkle
root. Recipes are written in ascending order of ids, and the manifest chains the
roots of each part of them.

Layout under the store's path:
  objects/kind=0   key (chunk digest), n, payload (ids, little-endian, 2 bytes each where the vocabulary allows, else 4)
  recipes          part, place (in the part), doc_id, before (ids of the part's documents before), n, key (Merkle root), payload (chunk digests), sizes (ids in each chunk, unsigned 32-bit)
  manifest         part, n_docs, n_tokens, start (ids of all parts before), first_doc, last_doc, digest (of the part's ids and roots, and of the part before)
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import by_key, cut, drop_scratch, partitions, scratch, table, tidied

#: Steps that double the ids under the rolling hash up to 16, least and most ids of a chunk, and the mask: 256 ids between cuts on average.
SPANS, LEAST, MOST, MASK = (1, 2, 4, 8), 64, 2048, np.uint32(0xFF << 16)
DIGEST = 16
#: Words that a worker remembers, characters encoded together (at least one document), words of one text that the library gets.
REMEMBERED, TOGETHER, LINE = 300_000, 2_000_000, 500
#: A word that starts a line or a text or neither: letters, and marks behind them. Code points from U+0500 on aren't sure to be classed alike by all libraries.
SHAPE = r"^(?P<mark>[\n\r]?)(?P<head>\p{L}+)(?P<tail>[!-/:-@\[-`{-~]*)$"
UNSURE = r"[^\x{0}-\x{4FF}]"


class Ragged:
    """Strings with the ids of each: a table that is looked up in Arrow, and in which words not met again make room when it is full. A size of -1 marks a word without ids of its own."""

    def __init__(self, most: int):
        self.most = most
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.size, self.met = np.empty(0, np.int64), np.empty(0, bool)

    def find(self, words: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[at[at >= 0]] = True
        return at

    def numbers(self, words: pa.Array, spell: Callable) -> np.ndarray:
        """Number of each different word; those not known yet get their ids and sizes from spell."""
        at = self.find(words)
        more = int((at < 0).sum())
        if more and len(self.words) + more > self.most:
            keep = np.flatnonzero(self.met)
            if len(keep) + more > self.most:
                keep = keep[:0]
            self.ids, self.size, self.words = gather(self.ids, np.maximum(self.size, 0), keep), self.size[keep], self.words.take(pa.array(keep))
            self.met = np.zeros(len(keep), bool)
            at = self.find(words)
        if more:
            new = words.filter(pa.array(at < 0))
            ids, size = spell(new)
            at[at < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids, self.size, self.met = np.concatenate([self.ids, ids]), np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(size), bool)])
        return at


def gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of these numbers, one after the other."""
    own = size[at]
    shift = (np.cumsum(size) - size)[at] - (np.cumsum(own) - own)
    return flat[np.repeat(shift, own) + np.arange(own.sum())]


class LibraryCoder:
    """Encodes with the tokenizers library, which gets each different word once.

    The file's pre-tokenizer never joins two words that a single blank or line end parts,
    nor letters with the marks that follow them, so words, line starts and closing marks are
    encoded apart. Texts with other white space or the library's added tokens go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers as split
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plain = split.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}
        for mark, side in ((" ", "merged_with_next"), ("\n", "isolated")):
            self.letters[mark] = Tokenizer.from_file(path)
            self.letters[mark].pre_tokenizer = split.Sequence([split.Split(mark, side), plain])
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[k for t, k in vocabulary.items() if t.startswith("Ġ")]] = True
        (self.newline,) = self.library(["\n"])[0]
        self.words, self.heads = Ragged(REMEMBERED), Ragged(REMEMBERED)

    @property
    def vocabulary(self) -> int:
        return len(self.blank)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: pa.Array, mark: str, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words that each stand after a mark; the mark's own id is left out where it is a line end."""
        if not len(words):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        coder = self.letters[mark] if letters else self.whole
        lines = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), LINE), len(words)).astype(np.int32)), words)
        joined = pc.binary_join_element_wise(pa.scalar(mark), pc.binary_join(lines, mark), "").to_pylist()
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in coder.encode_batch_fast(joined, add_special_tokens=False)])
        starts = self.blank[ids] if mark == " " else ids == self.newline
        size = np.diff(np.append(np.flatnonzero(starts), len(ids)))
        if len(size) != len(words):
            raise ValueError("the library's words are not the given ones")
        return (ids, size) if mark == " " else (ids[~starts], size - 1)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and their number, -1 for a word whose text must be given whole.

        A word starts with a line end where one stands before it, with a return where it is a text's first, and else follows a blank.
        """
        found = pc.extract_regex(new, SHAPE)
        usual = pc.and_(pc.is_valid(found), pc.invert(pc.match_substring_regex(new, UNSURE)))
        for x in self.added:
            usual = pc.and_(usual, pc.invert(pc.match_substring(new, x)))
        before, head, tail = (pc.filter(pc.struct_field(found, k), usual) for k in range(3))
        line_end, whole = np.zeros(len(new), bool), np.zeros(len(new), bool)
        usual = usual.to_numpy(zero_copy_only=False)
        line_end[usual] = pc.equal(before, "\n").to_numpy(zero_copy_only=False)
        mark = pc.if_else(pc.equal(before, ""), " ", "\n")
        one = [pc.binary_join_element_wise(mark, head, ""), pc.if_else(pc.equal(tail, ""), "", pc.binary_join_element_wise(pa.scalar("\n"), tail, ""))]
        rest, other = np.flatnonzero(~usual), []
        for k, w in zip(rest.tolist(), new.filter(pa.array(~usual)).to_pylist(), strict=True):
            mark, part = " ", ""
            if w[:1] == "\n":
                line_end[k], mark, w = True, "\n", w[1:]
            only = w[:1] == "\r"
            if only:
                mark, w = "\n", w[1:]
            if (w.split() != [w] and not (only and not w)) or any(x in w for x in self.added):
                line_end[k], whole[k] = False, True
            elif w:
                part = mark + w
            other.append(part)
        ids, n = self.parts(pa.concat_arrays([*one, pa.array(other, pa.string())]))
        # line end, first part and second part of each word, one after the other; number 0 is an empty run
        flat, lengths = np.concatenate([[np.uint32(self.newline)], ids]).astype(np.uint32), np.concatenate([[0, 1], n])
        at, m = np.zeros((len(new), 3), np.int64), len(head)
        at[:, 0] = line_end
        at[usual, 1], at[usual, 2] = 2 + np.arange(m), 2 + m + np.arange(m)
        at[rest, 1] = 2 + 2 * m + np.arange(len(rest))
        return gather(flat, lengths, at.ravel()), np.where(whole, -1, lengths[at].sum(1))

    def parts(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of parts, each a mark and a word without white space; the empty part has none."""

        def spell(new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            letters = pc.and_(pc.match_substring_regex(new, r"^[ \n]\p{L}+$"), pc.invert(pc.match_substring_regex(new, UNSURE))).to_numpy(zero_copy_only=False)
            words, blank = pc.utf8_slice_codeunits(new, 1), pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
            empty = pc.equal(new, "").to_numpy(zero_copy_only=False)
            size, ids, order = np.zeros(len(new), np.int64), [], [np.flatnonzero(empty)]
            for mark, sure in itertools.product(" \n", (True, False)):
                own = np.flatnonzero((blank == (mark == " ")) & (letters == sure) & ~empty)
                found, size[own] = self.together(words.take(pa.array(own)), mark, sure)
                ids.append(found), order.append(own)
            order = np.concatenate(order)
            return gather(np.concatenate(ids), size[order], np.argsort(order)), size

        coded = wanted.dictionary_encode()
        at = self.heads.numbers(coded.dictionary, spell)[coded.indices.to_numpy()]
        return gather(self.heads.ids, self.heads.size, at), self.heads.size[at]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number by text; with an end id after each, if given."""
        marked = pc.binary_join_element_wise(pa.scalar("\r"), pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(marked, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        kinds, word = coded.dictionary, coded.indices.to_numpy()
        at = self.words.numbers(kinds, self.learn)
        # only the first word of a text may start with a return: in others it is the text's own
        stray = pc.starts_with(kinds, "\r").to_numpy(zero_copy_only=False)[word]
        stray[offsets[:-1] - offsets[0]] = False
        return self.joined(texts, at[word], stray, np.diff(offsets), end_id)

    def joined(self, texts: pa.Array, word: np.ndarray, stray: np.ndarray, n: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Puts words together; texts with a word that can't stand alone are encoded whole."""
        text = np.repeat(np.arange(len(n)), n)
        whole = np.unique(text[(self.words.size[word] < 0) | stray])
        late = np.isin(text, whole)
        known = np.maximum(self.words.size, 0)
        own = self.library(texts.take(pa.array(whole)).to_pylist()) if len(whole) else []
        extra = [np.array(x, np.uint32) for x in own] + ([np.array([end_id], np.uint32)] if end_id is not None else [])
        flat = np.concatenate([self.words.ids, *extra])
        lengths = np.concatenate([known, [len(x) for x in extra]]).astype(np.int64)
        word, text = word[~late], text[~late]
        word = np.concatenate([word, len(known) + np.arange(len(whole))])
        text = np.concatenate([text, whole])
        if end_id is not None:
            word, text = np.concatenate([word, np.full(len(n), len(lengths) - 1)]), np.concatenate([text, np.arange(len(n))])
        order = np.argsort(text, kind="stable")
        word, text = word[order], text[order]
        return gather(flat, lengths, word), np.bincount(text, weights=lengths[word], minlength=len(n)).astype(np.int64)


@lru_cache(maxsize=2)
def library_coder(path: str) -> LibraryCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryCoder(path)


_gear = np.random.default_rng(20_011).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last ids allows a cut. Streams may stand one after the other: the hash reaches back less than LEAST ids, before which none is cut."""
    g = _gear[ids & 0xFFFF]
    for j in SPANS:
        h = g.copy()
        h[j:] += g[:-j] << np.uint32(j) if j < len(g) else np.uint32(0)
        g = h
    return np.flatnonzero((g & MASK) == 0) + 1


def ends_of(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from start to end, of which marks may be cut."""
    ends, last = [], start
    for k in marks:
        while k - last > MOST:
            last += MOST
            ends.append(last)
        if k - last >= LEAST:
            last = k
            ends.append(last)
    while end - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == end else [*ends, end]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return ends_of(cut_marks(ids).tolist(), 0, len(ids)) if len(ids) else []


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged. No name: digest of nothing."""
    level = names or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def slices(texts: pa.Array, most: int):
    """Parts of a batch's texts with at most so many bytes, at least one text each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


OBJECTS = "key binary, kind int, seq long, doc_id long, n long, payload binary, sizes binary"
RECIPES = "part int, place long, doc_id long, before long, n long, key binary, payload binary, sizes binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes doc_id and text into a store. A null text is empty: its stream is the end id alone. Repeated rows keep a recipe each; a null doc_id comes first.

    Each task sends a chunk once; a shuffle by name leaves one copy of each. Recipes are then dealt by ranges of doc_id.
    """
    spark = docs.sparkSession
    wide = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("sizes", pa.binary())])

    @tidied
    def run(batches):
        from pyspark import TaskContext

        coder = library_coder(tokenizer)
        kind = "<u2" if coder.vocabulary <= 1 << 16 else "<u4"
        sent: set[bytes] = set()
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts, TOGETHER):
                ids, n = coder.encode(texts.slice(a, b - a), end_id)
                packed, wide_bytes = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                marks, stops = cut_marks(ids), np.cumsum(n)
                of = np.searchsorted(marks, np.concatenate(([0], stops)), "right")
                marks, rows, start = marks.tolist(), [], 0
                for doc_id, stop, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), stops.tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                    ends = ends_of(marks[i:j], start, stop)
                    names, begin = [], start
                    for end in ends:
                        data = packed[wide_bytes * begin : wide_bytes * end]
                        names.append(name := digest(data))
                        if name not in sent:
                            sent.add(name)
                            rows.append((name, 0, None, None, end - begin, data, None))
                        begin = end
                    rows.append((merkle(names), 1, seq := seq + 1, doc_id, stop - start, b"".join(names), np.diff([start, *ends]).astype("<u4").tobytes()))
                    start = stop
                if len(sent) > 1_000_000:
                    sent.clear()  # the shuffle still leaves one copy
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wide, strict=True)], schema=wide)

    def number(batches):
        from pyspark import TaskContext

        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(place + np.arange(m)), batch.column(0), pa.array(before + np.cumsum(n) - n), *batch.columns[1:]], ["part", "place", "doc_id", "before", "n", "key", "payload", "sizes"])
            place, before = place + m, before + int(n.sum())

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OBJECTS)
    # a recipe has a number of its own, a chunk none: one row of each chunk is left
    once = ["kind", "key", "seq"]
    rows.repartition(4 * partitions(spark), *once).sortWithinPartitions(*once).dropDuplicates(once).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    staged = objects(spark, path).where("kind = 1").select("doc_id", "n", "key", "payload", "sizes")
    staged.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_scratch(spark, f"{path}/objects/kind=1")
    lines, start, last = [], 0, b""
    for r in sorted(parts_of(spark, path).select("part", "n_docs", "n_tokens", "first_doc", "last_doc", "digest").collect()):
        last = digest(last + bytes(r.digest))
        lines.append((r.part, r.n_docs, r.n_tokens, start, r.first_doc, r.last_doc, last))
        start += r.n_tokens
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


MANIFEST = "part int, n_docs long, n_tokens long, start long, first_doc long, last_doc long, digest binary"


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """A line for each part of the recipes: number of documents and ids, first and last document, digest of its documents in order."""

    def run(tables):
        for t in tables:
            t = t.sort_by("place")
            h = hashlib.blake2b(digest_size=DIGEST)
            for doc_id, n, root in zip(*(t.column(c).to_pylist() for c in ("doc_id", "n", "key")), strict=True):
                h.update(repr((doc_id, n)).encode() + root)
            ids = t.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([t.num_rows]), pa.array([pc.sum(t.column("n")).as_py()]), pa.array([ids[0].as_py()], pa.int64()), pa.array([ids[-1].as_py()], pa.int64()), pa.array([h.digest()], pa.binary())], ["part", "n_docs", "n_tokens", "first_doc", "last_doc", "digest"])

    return by_key(recipes(spark, path).select("part", "place", "doc_id", "n", "key"), "part", run, "part int, n_docs long, n_tokens long, first_doc long, last_doc long, digest binary")


def manifest(spark: SparkSession, path: str) -> list:
    """The manifest's lines, one for each part, held against the recipes. Fails where a part is missing, added or changed."""
    lines = sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    found = {r.part: r for r in parts_of(spark, path).collect()}
    start, last = 0, b""
    for r in lines:
        own = found.pop(r.part, None)
        last = digest(last + bytes(own.digest)) if own else b""
        if own is None or (own.n_docs, own.n_tokens, own.first_doc, own.last_doc, start, last) != (r.n_docs, r.n_tokens, r.first_doc, r.last_doc, r.start, bytes(r.digest)):
            raise ValueError("the recipes don't match the manifest")
        start += own.n_tokens
    if found:
        raise ValueError("the recipes hold a part that the manifest doesn't")
    return lines


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{path}/objects")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark, path).where("kind = 0")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """root, seq, name and after (bytes, at four an id, that follow the chunk in its document) of each different recipe. Fails where a root doesn't match its names."""

    def run(batches):
        for batch in batches:
            roots, seqs, names, after = [], [], [], []
            for root, payload, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = [payload[k : k + DIGEST] for k in range(0, len(payload), DIGEST)]
                if merkle(own) != root:
                    raise ValueError("a recipe doesn't match its Merkle root")
                n = np.frombuffer(sizes, "<u4").astype(np.int64)
                roots += [root] * len(own)
                seqs += range(len(own))
                names += own
                after += (4 * (n.sum() - np.cumsum(n))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(seqs, pa.int32()), pa.array(names, pa.binary()), pa.array(after, pa.int64())], ["root", "seq", "name", "after"])

    return recipes(spark, path).groupBy("key").agg(F.first("payload").alias("payload"), F.first("sizes").alias("sizes")).mapInArrow(run, "root binary, seq int, name binary, after long")


def ids_of_payload(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array) of every recipe, put together from the chunks."""

    def join(batches):
        for batch in batches:
            ids = [np.concatenate([ids_of_payload(x["payload"], x["n"]) for x in own]).astype(np.int32) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["root", "ids"])

    by_root = parts(spark, path).join(chunks(spark, path).select(F.col("key").alias("name"), "n", "payload"), "name").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "payload"))).alias("own")).mapInArrow(join, "root binary, ids array<int>")
    return recipes(spark, path).select("doc_id", F.col("key").alias("root")).join(by_root, "root").select("doc_id", "ids")


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """Row j: what 2**j zero bytes after the data make of each bit of its crc32."""
    one = np.array([zlib.crc32(b"\0", 1 << b) ^ zlib.crc32(b"\0", 0) for b in range(32)], np.uint64)
    rows = [one]
    for _ in range(47):
        rows.append(shifted(rows[-1], rows[-1]))
    return np.array(rows)


def shifted(crc: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= np.where((crc >> np.uint64(b)) & np.uint64(1), row[b], np.uint64(0))
    return out


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The share of each part's crc32 in the crc32 of the whole, of which so many bytes follow the part."""
    for j in range(int(after.max()).bit_length() if len(after) else 0):
        on = (after >> j) & 1 == 1
        crc[on] = shifted(crc[on], shifts()[j])
    return crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every recipe, read from the files.

    Each stored chunk is read once, held against its name and summed; what a chunk adds to a
    document's crc32 follows from its own and the bytes after it, and the parts add by exclusive or.
    The manifest is held against the recipes before; it has one line, broadcast here, for each part.
    """

    def check(batches):
        for batch in batches:
            crc = []
            for name, n, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if digest(payload) != name:
                    raise ValueError("a chunk doesn't match its name")
                crc.append(zlib.crc32(ids_of_payload(payload, n).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["name", "n", "crc"])

    def share(batches):
        for batch in batches:
            crc = moved(batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64))], ["root", "n", "crc"])

    summed = chunks(spark, path).select(F.col("key").alias("name"), "n", "payload").mapInArrow(check, "name binary, n long, crc long")
    by_root = parts(spark, path).join(summed, "name").select("root", "n", "crc", "after").mapInArrow(share, "root binary, n long, crc long").groupBy("root").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    starts = spark.createDataFrame([(r.part, r.start) for r in manifest(spark, path)], "part int, start long")
    placed = recipes(spark, path).select("part", "doc_id", "before", "n", F.col("key").alias("root")).join(F.broadcast(starts), "part")
    size = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a recipe doesn't match its chunks")).cast("long"))
    return placed.join(by_root, "root").select("doc_id", (F.col("start") + F.col("before")).alias("start"), size.alias("n_tokens"), "ids_crc32")


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = scratch(spark, "store")
    write(table(spark, sf_dir, "documents"), path, public.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
