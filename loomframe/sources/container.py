"""Packet containers: files of checksummed blocks, scanned into rows and written from rows.

The file's magic is a parameter. Files are read through Spark's binaryFile source, so any
store that Spark reads will do; each file is scanned by one task, files in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.codecs import crc32c

# Fixed values of the format: block magic, block kinds, sizes and caps.
BLOCK_MAGIC = b"SBLK"
PACKET, CUE, INDEX = 1, 2, 3
MAX_TRACKS, MAX_CONFIG, MAX_BODY, RESYNC = 1024, 1 << 20, 16 << 20, 8192
KINDS = {1: "audio", 2: "video", 3: "data", 4: "subtitle", 5: "metadata", 6: "attachment"}

_head, _track, _block, _packet, _entry = (struct.Struct(f"<{f}") for f in ("HHIHHI", "HBBHHII", "4sBBHII", "HHQQQI", "QQHHQ"))

BLOCKS = "path string, offset long, kind string, track_id int, flags int, sequence long, pts long, dts long, payload binary, cue_id long, packet_number long, file_offset long, error string"
TRACKS = "path string, version int, file_flags int, cue_interval long, track_id int, kind string, codec_id int, flags int, timescale long, config binary, error string"


class Damaged(ValueError):
    """A file breaks the format."""


def checksum(version: int, data: bytes) -> int:
    return crc32c(data) if version >= 2 else zlib.crc32(data)


def header(data: bytes, magic: bytes, old_magic: bytes) -> tuple[dict, int]:
    """Fields of the file header, and where the tracks start. The old magic goes with version 1 alone."""
    new = data.startswith(magic)
    if not new and not data.startswith(old_magic):
        raise Damaged("magic")
    at = len(magic if new else old_magic)
    if len(data) < at + _head.size:
        raise Damaged("short header")
    version, flags, length, n, _, cues = _head.unpack_from(data, at)
    if version not in (1, 2) or new != (version == 2):
        raise Damaged("version")
    if length != at + _head.size:
        raise Damaged("header length")
    if n > MAX_TRACKS:
        raise Damaged("too many tracks")
    return {"version": version, "file_flags": flags, "cue_interval": cues, "n": n}, length


def tracks_of(data: bytes, magic: bytes, old_magic: bytes) -> tuple[dict, list[dict], int]:
    h, at = header(data, magic, old_magic)
    out = []
    for _ in range(h["n"]):
        if len(data) < at + _track.size:
            raise Damaged("short track")
        track_id, kind, _, codec, flags, timescale, size = _track.unpack_from(data, at)
        at += _track.size
        if kind not in KINDS or size > MAX_CONFIG or len(data) < at + size:
            raise Damaged("track")
        out.append({"track_id": track_id, "kind": KINDS[kind], "codec_id": codec, "flags": flags, "timescale": timescale, "config": data[at : at + size]})
        at += size
    return h, out, at


def entries(body: bytes, count: int) -> list[dict]:
    if len(body) != count * _entry.size:
        raise Damaged("entries")
    return [dict(zip(("packet_number", "file_offset", "track_id", "flags", "pts"), x, strict=True)) for x in _entry.iter_unpack(body)]


def blocks_of(data: bytes, magic: bytes, old_magic: bytes) -> Iterator[dict]:
    """Rows of packets, cue entries and index entries in file order.

    A damaged block header is skipped to the next block magic within RESYNC bytes; a damaged body ends the scan with an error row, as does a missing next block. A cut-off header ends it quietly.
    """
    h, _, at = tracks_of(data, magic, old_magic)
    while at + _block.size + 4 <= len(data):
        mark, kind, _, _, size, body_sum = _block.unpack_from(data, at)
        (head_sum,) = struct.unpack_from("<I", data, at + _block.size)
        if mark != BLOCK_MAGIC or head_sum != checksum(h["version"], data[at : at + _block.size]) or kind not in (PACKET, CUE, INDEX) or size > MAX_BODY:
            to = data.find(BLOCK_MAGIC, at + 1, at + RESYNC)
            if to < 0:
                raise Damaged("block header")
            at = to
            continue
        start = at + _block.size + 4
        body = data[start : start + size]
        if len(body) < size or checksum(h["version"], body) != body_sum:
            raise Damaged("block body")
        if kind == PACKET:
            if size < _packet.size:
                raise Damaged("packet")
            track_id, flags, sequence, pts, dts, length = _packet.unpack_from(body)
            if size != _packet.size + length:
                raise Damaged("packet")
            yield {"offset": at, "kind": "packet", "track_id": track_id, "flags": flags, "sequence": sequence, "pts": pts, "dts": dts, "payload": body[_packet.size :]}
        elif kind == CUE:
            cue_id, _, count = struct.unpack_from("<QQI", body)
            yield from ({"offset": at, "kind": "cue", "cue_id": cue_id, **e} for e in entries(body[20:], count))
        else:
            yield from ({"offset": at, "kind": "index", **e} for e in entries(body[4:], struct.unpack_from("<I", body)[0]))
        at = start + size


def _rows(names: list[str], found: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names, dtype=object)


def _scan(files: DataFrame, schema: str, one) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"], strict=True):
                found: list[dict] = []
                try:
                    for r in one(bytes(data)):
                        found.append({"path": where, **r})
                        if len(found) >= 4096:
                            yield _rows(names, found)
                            found = []
                except (Damaged, struct.error) as e:
                    found.append({"path": where, "error": str(e)})
                yield _rows(names, found)

    return files.select("path", "content").mapInPandas(run, schema)


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files in any store that Spark reads; a file is one value, of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan_tracks(spark: SparkSession, path: str, magic: bytes, old_magic: bytes) -> DataFrame:
    """A row for each track of each file; a file that breaks the format has one row with the error."""

    def one(data: bytes):
        h, tracks, _ = tracks_of(data, magic, old_magic)
        return ({**{k: h[k] for k in ("version", "file_flags", "cue_interval")}, **t} for t in tracks)

    return _scan(files_at(spark, path), TRACKS, one)


def scan_blocks(spark: SparkSession, path: str, magic: bytes, old_magic: bytes) -> DataFrame:
    """A row for each packet, cue entry and index entry of each file."""
    return blocks_in(files_at(spark, path), magic, old_magic)


def blocks_in(files: DataFrame, magic: bytes, old_magic: bytes) -> DataFrame:
    """The same from files (path, content) in a frame."""
    return _scan(files, BLOCKS, lambda data: blocks_of(data, magic, old_magic))


def rebuilt_index(blocks: DataFrame) -> DataFrame:
    """Index entries of each file: those of its index block, or else its packets and all cue entries, twice where a cue repeats a packet."""
    has = blocks.groupBy("path").agg(F.max(F.col("kind") == "index").alias("has"))
    own = blocks.where("kind is not null").join(has, "path").where("kind = 'index' or not has")
    return own.select("path", F.coalesce("packet_number", "sequence").alias("packet_number"), F.coalesce("file_offset", "offset").alias("file_offset"), "track_id", "flags", "pts")


def block(version: int, kind: int, body: bytes) -> bytes:
    head = _block.pack(BLOCK_MAGIC, kind, 0, 0, len(body), checksum(version, body))
    return head + struct.pack("<I", checksum(version, head)) + body


def file_of(pdf: pd.DataFrame, tracks: list[tuple[int, int, int, int]], magic: bytes, cue_interval: int) -> bytes:
    """The bytes of one file."""
    out = bytearray(magic + _head.pack(2, 0, len(magic) + _head.size, len(tracks), 0, cue_interval))
    for track_id, kind, codec, timescale in tracks:
        out += _track.pack(track_id, kind, 0, codec, 0, timescale, 0)
    every, cue = [], []

    def flush(cue_id: int) -> None:
        body = struct.pack("<QQI", cue_id, cue[0][0], len(cue)) + b"".join(_entry.pack(*e) for e in cue)
        out.extend(block(2, CUE, body))
        cue.clear()

    for n, r in enumerate(pdf.sort_values("sequence").itertuples()):
        e = (n, len(out), int(r.track_id), int(r.flags), int(r.pts))
        every.append(e), cue.append(e)
        payload = bytes(r.payload)
        out += block(2, PACKET, _packet.pack(e[2], e[3], n, e[4], int(r.dts), len(payload)) + payload)
        if cue_interval and len(cue) == cue_interval:
            flush(n // cue_interval)
    if cue:
        flush(len(every) // max(1, cue_interval))
    out += block(2, INDEX, struct.pack("<I", len(every)) + b"".join(_entry.pack(*e) for e in every))
    return bytes(out)


def mux(packets: DataFrame, tracks: list[tuple[int, int, int, int]], magic: bytes, cue_interval: int = 32) -> DataFrame:
    """file and content (binary) from packets (file, track_id, flags, pts, dts, payload, sequence): blocks in order of sequence, cues, and an index at the end.

    tracks lists id, kind, codec and timescale. A file is serial, so one task makes it; files are made in parallel.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [file_of(pdf, tracks, magic, cue_interval)]})

    return packets.groupBy("file").applyInPandas(one, "file string, content binary")


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Writes files (file, content) into a folder that all executors share: file and bytes of each, once it is complete.

    A task writes to a name of its own first and renames it, so a repeated task leaves one whole file.
    """

    def run(batches):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, str(name)))
            yield pd.DataFrame({"file": pdf["file"], "bytes": pdf["content"].map(len)})

    return made.select("file", "content").mapInPandas(run, "file string, bytes long")
