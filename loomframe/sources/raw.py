"""Raw pictures and sound, their descriptions beside them, and reports as files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed clips of the smallest corpus: name, pattern, width, height, frames.
PRESETS = (
    ("flat", "flat", 64, 64, 16), ("gradient", "ramp", 64, 64, 16), ("moving_square", "square", 128, 128, 24), ("scrolling_bars", "bars", 128, 128, 24),
    ("checker", "checker", 64, 64, 16), ("noise", "noise", 64, 64, 16), ("scene_cut", "cut", 128, 128, 24),
)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "name string, pattern string, width long, height long, frames long")


def frame_bytes(width: Column, height: Column) -> Column:
    """Bytes of a picture with chroma of half the width and height, rounded up."""
    return width * height + 2 * F.floor((width + 1) / 2) * F.floor((height + 1) / 2)


def metadata(clips: DataFrame, fps: int = 30) -> DataFrame:
    """What is written beside a clip: its sides, rate, frames and bytes, as columns and as a JSON document."""
    size = (frame_bytes(F.col("width"), F.col("height")) * F.col("frames")).cast("long")
    m = clips.select("name", "pattern", "width", "height", F.lit(fps).cast("long").alias("fps"), "frames", F.lit("yuv420p").alias("format"), size.alias("bytes"))
    return m.select("*", F.to_json(F.struct("pattern", "width", "height", "fps", "frames", "format", "bytes")).alias("document"))


def discover(spark: SparkSession, folder: str, ending: str = "yuv") -> DataFrame:
    """Raw files of a folder by name, with their length and the text of the JSON file beside each, null if there is none. Contents of the raw files aren't read."""
    at = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    raw = at(f"*.{ending}").select("path", "length", stem.alias("stem"))
    beside = at("*.json").select(stem.alias("stem"), F.col("content").cast("string").alias("document"))
    return raw.join(beside, "stem", "left").select("path", "length", "document")


def scan_yuv(files: DataFrame, width: int, height: int) -> DataFrame:
    """path, frame, y, u, v (binary) and error of files (path, content) of pictures; a file that isn't whole frames has one row with the error."""
    luma, chroma = width * height, -(-width // 2) * -(-height // 2)

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, rest = divmod(len(data), luma + 2 * chroma)
                rows = [(path, k, *(data[a + o : a + o + s] for o, s in ((0, luma), (luma, chroma), (luma + chroma, chroma))), None) for k in range(n) for a in (k * (luma + 2 * chroma),)] if not rest and n else [(path, None, None, None, None, "size")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()), strict=True)], ["path", "frame", "y", "u", "v", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, frame long, y binary, u binary, v binary, error string")


def scan_pcm(files: DataFrame, channels: int) -> DataFrame:
    """path, channel and samples (array) of files (path, content) of 16-bit little-endian sound; an incomplete last sample is left out."""

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, "<i2", len(data) // (2 * channels) * channels).reshape(-1, channels)
                yield pa.RecordBatch.from_arrays([pa.array([path] * channels), pa.array(range(channels), pa.int64()), pa.array([s[:, c].astype(int).tolist() for c in range(channels)], pa.list_(pa.int64()))], ["path", "channel", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, channel long, samples array<long>")


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents, one on a line; fields that are null are left out."""
    rows.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def read_report(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A report back by its schema: a document that doesn't fit fails the read, or is left out where it isn't strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
