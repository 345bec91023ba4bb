"""Round trips of codecs and containers, hostile files, and streams against batches."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.functions import codecs
from loomframe.operators import packets as P
from loomframe.plans.relations import relation
from loomframe.sources import container as C
from loomframe.sources import raw
from loomframe.streaming import ordered

SF = "/root/testdata/sf0.001"
MAGIC, OLD = b"LOOMF2\0\0", b"LOOM"


def test_crc32c_known_values():
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(b"") == 0
    assert codecs.crc32c_many([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, codecs.crc32c(b"a")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-30_000, 30_000), max_size=80))
def test_round_trips(v):
    assert codecs.lpc_decode(codecs.lpc_encode(v)) == v
    assert codecs.runs_decode(codecs.runs_encode(v)) == v
    b = [x & 255 for x in v]
    assert codecs.RangeModel.uniform(256).decode(codecs.RangeModel.uniform(256).encode(b), len(b)) == b
    m = codecs.RangeModel([4096 - 255, *[1] * 255])
    assert m.decode(m.encode(b), len(b)) == b


def test_varints_refuse_cut_off_numbers():
    assert codecs.read_varint(codecs.write_varint(300)) == (300, 2)
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            codecs.read_varint(bad)
    with pytest.raises(ValueError):
        codecs.RangeModel([1, 2])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.binary(min_size=1000, max_size=5000))
def test_crc32c_is_the_bytewise_one(data):
    assert codecs.crc32c(data) == int(codecs.crc32c_many([data])[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 20), st.integers(21, 40)), max_size=30))
def test_bits_come_back(values):
    assert codecs.unpack_bits(codecs.pack_bits(values), [w for _, w in values]) == [v for v, _ in values]


def test_bits_refuse_what_doesnt_fit():
    with pytest.raises(ValueError):
        codecs.pack_bits([(4, 2)])
    with pytest.raises(ValueError):
        codecs.unpack_bits(b"a", [9])


@pytest.mark.parametrize("codec", ["varint", "rans", "contexts", "bits", "lpc", "runs"])
def test_codecs_over_tables(spark, codec):
    audio = relation(spark, SF, "audio").where("stream < 20")
    got = codecs.round_trips(audio, "stream", "p", "s", codec).collect()
    assert len(got) == 20 and all(r.ok and r.n == 64 for r in got)


def test_crc_column(spark):
    got = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "b binary").select(codecs.crc32c_column("b").alias("c")).collect()
    assert [r.c for r in got] == [0xE3069283, None, 0]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    p = relation(spark, SF, "packets").where("sequence < 200").select(F.concat(F.lit("f"), (F.col("sequence") % 2).cast("string")).alias("file"), "track_id", "flags", "sequence", F.col("pts").alias("pts"), F.col("pts").alias("dts"), F.col("size").cast("string").cast("binary").alias("payload"))
    made = {r.file: bytes(r.content) for r in C.mux(p, [(1, 2, 7, 90000), (2, 1, 8, 48000), (3, 3, 9, 1000)], MAGIC, 32).collect()}
    for name, data in made.items():
        (at / name).write_bytes(data)
    return at, made


def test_containers_come_back(spark, files):
    at, made = files
    tracks = C.scan_tracks(spark, str(at), MAGIC, OLD).collect()
    assert len(tracks) == 6 and {t.kind for t in tracks} == {"video", "audio", "data"} and all(t.error is None for t in tracks)
    blocks = C.scan_blocks(spark, str(at), MAGIC, OLD)
    n = {r.kind: r.n for r in blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"packet": 200, "cue": 200, "index": 200}
    assert C.rebuilt_index(blocks).count() == 200
    cut = at / "cut"
    cut.mkdir(exist_ok=True)
    (cut / "f").write_bytes(made["f0"][: made["f0"].rindex(C.BLOCK_MAGIC)])
    assert C.rebuilt_index(C.scan_blocks(spark, str(cut), MAGIC, OLD)).count() == 200  # 100 packets and 100 cue entries


def test_files_are_written_whole(spark, files, tmp_path):
    _, made = files
    folder = str(tmp_path / "written")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "file string, content binary")
    for _ in range(2):
        assert {r.file: r.bytes for r in C.write_files(df, folder).collect()} == {k: len(v) for k, v in made.items()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "written").iterdir()} == made


def test_raw_files_and_reports(spark, tmp_path):
    one = bytes(range(24)) * 2  # two frames of 4 by 4
    for name, data in (("b.yuv", one), ("a.yuv", one[:-1]), ("b.json", b'{"width":4}')):
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.document) for r in raw.discover(spark, str(tmp_path)).collect()}
    assert found == {"a.yuv": (47, None), "b.yuv": (48, '{"width":4}')}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yuv").load(str(tmp_path))
    rows = raw.scan_yuv(files, 4, 4).collect()
    assert sorted((r.frame, bytes(r.y), bytes(r.u), bytes(r.v)) for r in rows if r.error is None) == [(k, one[:16], one[16:20], one[20:24]) for k in (0, 1)]
    assert [r.path.endswith("a.yuv") for r in rows if r.error == "size"] == [True]
    sound = spark.createDataFrame([("s", bytearray([1, 0, 255, 255, 2, 0, 0, 128, 9]))], "path string, content binary")
    assert sorted((r.channel, r.samples) for r in raw.scan_pcm(sound, 2).collect()) == [(0, [1, 2]), (1, [-1, -32768])]
    report = str(tmp_path / "report")
    raw.write_report(spark.createDataFrame([(1, None), (2, "x")], "id long, note string"), report)
    assert sorted((r.id, r.note) for r in raw.read_report(spark, report, "id long, note string").collect()) == [(1, None), (2, "x")]
    (tmp_path / "bad.json").write_text('{"id": "word"}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        raw.read_report(spark, str(tmp_path / "bad.json"), "id long").collect()
    assert raw.read_report(spark, str(tmp_path / "bad.json"), "id long", strict=False).collect() == []


def test_damaged_files_are_told(spark, files, tmp_path):
    _, made = files
    data = made["f1"]
    second = data.index(C.BLOCK_MAGIC, data.index(C.BLOCK_MAGIC) + 1)
    cases = {
        "magic": b"XXXX" + data[4:],
        "block body": data[: second - 1] + bytes([data[second - 1] ^ 1]) + data[second:],
        "short header": data[:10],
    }
    for name, bad in cases.items():
        where = tmp_path / name.replace(" ", "_")
        where.mkdir()
        (where / "f").write_bytes(bad)
        assert [r.error for r in C.scan_blocks(spark, str(where), MAGIC, OLD).where("error is not null").collect()] == [name]
    skipped = list(C.blocks_of(data[: second + 5] + b"\x99" + data[second + 6 :], MAGIC, OLD))
    assert sum(r["kind"] == "packet" for r in skipped) == 99
    assert C.checksum(1, b"a") == zlib.crc32(b"a") and C.checksum(2, b"a") == codecs.crc32c(b"a")


def streamed(spark, tmp_path, df, make, mode, parts):
    src = str(tmp_path / "in")
    for k in range(parts):
        df.where(f"sequence % {parts} = {k}" if mode == "append" else f"sequence div 500 = {k}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.format("memory").queryName("out").outputMode(mode.split("-")[0]).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("select * from out")


def test_stream_puts_packets_in_order(spark, tmp_path):
    p = relation(spark, SF, "packets").where("sequence < 90").select(F.lit(1).cast("long").alias("track_id"), "sequence", "size")
    got = streamed(spark, tmp_path, p, ordered.in_order, "append", 3).collect()
    assert sorted(r.sequence for r in got) == list(range(90)) and all(r.skipped == 0 for r in got)


def test_stream_rate_control_is_the_batch_one(spark, tmp_path):
    p = relation(spark, SF, "packets").select("track_id", "sequence", "size", "flags").where("sequence < 1000")
    out = streamed(spark, tmp_path, p, lambda s: ordered.rate_state(s, 28, 10, 44, 1, 2000), "update", 2)
    last = {r.track_id: (r.packets, r.qp) for r in out.orderBy("packets").collect()}
    assert last == {r.track_id: (r.packets, r.qp) for r in P.rate_control(p, 28, 10, 44, 1, 2000, 64).collect()}


def test_stream_references_are_the_batch_ones(spark, tmp_path):
    p = relation(spark, SF, "packets").where("sequence < 1000")
    rows = p.select(F.col("track_id").alias("stream"), F.col("sequence").alias("frame"), P.has(P.KEYFRAME).alias("keyframe"), "sequence")
    out = streamed(spark, tmp_path, rows, lambda s: ordered.reference_state(s.drop("sequence")), "append-by-range", 2)
    want = {(r.track_id, r.sequence): (r.nearest, r.held) for r in P.reference_slots(p).collect()}
    assert {(r.stream, r.frame): (r.nearest, r.held) for r in out.collect()} == want
