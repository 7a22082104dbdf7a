import pytest

from bitwave.functions import header, metadata
from bitwave.functions.bits import Bits, align, bit_slice
from bitwave.sources.files import frame_length
from tests.frames_for_tests import word

GOOD = [
    ((3, 1, 1, 9, 0, 0, 1), dict(frame_size_bytes=417, samples_per_frame=1152, header_bytes=4, channels=2, side_info_bytes=32)),
    ((3, 1, 0, 9, 0, 1, 0), dict(frame_size_bytes=418, header_bytes=6, has_crc=1)),
    ((3, 1, 1, 14, 1, 0, 3), dict(frame_size_bytes=960, channels=1, side_info_bytes=17)),
    ((3, 1, 1, 6, 2, 0, 2), dict(frame_size_bytes=360)),
    ((2, 1, 1, 8, 0, 0, 0), dict(frame_size_bytes=208, samples_per_frame=576, side_info_bytes=17)),
    ((0, 1, 1, 1, 2, 0, 3), dict(frame_size_bytes=72, side_info_bytes=9)),
]
BAD = [(word(version=1), -1), (word(layer=0), -1), (word(layer=2), -2), (word(layer=3), -2), (word(bitrate=15), -1), (word(bitrate=0), -2), (word(rate=3), -1), (word(emphasis=2), -1), (0x7FFB9000, -1), (0, -1)]


def test_header_words(spark):
    rows = [(i, word(*fields)) for i, (fields, _) in enumerate(GOOD)] + [(100 + i, w) for i, (w, _) in enumerate(BAD)]
    got = {r.i: r for r in header.with_header(spark.createDataFrame(rows, "i int, header_word long")).collect()}
    for i, (fields, want) in enumerate(GOOD):
        assert got[i].status == 0
        assert {k: got[i][k] for k in want} == want
        assert frame_length(word(*fields)) == want["frame_size_bytes"]
    for i, (w, status) in enumerate(BAD):
        assert got[100 + i].status == status and frame_length(w) == 0


def test_headers_in_bytes(spark):
    whole = word(mode=0).to_bytes(4, "big")
    rows = [(0, None), (1, b"\xff\xfb"), (2, whole + bytes(196)), (3, whole + bytes(413)), (4, b"\x7f\xfb\x90\x00")]
    got = {r.i: r for r in header.parse_header(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert [got[i].status for i in range(5)] == [-3, 1, 1, 0, -1]
    assert (got[2].frame_size_bytes, got[2].bitrate_kbps) == (417, 128)


def test_tags(spark):
    tag = lambda major, flags, size: b"ID3" + bytes([major, 0, flags, 0, 0, 0, size])
    rows = [(0, tag(3, 0, 90)), (1, tag(4, 16, 40)), (2, b"\xff\xfb\x90\x64" * 3), (3, b"ID3\x03\x00"), (4, None), (5, b"ID3\x05\0\0\0\0\0\0"), (6, b"ID3\x03\0\0\x80\0\0\0")]
    df = spark.createDataFrame(rows, "i int, content binary")
    got = {r.i: (r.s, r.n) for r in df.select("i", metadata.id3_status(df.content).alias("s"), metadata.id3_size(df.content).alias("n")).collect()}
    assert got == {0: (0, 100), 1: (0, 60), 2: (-4, 0), 3: (1, 0), 4: (-3, 0), 5: (-1, 0), 6: (-1, 0)}


def test_stream_header_at_a_fixed_place(spark):
    vbri = bytes(36) + b"VBRI" + bytes(4) + (75).to_bytes(2, "big") + (50000).to_bytes(4, "big") + (150).to_bytes(4, "big") + bytes(20)
    df = spark.createDataFrame([(vbri, 21), (bytes(80), 36)], "content binary, side_start int")
    a, b = metadata.with_stream_header(df).collect()
    assert (a.vbr_status, a.is_vbr, a.total_frames, a.total_bytes, a.quality) == (0, 1, 150, 50000, 75)
    assert (b.vbr_status, b.has_vbr_header) == (-4, 0)


def test_bit_slices(spark):
    data = bytes([0xB1, 0xF0, 0xAA, 0x55, 0x0F, 0x33])
    rows = [(p, data) for p in range(49)]
    for width in (1, 7, 13, 32):
        df = spark.createDataFrame(rows, "p long, c binary")
        whole = "".join(f"{b:08b}" for b in data)
        for r in df.select("p", bit_slice(df.c, df.p, width).alias("v"), align(df.p).alias("a")).collect():
            assert r.v == (int(whole[r.p : r.p + width], 2) if r.p + width <= 48 else None)
            assert r.a == -(-r.p // 8) * 8


def test_bit_reader():
    b = Bits(bytes([0xB1, 0xF0, 0xAA, 0x55]))
    assert (b.read(1), b.read(3), b.read(4), b.read(8)) == (1, 3, 1, 0xF0)
    b.skip(20)
    assert b.error and b.pos == 32 and b.read(1) == 0
    assert Bits(b"").read(1) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_buffers(spark, n):
    df = spark.createDataFrame([(bytes(n),)], "content binary")
    assert header.parse_header(df).first().status == 1
