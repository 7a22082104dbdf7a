import random

import numpy as np
import pytest

from bitwave.functions import header, tables
from bitwave.functions.bits import Bits
from bitwave.operators import decode, entropy, hybrid, spectrum
from bitwave.operators.reservoir import Reservoir
from bitwave.sources import files, wav
from bitwave.streaming.decoder import Framer
from tests.frames_for_tests import frame, word


def test_scan_cases():
    one = word(mode=0).to_bytes(4, "big")
    junk = b"\x55" * 50 + one + bytes(600)
    assert files.next_frame(junk, 0, True)[:2] == (0, 50)
    false = bytearray(b"\x55" * 30 + one + bytes(600))
    false[10:14] = word(bitrate=15).to_bytes(4, "big")
    assert files.next_frame(bytes(false), 0, True)[:2] == (0, 30)
    assert files.next_frame(b"\x12" * 200, 0, True)[0] == -4
    assert files.next_frame(b"\x12" * 19 + b"\xff", 0, True)[:2] == (1, 19)
    assert list(files.frames_in(frame() + b"\0\xff\0\0\0\0")) == [(0, frame())]
    tagged = b"ID3\x03\0\0\0\0\0\x05" + b"\xff\xfb\x90\0\0" + frame()
    assert [o for o, _ in files.frames_in(tagged)] == [15]
    assert list(files.frames_in(b"")) == [] and list(files.frames_in(b"\xff")) == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 13, 31, 64, 255, 1024, 10**6])
def test_any_chunks_give_the_same_frames(size):
    r = random.Random(size)
    data = b"ID3\x04\0\x10\0\0\0\x07" + bytes(17)
    for i in range(12):
        data += bytes(r.choices([0, 85, 255, 73, 68, 51], k=r.randint(0, 40))) + frame(pairs=[(1, 0)], padding=i % 2)
        if i == 5:
            data += b"ID3\x03\0\0\0\0\0\x0c" + b"\xff\xfb\x90\x40" * 3
    framer, got = Framer(), []
    for a in range(0, len(data), size):
        got += [(o, c) for _, o, c in framer.feed(data[a : a + size])]
    assert got == list(files.frames_in(data)) and len(got) >= 12


def test_side_information():
    data = bytes([0x19, 0x00]) + bytes(40)
    assert entropy.side_info(data, 3, 2)[1]["main_data_begin"] == 50
    assert entropy.side_info(bytes([80]) + bytes(40), 2, 1)[1]["main_data_begin"] == 80
    for version, channels, size in ((3, 2, 32), (3, 1, 17), (2, 2, 17), (2, 1, 9)):
        assert entropy.side_info(bytes(size), version, channels)[0] == 0
        assert entropy.side_info(bytes(size - 1), version, channels)[0] == 1
    assert entropy.side_info(b"\0\0\0" + b"\xff" * 40, 3, 1)[0] == -1
    assert entropy.side_info(None, 3, 1)[0] == -3


def test_reservoir_case():
    r = Reservoir()
    assert r.assemble(50, bytes(100)) is None and len(r.held) == 100
    whole = r.assemble(40, bytes(80))
    assert len(whole) == 120
    r.update(whole, 560)
    assert len(r.held) == 50


def test_scalefactors_and_codes():
    g = {"window_switching": 0, "block_type": 0, "mixed": 0, "scalefac_compress": 9, "part2_3_length": 0}
    bits = Bits(b"\xaa" * 20)
    long, _ = entropy.scalefactors(bits, 3, {"granules": [g], "scfsi": [[0] * 4]}, 0, 0, 1)
    assert bits.pos == 42 and long == [2] * 21 + [0]
    books = tables.codebooks()
    g = {"window_switching": 0, "region0_count": 0, "region1_count": 0, "big_values": 2, "table_select": [1, 1, 1], "count1table": 0}
    status, out = entropy.spectrum(Bits(b"\x50"), 44100, g, 4, books)
    assert (status, out[:4], entropy.zero_start(out)) == (0, [1, 0, 0, 0], 1)
    g |= {"big_values": 0, "count1table": 1}
    status, out = entropy.spectrum(Bits(b"\0"), 44100, g, 8, books)
    assert (status, out[:4], entropy.zero_start(out)) == (0, [1, 1, 1, 1], 4)
    g |= {"big_values": 50, "table_select": [1, 1, 1]}
    assert entropy.spectrum(Bits(b"\0"), 44100, g, 2, books)[0] == -6
    # Quadruples that lie past the end of the data are refused, or made of ones for compatibility.
    g |= {"big_values": 0, "count1table": 1}
    assert entropy.spectrum(Bits(b"\xff"), 44100, g, 40, books)[0] == -6
    assert entropy.spectrum(Bits(b"\xff"), 44100, g, 40, books, compat=True)[0] == 0


def test_code_tables_are_complete():
    for codes in [*tables.PAIR_CODES.values(), dict(enumerate(tables.QUAD_CODES))]:
        assert sum(2.0 ** -len(c) for c in codes.values()) == 1.0
        assert not any(a != b and b.startswith(a) for a in codes.values() for b in codes.values())
    with pytest.raises(ValueError):
        tables.codebooks({7: {(0, 0): "1", (0, 1): "01"}})
    extra = tables.load_codes([(16, x, y, f"{16 * x + y:08b}") for x in range(16) for y in range(16)])
    assert tables.codebooks(extra)[23][1] == 13


def granule(coef, **more):
    return {"coef": coef, "global_gain": 210, "scalefac_scale": 0, "preflag": 0, "window_switching": 0, "block_type": 0, "mixed": 0, "subblock_gain": [0] * 3, "scalefac_l": [0] * 22, "scalefac_s": [[0] * 3] * 13, "zero_start": 576} | more


def test_requantise_and_stereo():
    coef = [(-1) ** i * (i % 7) for i in range(576)]
    long = spectrum.requantise(44100, granule(coef, scalefac_l=list(range(22)), preflag=1))
    i = 100
    band = int(tables.band_of_line(44100)[i])
    assert long[i] == pytest.approx(np.sign(coef[i]) * abs(coef[i]) ** (4 / 3) * 2 ** (0.25 * (210 - 214) - 0.5 * (band + tables.PRETAB[band])))
    short = spectrum.requantise(44100, granule(list(range(576)), window_switching=1, block_type=2))
    s, t, b, w = spectrum.short_order(44100, False)
    assert len(set(s)) == len(set(t)) == 3 * 136 and short[t[5]] == pytest.approx(s[5] ** (4 / 3) / 2)
    a, b = np.arange(576.0), np.ones(576)
    left, right = spectrum.stereo(44100, 1, 2, granule([0] * 576), [a, b])
    assert np.allclose(left**2 + right**2, a**2 + b**2)
    left, right = spectrum.stereo(44100, 1, 1, granule([0] * 576, zero_start=100, scalefac_l=[6] * 22), [a, b])
    assert (left[:100] == a[:100]).all() and (left[100:418] == 0).all() and (right[100:418] == a[100:418]).all() and (left[418:] == a[418:]).all()
    assert spectrum.stereo(44100, 0, 3, granule([0] * 576), [a, b])[0] is a


def sequential(lines, kinds, window):
    """Granule after granule with running state, straight from the definitions."""
    big, small = tables.imdct_matrices()
    overlap, fifo, out = np.zeros((32, 9)), np.zeros((16, 64)), []
    n = np.arange
    for x, (switching, block, mixed) in zip(lines, kinds, strict=True):
        bands = np.zeros((18, 32))
        for sb in range(32):
            c = x[18 * sb : 18 * sb + 18]
            if switching and block == 2 and not (mixed and sb < 2):
                w12, time = np.sin(np.pi / 12 * (n(12) + 0.5)), np.zeros(36)
                time[:6], held = overlap[sb, :6], overlap[sb, 6:9]
                for w in range(3):
                    y = c[w::3] @ small
                    for i in range(3):
                        time[6 + 6 * w + i] = held[i] * w12[5 - i] + y[i] * w12[i]
                        time[11 + 6 * w - i] = held[i] * w12[i] - y[i] * w12[5 - i]
                    held = y[6:9]
                bands[:, sb] = time[:18]
                overlap[sb] = np.concatenate([time[18:24], held])
            else:
                y, w36 = c @ big, np.sin(np.pi / 36 * (n(36) + 0.5))
                near, far = w36[17 - n(9)], w36[n(9)]
                if block & 3 == 3:
                    near = np.concatenate([np.ones(6), np.sin(np.pi / 12 * (5 - n(3) + 0.5))])
                    far = np.concatenate([np.zeros(6), np.sin(np.pi / 12 * (n(3) + 0.5))])
                for i in range(9):
                    bands[i, sb] = overlap[sb, i] * near[i] + y[i] * far[i]
                    bands[17 - i, sb] = overlap[sb, i] * far[i] - y[i] * near[i]
                overlap[sb] = y[18:27]
            if sb % 2:
                bands[1::2, sb] *= -1
        for t in range(18):
            fifo = np.roll(fifo, 1, axis=0)
            fifo[0] = tables.cosine_matrix() @ bands[t]
            u = np.concatenate([np.concatenate([fifo[2 * i][:32], fifo[2 * i + 1][32:]]) for i in range(8)])
            out.append((u * window).reshape(16, 32).sum(axis=0))
    return np.concatenate(out)


def test_one_step_back_is_all_the_memory_there_is():
    r = np.random.default_rng(3)
    kinds = [(0, 0, 0), (1, 1, 0), (1, 2, 0), (1, 2, 1), (1, 3, 0), (0, 0, 0), (1, 2, 0), (0, 0, 0), (1, 3, 0), (1, 2, 1), (1, 2, 1), (1, 1, 0)]
    lines = r.normal(size=(len(kinds), 576))
    window = tables.designed_window()
    sw, bt, mx = np.array(kinds).T
    back = lambda x: np.concatenate([np.zeros_like(x[:1]), x[:-1]])
    bands = hybrid.subbands(lines, bt, sw, mx, back(lines), back(bt), back(sw), back(mx))
    got = hybrid.synthesis(bands, back(bands), window).ravel()
    assert np.abs(got - sequential(lines, kinds, window)).max() < 1e-9


def test_bytes_to_samples(spark):
    stream = [frame(pairs=[(1, -1)] * 20, quads=[(1, 0, -1, 1)] * 3, mode=m) for m in (0, 0, 0, 0)]
    mono = [frame(pairs=[(1, 1)] * 30, version=2, bitrate=8, mode=3, block=b) for b in (None, (1, 0), (2, 0), (3, 0), None)]
    broken = frame(pairs=[(1, 0)] * 4, begin=300)
    df = spark.createDataFrame([("a", b"".join(stream)), ("b", b"junk" + b"".join(mono)), ("c", broken + frame()), ("d", None), ("e", b"")], "stream_id string, content binary")
    found = files.scan_frames(df)
    assert {r.stream_id: r.n for r in found.groupBy("stream_id").count().withColumnRenamed("count", "n").collect()} == {"a": 4, "b": 5, "c": 2}
    out = {(r.stream_id, r.frame_no): r for r in decode.pcm_frames(found).collect()}
    assert [len(out["a", i].pcm16) for i in range(4)] == [2304] * 4 and [len(out["b", i].pcm16) for i in range(5)] == [576] * 5
    assert ("c", 0) not in out and ("c", 1) in out
    assert max(abs(x) for x in out["a", 2].pcm_float) > 0 and np.isfinite(out["a", 3].pcm_float).all()
    states = {(r.stream_id, r.frame_no): r.status for r in decode.granules(found).collect()}
    assert states["c", 0] == -5 and states["c", 1] == 0


def test_wave_files(spark, tmp_path):
    import wave

    spark.dataSource.register(wav.WavDataSource)
    df = spark.createDataFrame([("x", 44100, 2, [1, -2, 3, -4]), ("y", 8000, 1, [])], "name string, sample_rate_hz int, channels int, pcm16 array<smallint>")
    df.write.format("wav").mode("append").save(str(tmp_path / "out"))
    with wave.open(str(tmp_path / "out" / "x.wav")) as f:
        assert (f.getframerate(), f.getnchannels(), f.readframes(9)) == (44100, 2, np.array([1, -2, 3, -4], "<i2").tobytes())
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.wav", "y.wav"]
    got = spark.range(1).select(wav.header(header.F.lit(4), header.F.lit(44100), header.F.lit(2)).alias("h")).first().h
    assert bytes(got) == wav.header_bytes(4, 44100, 2)


@pytest.mark.parametrize("size", [1, 97, 5000])
def test_chunks_to_samples_equal_the_batch_decoder(spark, size):
    from bitwave.streaming.samples import StreamDecoder

    stream = b"".join(frame(pairs=[(1, -1)] * (5 + i), quads=[(1, 0, -1, 1)] * 2, mode=i % 2, extension=2 * (i % 2), begin=0 if i != 4 else 200, block=(None, (1, 0), (2, 0), (2, 1), (3, 0))[i % 5]) for i in range(9))
    df = spark.createDataFrame([("a", stream)], "stream_id string, content binary")
    batch = {r.frame_no: r.pcm_float for r in decode.pcm_frames(files.scan_frames(df)).collect()}
    decoder, got = StreamDecoder(), {}
    for a in range(0, len(stream), size):
        for no, _, status, channels, pcm in decoder.feed(stream[a : a + size]):
            assert (status == 0) == (pcm is not None)
            if pcm is not None:
                got[no] = pcm
    assert sorted(got) == sorted(batch) and len(got) >= 8
    assert all(np.abs(got[i] - np.array(batch[i], np.float32)).max() < 1e-6 for i in got)
    assert max(np.abs(x).max() for x in got.values()) > 0


def test_streaming_query_to_samples(spark, tmp_path):
    from bitwave.streaming.samples import stream_samples

    stream = b"".join(frame(pairs=[(1, -1)] * (5 + i)) for i in range(20))
    rows = [("s", i, stream[a : a + 700]) for i, a in enumerate(range(0, len(stream), 700))]
    rows = rows[3:] + rows[:3]  # late chunks wait for their turn
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], "stream_id string, seq long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_samples(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.frame_no: r.pcm16 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame([("s", stream)], "stream_id string, content binary")
    want = {r.frame_no: r.pcm16 for r in decode.pcm_frames(files.scan_frames(df)).collect()}
    assert got == want and len(got) == 20


def test_every_table_decodes():
    leaves = {1: 4, 2: 9, 3: 9, 5: 16, 6: 16, 7: 36, 8: 36, 9: 36, 10: 64, 11: 64, 12: 64} | {t: 256 for t in (13, 15, *range(16, 32))}
    books = tables.codebooks()
    assert sorted(books) == list(range(32))
    for t, (codes, linbits) in books.items():
        if t in tables.EMPTY_TABLES:
            continue
        assert len(codes) == leaves[t] and sum(2.0 ** -len(c) for c in codes) == 1.0
        for code, (x, y) in codes.items():
            want, written = [], code
            for v in (x, y):
                more = linbits and v == 15
                written += f"{(1 << linbits) - 1:0{linbits}b}" if more else ""
                written += "1" if v else ""
                want.append(-(v + (1 << linbits) - 1 if more else v))
            g = {"window_switching": 0, "region0_count": 0, "region1_count": 0, "big_values": 1, "table_select": [t] * 3, "count1table": 0}
            data = int(written.ljust(-(-len(written) // 8) * 8, "0"), 2).to_bytes(-(-len(written) // 8), "big")
            assert entropy.spectrum(Bits(data), 44100, g, len(written), books) == (0, want + [0] * 574)


def test_published_window():
    w, near = tables.published_window(), tables.designed_window()
    assert w[256] == 75038 / 65536 and w[1] == -1 / 65536 and w[0] == 0
    assert np.allclose(np.abs(w[1:]), np.abs(w[1:][::-1]))
    assert np.corrcoef(w, near)[0, 1] > 0.99
    x = np.random.default_rng(1).normal(size=(1, 18, 32))
    assert np.array_equal(hybrid.synthesis(x, x), hybrid.synthesis(x, x, w))
