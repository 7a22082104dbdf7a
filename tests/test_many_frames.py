import random

import numpy as np
import pytest

from bitwave.functions import tables
from bitwave.operators import decode, entropy, hybrid, spectrum
from bitwave.plans import coded
from bitwave.sources import files
from tests.frames_for_tests import frame


def written(r: random.Random, version: int, channels: int, rate: int) -> tuple[bytes, dict]:
    """Main data and side information of a frame, now and then with long codes, stuffing or damage."""
    bits, granules = "", []
    books = coded.writers()
    for _ in range((2 if version == 3 else 1) * channels):
        switching = r.random() < 0.3
        g = {"big_values": r.choice([0, 0, 5, 60, 200, 288]), "global_gain": r.randint(150, 220), "scalefac_compress": r.choice([0, 0, 7]), "window_switching": int(switching), "block_type": r.choice([1, 2, 3]) if switching else 0}
        g |= {"mixed": int(switching and r.random() < 0.3), "subblock_gain": [r.randint(0, 3) for _ in range(3)], "preflag": r.randint(0, 1), "scalefac_scale": r.randint(0, 1), "count1table": r.randint(0, 1)}
        tall = r.random() < 0.3
        g |= {"table_select": [r.choice([0, 1, 7, 13, 24] if tall else [0, 1, 2, 5, 7]) for _ in range(3)], "region0_count": r.randint(0, 15) if not switching else 7, "region1_count": r.randint(0, 7) if not switching else 0}
        factors = sum(n * (b - a) * (3 if kind == "short" else 1) for kind, a, b, n in entropy.layout(version, g))
        mine = "".join(r.choice("01") for _ in range(factors))
        first, second = entropy.regions(rate, g)
        for line in range(0, 2 * g["big_values"], 2):
            t = g["table_select"][0 if line < first else 1 if line < second else 2]
            most = 0 if t in tables.EMPTY_TABLES else min(coded.LARGEST[t], 17)
            mine += coded.pair_bits(*books[t], r.randint(-most, most), r.randint(-most, most))
        for _ in range(r.randint(0, max(0, (576 - 2 * g["big_values"]) // 4))):
            mine += coded.quad_bits(bool(g["count1table"]), [r.randint(-1, 1) for _ in range(4)])
        mine += r.choice(["", "", "0", "0000000"])
        mine = mine[:4095]
        g["part2_3_length"] = len(mine)
        bits += mine
        granules.append(g)
    data = coded.as_bytes(bits)
    if r.random() < 0.2:
        data = bytes(r.randbytes(len(data))) if r.random() < 0.5 else data[: len(data) // 2]
    scfsi = [[r.randint(0, 1) if r.random() < 0.2 else 0 for _ in range(4)] if version == 3 else [0] * 4 for _ in range(channels)]
    for g in granules:
        g["plain_factors"] = not any(n for *_, n in entropy.layout(version, g)) and not any(map(any, scfsi))
    return data, {"scfsi": scfsi, "granules": granules}


@pytest.mark.parametrize("seed", range(6))
def test_codes_in_step_equal_codes_one_by_one(seed):
    r, books, frames = random.Random(seed), tables.codebooks(), []
    for _ in range(60):
        version, channels, rate = r.choice([(3, 1, 44100), (3, 2, 48000), (2, 1, 24000), (2, 2, 22050), (0, 1, 8000)])
        frames.append((*written(r, version, channels, rate), version, channels, rate))
    many, coef = entropy.decode_many(frames, books)
    assert {0, -6} <= {status for status, _ in many}
    for f, (status, granules) in zip(frames, many, strict=True):
        want_status, want = entropy.decode_granules(*f, books)
        assert status == want_status and len(granules) == len(want)
        for g, w in zip(granules, want, strict=True):
            assert coef[g["row"]].tolist() == w["coef"]
            assert all(g[k] == w[k] for k in ("scalefac_l", "scalefac_s", "zero_start", "gr", "ch", "block_type"))
            assert np.array_equal(spectrum.requantise_many([f[4]], [g], coef[[g["row"]]])[0], spectrum.requantise(f[4], w))


def test_a_run_equals_granules_with_their_predecessors():
    r = np.random.default_rng(5)
    for kinds in ([(0, 0, 0)] * 70, [(0, 0, 0), (1, 1, 0), (3, 1, 0)] * 20, [(0, 0, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 1, 0)] * 9):
        kinds, lines = np.array(kinds), r.normal(size=(len(kinds), 576))
        bands = hybrid.subbands_of_run(lines, kinds)
        assert np.abs(bands - hybrid.subbands(lines[1:], *kinds[1:].T, lines[:-1], *kinds[:-1].T)).max() < 1e-12
        assert np.abs(hybrid.synthesis_of_run(bands) - hybrid.synthesis(bands[1:], bands[:-1])).max() < 1e-12
        gs = [{"window_switching": s, "block_type": t, "mixed": m} for t, s, m in kinds.tolist()]
        smooth = lines.copy()
        spectrum.antialias_many(gs, smooth)
        assert np.array_equal(smooth, [spectrum.antialias(g, x) for g, x in zip(gs, lines, strict=True)])


def test_coded_streams_are_dealt_over_the_tasks(spark):
    spark.range(8).selectExpr("id as s_suppkey").createOrReplaceTempView("s")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.table("s").coalesce(1).write.parquet(f"{d}/supplier.parquet")
        assert coded.streams(spark, d).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tags_are_searched_for_once():
    class Counted(bytes):
        looked = 0

        def find(self, what, start=0, end=None):
            Counted.looked += 1
            end = len(self) if end is None else end
            found = bytes.find(self, what, start, end)
            Counted.read = getattr(Counted, "read", 0) + (end if found < 0 else found) - start
            return found

    data = Counted(frame() * 500)
    assert len(list(files.frames_in(data))) == 500
    assert Counted.read <= 2 * len(data)


def test_wanted_columns_only(spark):
    df = spark.createDataFrame([("a", frame(pairs=[(1, -1)] * 9) * 3), ("b", frame(mode=0) * 2)], "stream_id string, content binary")
    whole, few = decode.pcm_sources(df), decode.pcm_sources(df, columns=("stream_id", "pcm16"))
    assert few.columns == ["stream_id", "pcm16"]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select("stream_id", "pcm16").collect()))


def test_blocks_without_a_good_frame_change_nothing():
    for block in (None, (2, 0)):
        good, bad = [frame(pairs=[(1, -1)] * 9, block=block)] * 4, [frame(pairs=[(1, 0)] * 4, begin=511)] * 2
        one, two = (decode.Running(tables.codebooks()) for _ in range(2))
        whole = one.feed(good)
        parts = two.feed(good[:3]) + two.feed([])
        assert [s for s, *_ in decode.Running(tables.codebooks()).feed(bad)] == [-5] * 2
        parts += two.feed(good[3:])
        assert len(parts) == 4 and all(np.array_equal(a[2], b[2]) for a, b in zip(whole, parts, strict=True)) and whole[3][2].any()
        assert two.transformed([])[0] == [] and decode._pcm_batch("s", [], two, []) is None
