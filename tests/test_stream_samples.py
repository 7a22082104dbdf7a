import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bitwave.operators import decode
from bitwave.sources import files
from bitwave.streaming import decoder, samples
from tests.frames_for_tests import frame


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def step(chunks, state, names=samples.NAMES, first=0):
    batch = pd.DataFrame({"stream_id": "s", "seq": range(first, first + len(chunks)), "chunk": chunks})
    return pd.concat([*samples._step(("s",), iter([batch]), state, names=names), pd.DataFrame()])


def test_samples_leave_the_state_as_bytes_and_silence_keeps_none():
    state, stream = State(), frame(mode=0) * 600
    out = step([stream[a : a + 4093] for a in range(0, len(stream), 4093)], state)
    assert len(out) == 600 and out.frame_no.tolist() == list(range(600))
    assert {type(x) for x in [*out.pcm16, *out.pcm_float]} == {bytes} and {len(x) for x in out.pcm16} == {2 * 2304}
    lines, bands = state.get[-2:]
    assert (lines, bands) == (b"", b"")
    loud = step([frame(mode=0), frame(pairs=[(1, -1)] * 9)], state, first=len(stream) // 4093 + 1)
    assert len(loud) == 2 and any(np.frombuffer(loud.pcm16.iloc[1], np.int16)) and len(state.get[-2]) == len(state.get[-1]) == 8 * 2 * 576


@pytest.mark.parametrize("cut", [(0, 5), (1, 4), (2, 2)])
def test_lists_over_bytes(cut):
    rows = [[1, -2, 3], None, [], [4], [5, 6]]
    packed = pa.array([None if r is None else np.array(r, np.int16).tobytes() for r in rows], pa.binary())
    a, b = cut
    assert samples._lists(packed[a:b], pa.int16()).to_pylist() == rows[a:b]
    assert samples._lists(pa.array([None, None], pa.binary()), pa.float32()).to_pylist() == [None, None]


@pytest.mark.parametrize("columns", [None, ("stream_id", "frame_no", "pcm16")])
def test_streams_give_the_samples_of_the_batch_decoder(spark, tmp_path, columns):
    sources = {"quiet": frame(mode=0) * 300, "loud": b"".join(frame(pairs=[(1, -1)] * (5 + i % 9), mode=0 if i % 2 else 3, begin=0 if i else 200) for i in range(20)), "none": b"no audio"}
    rows = [(k, i, v[a : a + 700]) for k, v in sources.items() for i, a in enumerate(range(0, len(v), 700))]
    spark.createDataFrame(rows, decoder.CHUNKS).write.parquet(str(tmp_path / "in"))
    out = samples.stream_samples(spark.readStream.schema(decoder.CHUNKS).parquet(str(tmp_path / "in")), columns=columns)
    assert out.columns == list(columns or samples.NAMES)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.stream_id, r.frame_no): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.stream_id, r.frame_no): r for r in decode.pcm_frames(files.scan_frames(spark.createDataFrame(list(sources.items()), "stream_id string, content binary"))).collect()}
    assert len(got) == 320 and set(got) - set(want) == {("loud", 0)} and got["loud", 0].pcm16 is None
    assert all(got[k].pcm16 == r.pcm16 for k, r in want.items())
    if not columns:
        assert all(got[k].pcm_float == r.pcm_float and got[k].channels == r.channels for k, r in want.items()) and got["loud", 0].status == -5
