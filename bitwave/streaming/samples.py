"""Incremental decoding to samples: chunks in, interleaved samples out.

State for each stream: what the framer holds, the reservoir, and the last good granule's lines and
subbands (all that overlap and synthesis remember). Any cutting into chunks gives the samples of the
batch decoder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators.decode import FRAMES, Running, interleaved, quantised
from .decoder import Framer

SAMPLES = "stream_id string, frame_no long, byte_offset long, status int, channels int, pcm_float array<float>, pcm16 array<smallint>"
NAMES = [f.split()[0] for f in SAMPLES.split(", ")]
PACKED = SAMPLES.replace("array<float>", "binary").replace("array<smallint>", "binary")
STATE = "held binary, offset long, frame_no long, next_seq long, waiting_seq array<long>, waiting array<binary>, reservoir binary, kinds array<int>, lines binary, bands binary"


class StreamDecoder:
    def __init__(self, framer: Framer | None = None, reservoir: bytes = b"", kinds=(0,) * 6, lines: bytes = b"", bands: bytes = b"", window=None, extra_codes=None):
        self.framer = framer or Framer()
        lines, bands = (np.frombuffer(x, np.float64).reshape(2, 576).copy() if x else None for x in (lines, bands))
        self.running = Running(tables.codebooks(extra_codes), window, reservoir=reservoir, kinds=np.array(kinds, int).reshape(2, 3), lines=lines, bands=bands)

    def feed(self, chunk: bytes) -> list[tuple]:
        """(frame_no, byte_offset, status, channels, samples or None) of the frames that chunk completes."""
        frames, out = list(self.framer.feed(chunk)), []
        for a in range(0, len(frames), FRAMES):
            part = frames[a : a + FRAMES]
            out += [(no, offset, *x) for (no, offset, _), x in zip(part, self.running.feed([c for *_, c in part]), strict=True)]
        return out


    def packed(self, frames: list[tuple], floats: bool = True) -> list[tuple]:
        """(frame_no, byte_offset, status, channels, bytes of pcm_float or None, bytes of pcm16) of frames of
        the framer; a bad one has None for both."""
        found, _, pcm = self.running.transformed([c for *_, c in frames])
        out, i = [], 0
        for (no, offset, _), (status, channels, count) in zip(frames, found, strict=True):
            if status:
                out.append((no, offset, status, channels, None, None))
            elif pcm is None:
                size = 576 * channels * count
                out.append((no, offset, status, channels, bytes(4 * size) if floats else None, bytes(2 * size)))
            else:
                x = interleaved(pcm, i, i + count, channels)
                out.append((no, offset, status, channels, x.astype(np.float32).tobytes() if floats else None, quantised(x).tobytes()))
            i += count
        return out


def _step(key, batches, state, window=None, extra_codes=None, names=NAMES):
    held, offset, frame_no, next_seq, seqs, chunks, reservoir, kinds, lines, bands = state.get if state.exists else (b"", 0, 0, 0, [], [], b"", [0] * 6, b"", b"")
    waiting = dict(zip(seqs, chunks, strict=True))
    for batch in batches:
        for seq, chunk in zip(batch["seq"], batch["chunk"], strict=True):
            if seq >= next_seq:
                waiting.setdefault(int(seq), None if chunk is None else bytes(chunk))
    decoder = StreamDecoder(Framer(bytes(held), offset, frame_no), bytes(reservoir), kinds, bytes(lines), bytes(bands), window, extra_codes)
    frames: list = []
    while next_seq in waiting:
        chunk = waiting.pop(next_seq)
        if chunk is None:
            decoder.framer.flush()
        else:
            frames += decoder.framer.feed(chunk)
        next_seq += 1
        while len(frames) >= FRAMES:
            yield _table(key, decoder.packed(frames[:FRAMES], "pcm_float" in names), names)
            del frames[:FRAMES]
    rows = decoder.packed(frames, "pcm_float" in names) if frames else []
    left, f, r = sorted(waiting), decoder.framer, decoder.running
    kept = [x.tobytes() if x.any() else b"" for x in (r.lines, r.bands)]  # silence needs no bytes
    state.update((f.held, f.offset, f.frame_no, next_seq, left, [waiting[s] for s in left], r.reservoir.held, r.kinds.ravel().tolist(), *kept))
    if rows:
        yield _table(key, rows, names)


def _table(key, rows, names) -> pd.DataFrame:
    columns = dict(zip(NAMES, [[key[0]] * len(rows), *map(list, zip(*rows, strict=True))], strict=True))
    return pd.DataFrame({n: pd.Series(columns[n], dtype=object) if n.startswith("pcm") else columns[n] for n in names})


def _lists(packed: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of numbers over the bytes that hold them."""
    if not len(packed):
        return pa.array([], pa.list_(kind))
    packed = packed.cast(pa.binary())
    width, data = kind.bit_width // 8, packed.buffers()[2]
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // width
    values = pa.Array.from_buffers(kind, int(ends[-1]), [None, data or pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=packed.is_null())


def stream_samples(chunks: DataFrame, window=None, extra_codes=None, columns: tuple | None = None) -> DataFrame:
    """The frames of a streaming DataFrame (stream_id, seq from 0, chunk) with their samples; bad frames
    have a status and no samples. columns: those that are wanted, in the order of SAMPLES; all without it.

    The state's function hands samples over as bytes: lists of numbers would be made element by element
    on their way out of pandas. A second step, without state, tells that they are numbers."""
    names = [n for n in NAMES if not columns or n in columns]

    def step(key, batches, state):
        yield from _step(key, batches, state, window, extra_codes, names)

    def unpacked(batches):
        for batch in batches:
            kinds = {"pcm_float": pa.float32(), "pcm16": pa.int16()}
            yield pa.RecordBatch.from_arrays([_lists(batch[n], kinds[n]) if n in kinds else batch[n] for n in names], names)

    of = lambda schema: ", ".join(f for f in schema.split(", ") if f.split()[0] in names)
    packed = chunks.groupBy(F.col("stream_id")).applyInPandasWithState(step, of(PACKED), STATE, "append", "NoTimeout")
    return packed.mapInArrow(unpacked, of(SAMPLES))
