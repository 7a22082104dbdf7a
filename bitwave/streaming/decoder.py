"""Incremental framing of chunk streams: any cutting of a stream into chunks gives the same frames.

State for each stream: the bytes that no frame has taken yet, the next frame number, the offset of
these bytes, whether a frame was seen, and the sequence number that comes next. Chunks that arrive
out of order wait in the state. A control row (chunk null) flushes the bytes held.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import header
from ..sources.files import FRAMES, S, next_frame

CHUNKS = "stream_id string, seq long, chunk binary"
STATE = "held binary, offset long, frame_no long, next_seq long, waiting_seq array<long>, waiting array<binary>"


class Framer:
    """Takes bytes, gives whole frames; keeps what is left."""

    def __init__(self, held: bytes = b"", offset: int = 0, frame_no: int = 0):
        self.held, self.offset, self.frame_no = held, offset, frame_no

    def feed(self, chunk: bytes) -> list[tuple[int, int, bytes]]:
        self.held += chunk
        out, at = [], 0
        while True:
            status, found, length, floor = next_frame(self.held, at, first=self.offset + at == 0)
            if status == S["OK"]:
                out.append((self.frame_no, self.offset + found, self.held[found : found + length]))
                self.frame_no += 1
                at = found + length
                continue
            # What cannot start a frame any more goes; a cut frame, tag or sync byte stays, and nine
            # bytes that may be the start of a tag's header.
            tail = max(floor, len(self.held) - 9)
            at = min(found, tail) if status == S["NEED_MORE_DATA"] else tail
            break
        self.offset += at
        self.held = self.held[at:]
        return out

    def flush(self) -> None:
        self.offset += len(self.held)
        self.held = b""


def _step(key, batches, state):
    held, offset, frame_no, next_seq, seqs, chunks = state.get if state.exists else (b"", 0, 0, 0, [], [])
    waiting = dict(zip(seqs, chunks, strict=True))
    for batch in batches:
        for seq, chunk in zip(batch["seq"], batch["chunk"], strict=True):
            if seq >= next_seq:
                waiting.setdefault(int(seq), None if chunk is None else bytes(chunk))
    framer, rows = Framer(bytes(held), offset, frame_no), []
    while next_seq in waiting:
        chunk = waiting.pop(next_seq)
        if chunk is None:
            framer.flush()
        else:
            rows += framer.feed(chunk)
        next_seq += 1
    left = sorted(waiting)
    state.update((framer.held, framer.offset, framer.frame_no, next_seq, left, [waiting[s] for s in left]))
    if rows:
        yield pd.DataFrame({
            "stream_id": key[0], "frame_no": [r[0] for r in rows], "byte_offset": [r[1] for r in rows],
            "header_word": [int.from_bytes(r[2][:4], "big") for r in rows], "content": [r[2] for r in rows],
        })


def stream_frames(chunks: DataFrame) -> DataFrame:
    """The frames of a streaming DataFrame (stream_id, seq from 0, chunk), with their header fields."""
    found = chunks.groupBy(F.col("stream_id")).applyInPandasWithState(_step, FRAMES, STATE, "append", "NoTimeout")
    return header.with_header(found)
