"""The bit reservoir: an ordered fold over the frames of a stream.

How the reservoir grows needs no entropy decoding: a frame's main data end where the sum of its
part2_3 lengths says. fold_sizes() needs integers only; assembled() moves the bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import tables

MOST = 2048


def fold_sizes(frames: DataFrame) -> DataFrame:
    """stream_id, frame_no, held (bytes before the frame), status, assembled (bytes, 0 on underflow)
    and left (bytes after it), of frames with main_data_begin, main_len, part2_3_bits and side_ok."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        left, out = 0, []
        for begin, length, bits, ok in zip(*[table.column(c).to_pylist() for c in ("main_data_begin", "main_len", "part2_3_bits", "side_ok")], strict=True):
            held, fits = left, left >= begin
            whole = begin + length if ok and fits else 0
            left = 0 if not ok else min(held + length, MOST) if not fits else min(max(whole - -(-bits // 8), 0), MOST)
            out.append((held, tables.STATUS["INVALID_HEADER"] if not ok else 0 if fits else tables.STATUS["RESERVOIR_UNDERFLOW"], whole, left))
        columns = [pa.array(c, pa.int32()) for c in zip(*out, strict=True)]
        return pa.table([table.column("stream_id"), table.column("frame_no").cast(pa.int64()), *columns], ["stream_id", "frame_no", "held", "status", "assembled", "left"])

    kind = frames.schema["stream_id"].dataType.simpleString()
    few = frames.select("stream_id", "frame_no", "main_data_begin", "main_len", "part2_3_bits", "side_ok")
    return few.groupBy("stream_id").applyInArrow(run, f"stream_id {kind}, frame_no long, held int, status int, assembled int, left int")


class Reservoir:
    """The same with bytes, for one stream."""

    def __init__(self, held: bytes = b""):
        self.held = held

    def assemble(self, begin: int, main: bytes) -> bytes | None:
        """The frame's whole main data, or None on underflow (the bytes are then kept for later)."""
        if len(self.held) < begin:
            self.held = (self.held + main)[-MOST:]
            return None
        return (self.held[len(self.held) - begin :] if begin else b"") + main

    def update(self, assembled: bytes, bits: int) -> None:
        self.held = assembled[(bits + 7) // 8 :][-MOST:]


def assembled(frames: DataFrame) -> DataFrame:
    """frames (stream_id, frame_no, content and header fields) with side_status and main_data, the
    bytes that hold the frame's granules; null where they cannot be had. One stream is one group."""
    from .entropy import part2_3_bits, side_info

    schema = frames.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        state, statuses, mains = Reservoir(), [], []
        for row in table.select(["content", "header_bytes", "side_info_bytes", "version", "channels"]).to_pylist():
            status, info = side_info(row["content"][row["header_bytes"] :], row["version"], row["channels"])
            main = row["content"][row["header_bytes"] + row["side_info_bytes"] :]
            if status:
                state.held = b""
                whole = None
            else:
                whole = state.assemble(info["main_data_begin"], main)
                status = 0 if whole is not None else tables.STATUS["RESERVOIR_UNDERFLOW"]
                if whole is not None:
                    state.update(whole, part2_3_bits(info, row["version"], row["channels"]))
            statuses.append(status)
            mains.append(whole)
        return table.append_column("side_status", pa.array(statuses, pa.int32())).append_column("main_data", pa.array(mains, pa.binary()))

    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    return frames.groupBy("stream_id").applyInArrow(run, StructType([*schema.fields, StructField("side_status", IntegerType()), StructField("main_data", BinaryType())]))
