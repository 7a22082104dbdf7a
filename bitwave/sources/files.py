"""Reading byte sources and locating frames in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import header, tables

FRAMES = "stream_id string, frame_no long, byte_offset long, header_word long, content binary"
S = tables.STATUS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id and content of the files under path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), "content")


def frame_length(word: int) -> int:
    """Bytes of the frame that a 32-bit header word starts, 0 if it is no valid header."""
    version, index, rate_index = (word >> 19) & 3, (word >> 12) & 15, (word >> 10) & 3
    if (word >> 21) & 2047 != 2047 or version == 1 or (word >> 17) & 3 != 1 or index in (0, 15) or rate_index == 3 or word & 3 == 2:
        return 0
    one, rate = version == 3, tables.RATES[4 * version + rate_index]
    size = (144000 * tables.BITRATES_1[index] if one else 72000 * tables.BITRATES_2[index]) // rate + ((word >> 9) & 1)
    mono = (word >> 6) & 3 == 3
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return size if size >= (4 if (word >> 16) & 1 else 6) + side else 0


def tag_length(data: bytes, at: int) -> int | None:
    """Bytes of an ID3v2 tag at a position, 0 if there is none, None if more bytes are needed."""
    head = data[at : at + 10]
    if not b"ID3".startswith(head[:3]) or len(head) == 0:
        return 0
    if len(head) < 10:
        return None if len(head) >= 3 or at == 0 else 0
    if not 2 <= head[3] <= 4 or any(b > 127 for b in head[6:]):
        return 0
    size = (head[6] << 21) | (head[7] << 14) | (head[8] << 7) | head[9]
    return size + (20 if head[3] == 4 and head[5] & 16 else 10)


def next_frame(data: bytes, start: int = 0, first: bool = False) -> tuple[int, int, int, int]:
    """(status, offset, length, floor) of the first frame at or after start; floor is the end of the last
    tag that was skipped. A frame or tag that is cut short
    by the end gives NEED_MORE_DATA with its offset; so do trailing bytes that could start a header."""
    n, at, floor = len(data), start, start
    if n - at < 4:
        return S["NEED_MORE_DATA"], at, 0, floor
    if first:
        tag = tag_length(data, at)
        if tag is None or n - at < tag:
            return S["NEED_MORE_DATA"], at, 0, floor
        at += tag
        floor = at
    while True:
        sync = data.find(b"\xff", at)
        tag_at = data.find(b"ID3", at, sync if sync >= 0 else n)  # not behind it: each byte is searched once
        if tag_at >= 0:
            size = tag_length(data, tag_at) if tag_at + 10 <= n else 0
            if size:
                if n - tag_at < size:
                    return S["NEED_MORE_DATA"], tag_at, 0, floor
                at = floor = tag_at + size
            else:
                at = tag_at + 1
            continue
        if sync < 0 or sync > n - 4:
            break
        length = frame_length(int.from_bytes(data[sync : sync + 4], "big"))
        if length:
            return S["OK" if n - sync >= length else "NEED_MORE_DATA"], sync, length, floor
        at = sync + 1
    for i in range(max(floor, n - 3), n):
        if data[i] == 255 and (i + 1 == n or data[i + 1] & 224 == 224):
            return S["NEED_MORE_DATA"], i, 0, floor
    return S["SYNC_NOT_FOUND"], n, 0, floor


def frames_in(data: bytes):
    """(offset, bytes) of the whole frames; every step moves on by a frame at least. A frame cut short
    by the end ends the scan, as it does in a stream."""
    at, first = 0, True
    while True:
        status, offset, length, _ = next_frame(data, at, first)
        if status != S["OK"]:
            return
        yield offset, data[offset : offset + length]
        at, first = offset + length, False


def scan_frames(sources: DataFrame) -> DataFrame:
    """The frames of each source (stream_id, content) with their header fields. A source is one row,
    so no shuffle is needed."""

    def run(batches):
        for batch in batches:
            for stream, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(frames_in(content or b""))
                for i in range(0, len(found), 4096):
                    part = found[i : i + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([stream] * len(part), pa.string()), pa.array(range(i, i + len(part)), pa.int64()), pa.array([o for o, _ in part], pa.int64()),
                            pa.array([int.from_bytes(c[:4], "big") for _, c in part], pa.int64()), pa.array([c for _, c in part], pa.binary()),
                        ],
                        ["stream_id", "frame_no", "byte_offset", "header_word", "content"],
                    )

    return header.with_header(sources.select(F.col("stream_id").cast("string").alias("stream_id"), "content").mapInArrow(run, FRAMES))


def source_status(sources: DataFrame, frames: DataFrame) -> DataFrame:
    """For each source (stream_id, content): status, seekable and the number of its frames. A null or
    empty source is INVALID_ARG, one without a frame SYNC_NOT_FOUND; both cannot be sought in."""
    found = frames.groupBy("stream_id").agg(F.count("*").alias("n_frames"))
    out = sources.select(F.col("stream_id").cast("string").alias("stream_id"), (F.coalesce(F.length("content"), F.lit(0)) == 0).alias("empty")).join(found, "stream_id", "left")
    status = F.when(F.col("empty"), S["INVALID_ARG"]).when(F.col("n_frames").isNull(), S["SYNC_NOT_FOUND"]).otherwise(S["OK"])
    return out.select("stream_id", status.alias("status"), (status == 0).alias("seekable"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"))
