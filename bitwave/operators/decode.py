"""Frames to samples. Whole sources need no shuffle; frames in any order are dealt by stream once and
sorted. Either way a task walks the frames of a stream in blocks: the reservoir frame by frame, the entropy
codes and the transforms over all granules of a block at once. From block to block it carries the
reservoir and the last granule, which is all the memory there is."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..sources.files import frames_in
from . import entropy, hybrid, spectrum
from .reservoir import Reservoir, assembled

GRANULES = (
    "stream_id string, frame_no long, sample_rate_hz int, channels int, status int, gr int, ch int, global_gain int, block_type int, window_switching int, mixed int, "
    "scalefac_compress int, zero_start int, non_zero int, coef array<int>, xr array<double>"
)


def _row(stream, frame, rate, channels, g, xr) -> tuple:
    return (stream, frame, rate, channels, 0, g["gr"], g["ch"], g["global_gain"], g["block_type"], g["window_switching"], g["mixed"], g["scalefac_compress"], g["zero_start"], 576 - g["coef"].count(0), g["coef"], xr)


def _lists(rows, kind) -> pa.Array:
    """Lists of 576 values, or nulls."""
    missing = np.array([r is None for r in rows])
    ends = np.append(0, np.cumsum(np.where(missing, 0, 576)))
    flat = np.concatenate([np.empty(0, kind), *[np.asarray(r, kind) for r in rows if r is not None]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(missing))


NAMES = ["stream_id", "frame_no", "sample_rate_hz", "channels", "version", "channel_mode", "mode_extension", "header_bytes", "content", "side_status", "main_data"]


def _decoded(batch, books: dict, compat: bool):
    """(stream, frame, rate, channels, status, granules): each granule is a list of (side information
    with coefficients, spectral lines or None if all are zero), one for each channel."""
    for stream, frame, rate, channels, version, mode, extension, head, content, status, main in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        done = []
        if status == 0:
            status, info = entropy.side_info(content[head:], version, channels)
            status, done = entropy.decode_granules(main, info, version, channels, rate, books, compat) if status == 0 else (status, [])
        out = []
        for a in range(0, 0 if status else len(done), channels):
            gs = done[a : a + channels]
            if any(g["zero_start"] for g in gs):
                xr = [spectrum.requantise(rate, g) for g in gs]
                if channels == 2:
                    xr = spectrum.stereo(rate, mode, extension, gs[1], xr)
                out.append([(g, spectrum.antialias(g, x)) for g, x in zip(gs, xr, strict=True)])
            else:
                out.append([(g, None) for g in gs])
        yield stream, frame, rate, channels, status, out


def by_stream(df: DataFrame, key: str = "stream_id") -> DataFrame:
    """df dealt by stream to as many partitions as shuffles have. Rows can be small here and what is made
    of them large, so their number is not left to their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _ready(frames: DataFrame) -> DataFrame:
    return assembled(by_stream(frames.withColumn("stream_id", F.col("stream_id").cast("string")))).select(*NAMES)


def granules(frames: DataFrame, extra_codes: dict | None = None, compat: bool = False) -> DataFrame:
    """A row for each granule and channel of each good frame, and one row with its status for each bad
    frame. frames: stream_id, frame_no, content (the frame's bytes) and the header fields."""
    fields = [x.split()[0] for x in GRANULES.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.int32()] * 12, pa.list_(pa.int32()), pa.list_(pa.float64())]

    def run(batches):
        books, silent = tables.codebooks(extra_codes), np.zeros(576)
        for batch in batches:
            rows = []
            for stream, frame, rate, channels, status, done in _decoded(batch, books, compat):
                if status:
                    rows.append((stream, frame, rate, channels, status, *[None] * 11))
                rows += [_row(stream, frame, rate, channels, g, silent if x is None else x) for granule in done for g, x in granule]
            for a in range(0, len(rows), 2048):
                part = list(zip(*rows[a : a + 2048], strict=True))
                plain = [pa.array(c, t) for c, t in zip(part[:-2], types, strict=False)]
                yield pa.RecordBatch.from_arrays([*plain, _lists(part[-2], np.int32), _lists(part[-1], np.float64)], fields)

    return _ready(frames).mapInArrow(run, GRANULES)


#: Frames in a block: some tens of megabytes of temporaries.
FRAMES = 256
PCM = "stream_id string, frame_no long, channels int, pcm_float array<float>, pcm16 array<smallint>"


class Running:
    """The decoder of one stream."""

    def __init__(self, books: dict, window=None, compat: bool = False, reservoir: bytes = b"", kinds=None, lines=None, bands=None):
        self.books, self.window, self.compat, self.reservoir = books, window, compat, Reservoir(reservoir)
        self.kinds = np.zeros((2, 3), int) if kinds is None else kinds
        self.lines = np.zeros((2, 576)) if lines is None else lines
        self.bands = np.zeros((2, 576)) if bands is None else bands

    def assembled(self, content: bytes) -> tuple[int, tuple, tuple | None]:
        """(status, header fields, frame for decode_many() or None) of the next frame."""
        fields = version, channels, head, side, rate, *_ = _header(content[:4])
        status, info = entropy.side_info(content[head : head + side], version, channels)
        if status:
            self.reservoir.held = b""
            return status, fields, None
        whole = self.reservoir.assemble(info["main_data_begin"], content[head + side :])
        if whole is None:
            return tables.STATUS["RESERVOIR_UNDERFLOW"], fields, None
        self.reservoir.update(whole, entropy.part2_3_bits(info, version, channels))
        return 0, fields, (whole, info, version, channels, rate)

    def feed(self, contents: list[bytes]) -> list[tuple[int, int, np.ndarray | None]]:
        """(status, channels, interleaved samples or None) of each of the next frames."""
        frames, _, pcm = self.transformed(contents)
        out, i = [], 0
        for status, channels, count in frames:
            out.append((status, channels, None if status else interleaved(pcm, i, i + count, channels)))
            i += count
        return out

    def transformed(self, contents: list[bytes]) -> tuple[list, np.ndarray | None, np.ndarray | None]:
        """(status, channels, number of granules) of each of the next frames; subbands (time-major) and
        samples of each good granule, as (2, granules, 576), or None if all are zero."""
        frames, coded, n = [], [], 0
        kinds = [self.kinds[None]]
        ready = [self.assembled(c) for c in contents]
        loud = [frame for _, _, frame in ready if frame and not frame[1]["silent"]]
        done, coef = entropy.decode_many(loud, self.books, self.compat)
        done = iter(done)
        for status, fields, frame in ready:
            channels, found = fields[1], []
            if frame:
                status, found = next(done) if not frame[1]["silent"] else (0, frame[1]["granules"])
                if status == 0 and not frame[1]["silent"]:
                    coded += [(n + i // channels, i % channels, g, fields) for i, g in enumerate(found)]
            if status == 0:
                kinds.append(_kinds(found, channels))
            count = 0 if status else len(found) // channels
            frames.append((status, channels, count))
            n += count
        kinds = np.concatenate(kinds)
        if not coded and not self.lines.any() and not self.bands.any():
            self.kinds = kinds[n]
            return frames, None, None
        lines, bands, pcm = np.zeros((2, n + 1, 576)), np.zeros((2, n + 1, 576)), np.zeros((2, n, 576))
        lines[:, 0], bands[:, 0] = self.lines, self.bands
        if coded:
            at, ch, gs, fields = zip(*coded, strict=True)
            xr = spectrum.requantise_many([f[4] for f in fields], gs, coef[[g["row"] for g in gs]])
            for i, (_, _, _, _, rate, mode, extension) in enumerate(fields):
                if mode == 1 and extension & 3 and ch[i] == 0 and (gs[i]["zero_start"] or gs[i + 1]["zero_start"]):
                    xr[i], xr[i + 1] = spectrum.stereo(rate, mode, extension, gs[i + 1], [xr[i].copy(), xr[i + 1].copy()])
            spectrum.antialias_many(gs, xr)
            lines[np.array(ch), np.array(at) + 1] = xr
        for c in range(2):
            if lines[c].any():
                bands[c, 1:] = hybrid.subbands_of_run(lines[c], kinds[:, c]).reshape(-1, 576)
            if bands[c].any():
                pcm[c] = hybrid.synthesis_of_run(bands[c], self.window)
        self.lines, self.kinds, self.bands = lines[:, n].copy(), kinds[n], bands[:, n].copy()
        return frames, bands[:, 1:], pcm


@lru_cache(maxsize=4096)
def _header(start: bytes) -> tuple[int, int, int, int, int, int, int]:
    """(version, channels, header bytes, side information bytes, rate, mode, extension)."""
    word = int.from_bytes(start, "big")
    version, mode, extension = (word >> 19) & 3, (word >> 6) & 3, (word >> 4) & 3
    channels, head = 1 if mode == 3 else 2, 4 if (word >> 16) & 1 else 6
    side = (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)
    return version, channels, head, side, tables.RATES[4 * version + ((word >> 10) & 3)], mode, extension


def _kinds(found: list[dict], channels: int) -> np.ndarray:
    """(granules, 2, 3): block type, switching and mixed by channel."""
    out = np.zeros((len(found) // channels, 2, 3), int)
    for i, g in enumerate(found):
        if g["window_switching"]:
            out[i // channels, i % channels] = g["block_type"], g["window_switching"], g["mixed"]
    return out


def interleaved(pcm: np.ndarray | None, a: int, b: int, channels: int) -> np.ndarray:
    """The samples of granules a to b."""
    return np.zeros((b - a) * 576 * channels) if pcm is None else pcm[:channels, a:b].transpose(1, 2, 0).ravel()


def quantised(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int16)
    for a in range(0, len(x), 1 << 15):
        y = np.clip(x[a : a + (1 << 15)] * 32768, -32768, 32767)
        if np.isnan(y).any():
            y = np.nan_to_num(y, nan=0.0)
        out[a : a + (1 << 15)] = np.rint(y, out=y)
    return out


def _pcm_batch(stream, numbers: list[int], decoder: Running, contents: list[bytes], columns=None) -> pa.RecordBatch | None:
    """The next frames of a stream as rows of PCM, or of those of its columns."""
    frames, _, pcm = decoder.transformed(contents)
    good = [(no, channels, count) for no, (status, channels, count) in zip(numbers, frames, strict=True) if status == 0]
    if not good:
        return None
    parts, i = [], 0
    while i < len(good):  # neighbours with as many channels at once
        j = i
        while j < len(good) and good[j][1] == good[i][1]:
            j += 1
        a = sum(g[2] for g in good[:i])
        parts.append((a, a + sum(g[2] for g in good[i:j]), good[i][1]))
        i = j
    ends = pa.array(np.append(0, np.cumsum([576 * channels * count for _, channels, count in good])), pa.int32())
    flat = None if pcm is None else np.concatenate([interleaved(pcm, *p) for p in parts])
    size = ends[-1].as_py()
    made = {
        "stream_id": lambda: pa.array([stream] * len(good), pa.string()), "frame_no": lambda: pa.array([g[0] for g in good], pa.int64()), "channels": lambda: pa.array([g[1] for g in good], pa.int32()),
        "pcm_float": lambda: pa.ListArray.from_arrays(ends, pa.array(np.zeros(size, np.float32) if flat is None else flat.astype(np.float32))),
        "pcm16": lambda: pa.ListArray.from_arrays(ends, pa.array(np.zeros(size, np.int16) if flat is None else quantised(flat))),
    }
    names = columns or list(made)
    return pa.RecordBatch.from_arrays([made[c]() for c in names], names)


def _schema(columns) -> str:
    return ", ".join(x for x in PCM.split(", ") if not columns or x.split()[0] in columns)


def pcm_frames(frames: DataFrame, window=None, extra_codes: dict | None = None, compat: bool = False) -> DataFrame:
    """stream_id, frame_no, channels, pcm_float (interleaved, unclamped) and pcm16 (scaled, clamped,
    rounded half to even) of good frames. window: the 512 synthesis coefficients; without it the
    published ones."""

    return _walked(frames, PCM, lambda decoder, stream, numbers, contents: _pcm_batch(stream, numbers, decoder, contents), window, extra_codes, compat)


def single_frames(frames: DataFrame, window=None, extra_codes: dict | None = None, compat: bool = False) -> DataFrame:
    """pcm_frames() of each frame by itself, as if no other came before it."""

    def run(batches):
        books = tables.codebooks(extra_codes)
        for batch in batches:
            for stream, number, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = _pcm_batch(stream, [number], Running(books, window, compat), [content])
                if out is not None:
                    yield out

    return frames.select(F.col("stream_id").cast("string").alias("stream_id"), "frame_no", "content").mapInArrow(run, PCM)


def subband_samples(frames: DataFrame, extra_codes: dict | None = None, compat: bool = False) -> DataFrame:
    """stream_id, frame_no, gr, ch and samples (18 times of 32 subbands) of each good granule and channel."""

    def batch(decoder, stream, numbers, contents):
        found, bands, _ = decoder.transformed(contents)
        rows = [(no, gr, ch) for no, (_, channels, count) in zip(numbers, found, strict=True) for gr in range(count) for ch in range(channels)]
        widths = [c for _, c, count in found for _ in range(count)]
        at = np.repeat(np.arange(len(widths)), widths)
        if not rows:
            return None
        flat = np.zeros(576 * len(rows)) if bands is None else bands[[r[2] for r in rows], at].ravel()
        head = [pa.array([stream] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]]
        return pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(576 * np.arange(len(rows) + 1), pa.int32()), pa.array(flat))], ["stream_id", "frame_no", "gr", "ch", "samples"])

    return _walked(frames, "stream_id string, frame_no long, gr int, ch int, samples array<double>", batch, None, extra_codes, compat)


def _walked(frames: DataFrame, schema: str, made, window, extra_codes, compat: bool) -> DataFrame:
    """made(decoder, stream, frame numbers, contents) of each block of a stream's frames in order."""

    def run(batches):
        books, now, decoder = tables.codebooks(extra_codes), None, None
        for batch in batches:
            streams, numbers, contents = (c.to_pylist() for c in batch.columns)
            a = 0
            while a < len(streams):
                b = a + 1
                while b < min(len(streams), a + FRAMES) and streams[b] == streams[a]:
                    b += 1
                if decoder is None or now != streams[a]:
                    now, decoder = streams[a], Running(books, window, compat)
                out = made(decoder, now, numbers[a:b], contents[a:b])
                if out is not None:
                    yield out
                a = b

    dealt = by_stream(frames.select(F.col("stream_id").cast("string").alias("stream_id"), "frame_no", "content"))
    return dealt.sortWithinPartitions("stream_id", "frame_no").mapInArrow(run, schema)


def pcm_sources(sources: DataFrame, window=None, extra_codes: dict | None = None, compat: bool = False, columns: tuple | None = None) -> DataFrame:
    """pcm_frames() of whole sources (stream_id, content), one row each: no shuffle, and no frame is
    copied before it is decoded. columns: those that are wanted, in the order of PCM; all without it."""

    def run(batches):
        books = tables.codebooks(extra_codes)
        for batch in batches:
            for i in range(batch.num_rows):
                stream, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                decoder, number, part = Running(books, window, compat), 0, []
                for _, frame in frames_in(content or b""):
                    part.append(frame)
                    if len(part) == FRAMES:
                        out = _pcm_batch(stream, list(range(number, number + len(part))), decoder, part, columns)
                        number, part = number + len(part), []
                        if out is not None:
                            yield out
                out = _pcm_batch(stream, list(range(number, number + len(part))), decoder, part, columns)
                if out is not None:
                    yield out

    return sources.select(F.col("stream_id").cast("string").alias("stream_id"), "content").mapInArrow(run, _schema(columns))
