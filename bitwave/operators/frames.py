"""Frame index, stream statistics, seeking and trimming over tables of frames.

A frame table has stream_id, frame_no, frame_size_bytes, samples_per_frame and the other header
fields. Everything is windows and aggregates partitioned by stream; lookups of a position are sweeps
over the sorted union of frames and positions, never a product of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables

WARM_UP_BYTES = 4096


def _before(order: str = "frame_no"):
    return Window.partitionBy("stream_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def frame_index(frames: DataFrame) -> DataFrame:
    """frames with byte_offset and sample_offset, the running sums before each frame."""
    return frames.withColumns({
        "byte_offset": F.coalesce(F.sum(F.col("frame_size_bytes").cast("long")).over(_before()), F.lit(0).cast("long")),
        "sample_offset": F.coalesce(F.sum(F.col("samples_per_frame").cast("long")).over(_before()), F.lit(0).cast("long")),
    })


def stream_info(frames: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One row for each stream: the format of its last frame, counts, declared totals, duration.

    declared: stream_id with has_vbr_header, is_vbr, total_frames, has_gapless, encoder_delay and
    end_padding, as with_stream_header() gives them. A declared total wins over the counted one."""
    last = lambda c: F.max_by(c, "frame_no").alias(c)
    info = frames.groupBy("stream_id").agg(
        *[last(c) for c in ("version", "layer", "sample_rate_hz", "channels", "channel_mode", "bitrate_kbps")],
        F.count("*").alias("frame_count"), F.sum(F.col("samples_per_frame").cast("long")).alias("sample_count"),
    )
    if declared is None:
        zero = {c: F.lit(0) for c in ("has_vbr_header", "is_vbr", "declared_frames", "has_gapless", "encoder_delay", "end_padding")}
        info = info.withColumns(zero)
    else:
        declared = declared.withColumnRenamed("total_frames", "declared_frames")
        info = info.join(declared.select("stream_id", "has_vbr_header", "is_vbr", "declared_frames", "has_gapless", "encoder_delay", "end_padding"), "stream_id", "left").fillna(0)
    known = F.col("declared_frames") > 0
    per_frame = F.when(F.col("version") == 3, 1152).otherwise(576)
    info = info.withColumns({
        "total_frames": F.when(known, F.col("declared_frames")).otherwise(F.col("frame_count")).cast("long"),
        "total_samples": F.when(known, F.col("declared_frames") * per_frame).otherwise(F.col("sample_count")).cast("long"),
        "bitrate_mode": F.when((F.col("has_vbr_header") == 1) & (F.col("is_vbr") == 1), 2).otherwise(1),
        "gapless_available": F.col("has_gapless").cast("int"),
    }).drop("declared_frames", "has_gapless")
    return info.withColumn("duration_seconds", F.col("total_samples") / F.col("sample_rate_hz"))


def frame_at(index: DataFrame, probes: DataFrame, position: str) -> DataFrame:
    """probes (stream_id, position and more) with frame_no, sample_offset and samples_per_frame of the
    frame that holds the position, the last frame if it lies beyond the end; null without frames."""
    more = [c for c in probes.columns if c not in ("stream_id", position)]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    starts = index.select("stream_id", F.col("sample_offset").alias("at"), F.lit(0).alias("side"), F.struct("frame_no", "sample_offset", "samples_per_frame").alias("frame"), *[none(probes, c) for c in more])
    asked = probes.select("stream_id", F.col(position).cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(starts.schema["frame"].dataType).alias("frame"), *more)
    by = Window.partitionBy("stream_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("frame", F.last("frame", ignorenulls=True).over(by)).where("side = 1")
    return found.select("stream_id", F.col("at").alias(position), *more, "frame.*")


def seek(index: DataFrame, probes: DataFrame, exact: bool = False) -> DataFrame:
    """probes (stream_id, seconds and more) with status, frame_no and actual_seconds.

    The rate of a stream is its first frame's. Seeking lands on the start of the frame, or on the
    sample itself with exact."""
    streams = index.groupBy("stream_id").agg(F.min_by("sample_rate_hz", "frame_no").alias("rate"), F.sum(F.col("samples_per_frame").cast("long")).alias("total"))
    asked = probes.join(streams, "stream_id", "left").withColumn("target", F.floor(F.col("seconds") * F.col("rate")).cast("long"))
    found = frame_at(index.select("stream_id", "frame_no", "sample_offset", "samples_per_frame"), asked, "target")
    s = tables.STATUS
    status = (
        F.when(F.col("seconds") < 0, s["INVALID_ARG"]).when(F.col("rate").isNull(), s["SEEK_NOT_SUPPORTED"])
        .when(F.col("target") >= F.col("total"), s["SEEK_OUT_OF_RANGE"]).otherwise(0)
    )
    landed = F.col("target") if exact else F.col("sample_offset")
    actual = F.when(F.col("status") == 0, landed / F.col("rate")).when(F.col("status") == s["SEEK_OUT_OF_RANGE"], F.col("total") / F.col("rate"))
    found = found.withColumn("status", status)
    return found.withColumns({"frame_no": F.when(F.col("status") == 0, F.col("frame_no")), "actual_seconds": actual}).drop("rate", "total", "target", "sample_offset", "samples_per_frame")


def warm_up_start(frames: DataFrame) -> DataFrame:
    """frames with warmup_frame: the latest earlier frame from which WARM_UP_BYTES lie before this one."""
    sums = frame_index(frames)
    by = Window.partitionBy("stream_id").orderBy("byte_offset").rangeBetween(Window.unboundedPreceding, -WARM_UP_BYTES)
    first = Window.partitionBy("stream_id")
    return sums.withColumn("warmup_frame", F.coalesce(F.max("frame_no").over(by), F.min("frame_no").over(first)))


def trimmed(index: DataFrame, delay: Column, padding: Column) -> DataFrame:
    """index with the sample range of each frame that is left between delay and padding, and how many
    samples were cut in front and at the end."""
    total = F.sum(F.col("samples_per_frame").cast("long")).over(Window.partitionBy("stream_id"))
    start, stop = F.col("sample_offset"), F.col("sample_offset") + F.col("samples_per_frame")
    low, high = delay.cast("long"), F.greatest(total - padding, delay).cast("long")
    zero = F.lit(0).cast("long")
    return index.withColumns({
        "keep_from": F.least(F.greatest(low - start, zero), stop - start), "keep_to": F.least(F.greatest(high - start, zero), stop - start),
        "cut_front": F.greatest(F.least(stop, low) - start, zero), "cut_end": F.greatest(stop - F.greatest(start, high), zero),
    })


def latest_seek(requests: DataFrame) -> DataFrame:
    """Of concurrent seek requests of a stream (generation, target) only the latest counts."""
    return requests.groupBy("stream_id").agg(F.max("generation").alias("generation"), F.max_by("target", "generation").alias("target"))


def stream_headers(frames: DataFrame) -> DataFrame:
    """What the first frame of each stream declares: one row for each stream, for stream_info()."""
    from ..functions import metadata

    by = Window.partitionBy("stream_id").orderBy("frame_no")
    first = frames.withColumn("nth", F.row_number().over(by)).where("nth = 1")
    first = first.withColumn("side_start", F.col("header_bytes") + F.col("side_info_bytes")).select("stream_id", "content", "side_start")
    return metadata.with_stream_header(first).drop("content", "side_start")


def page(index: DataFrame, probes: DataFrame, seconds: float) -> DataFrame:
    """For each probe (stream_id, target and more, such as the key of a request) the frames of its stream
    from the one that holds the position on, as far as they start within some seconds of it: the
    probe's further columns, then those of index."""
    more = [c for c in probes.columns if c not in ("stream_id", "target")]
    start = frame_at(index.select("stream_id", "frame_no", "sample_offset", "samples_per_frame"), probes, "target")
    start = start.select("stream_id", *more, F.col("frame_no").alias("from_no"), F.col("sample_offset").alias("from_sample"))
    rate = index.groupBy("stream_id").agg(F.min_by("sample_rate_hz", "frame_no").alias("rate"))
    inside = (F.col("frame_no") >= F.col("from_no")) & (F.col("sample_offset") < F.col("from_sample") + seconds * F.col("rate"))
    return index.join(start.where("from_no is not null"), "stream_id").join(rate, "stream_id").where(inside).select(*more, *index.columns)


def granule_windows(samples: DataFrame, size: int = 576) -> DataFrame:
    """Tumbling windows of size samples over (stream_id, sample_no, value)."""
    window = F.floor(F.col("sample_no") / size).cast("long").alias("granule_no")
    return samples.groupBy("stream_id", window).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.col("value").cast("long")).alias("total"))


#: Player states by number.
STATES = ("NoFile", "Loaded", "Playing", "Paused", "Stopped")


def player_states(commands: DataFrame) -> DataFrame:
    """commands (stream_id, seq, command: load, play, pause or stop) with the state after each.

    Without a file all but load is refused. Load, play and stop set the state whatever it was, and a
    pause counts only while playing, so the state follows from the last of the three and whether a
    pause came after it: windows, and no fold."""
    by = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    loaded = F.max(F.when(F.col("command") == "load", 1)).over(by).isNotNull()
    df = commands.withColumn("has_file", loaded)
    set_by = F.when(F.col("has_file") & F.col("command").isin("load", "play", "stop"), F.struct("seq", "command"))
    df = df.withColumn("setter", F.last(set_by, ignorenulls=True).over(by)).withColumn("paused", F.max(F.when(F.col("command") == "pause", F.col("seq"))).over(by))
    playing = F.when(F.col("paused") > F.col("setter.seq"), STATES[3]).otherwise(STATES[2])
    state = F.when(~F.col("has_file"), STATES[0]).when(F.col("setter.command") == "load", STATES[1]).when(F.col("setter.command") == "stop", STATES[4]).otherwise(playing)
    return df.withColumn("state", state).drop("has_file", "setter", "paused")


def totals(runs: DataFrame) -> DataFrame:
    """Over runs (audio_seconds, decode_seconds, bytes): sums, and ratios of the sums."""
    s = runs.agg(F.count("*").alias("runs"), F.sum("audio_seconds").alias("audio_seconds"), F.sum("decode_seconds").alias("decode_seconds"), F.sum("bytes").alias("bytes"))
    return s.withColumns({"realtime_factor": F.col("audio_seconds") / F.col("decode_seconds"), "mb_per_second": F.col("bytes") / 1048576 / F.col("decode_seconds")})
