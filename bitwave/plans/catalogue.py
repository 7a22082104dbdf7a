"""All queries of the audio part by name, and their SQL."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits, header, metadata, pcm, tables
from ..operators import decode, entropy, hybrid, signal, spectrum
from ..operators import frames as frame_ops
from ..operators import reservoir as reservoir_ops
from ..sources import files, wav
from ..streaming import decoder as stream_decoder
from ..streaming.samples import stream_samples
from . import coded
from .lenses import ODD_WORD, WORD, frames, frames_sql, header_sql, table, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def micro(x):
    return F.round(x * 1e6).cast("long")


# --- Headers --------------------------------------------------------------------------------------

_fields_sql = """case when status = 0 then {0} else 0 end as {1}"""
_header_fields = {
    "version": "v", "layer": "layer_bits", "bitrate_kbps": "kbps", "sample_rate_hz": "rate", "channels": "ch", "channel_mode": "cast((w >> 6) & 3 as integer)",
    "mode_extension": "cast((w >> 4) & 3 as integer)", "has_crc": "cast(1 - ((w >> 16) & 1) as integer)", "padding": "cast((w >> 9) & 1 as integer)",
    "private_bit": "cast((w >> 8) & 1 as integer)", "copyright": "cast((w >> 3) & 1 as integer)", "original": "cast((w >> 2) & 1 as integer)", "emphasis": "cast(w & 3 as integer)",
    "frame_size_bytes": "size", "samples_per_frame": "case when v = 3 then 1152 else 576 end", "header_bytes": "head", "side_info_bytes": "side",
}


@query(f"select {', '.join(KEYS)}, w as header_word, status, {', '.join(_fields_sql.format(s, n) for n, s in _header_fields.items())} from {header_sql(ODD_WORD)}")
def header_decode(spark, sf_dir):
    return words(spark, sf_dir, ODD_WORD).select(*KEYS, "header_word", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in header.FIELDS if c != "status"])


_names_sql = " ".join(f"when {v} then '{k}'" for k, v in tables.STATUS.items())


@query(f"select status, case status {_names_sql} end as status_name, count(*) as n from {header_sql(ODD_WORD)} group by 1, 2")
def header_status_histogram(spark, sf_dir):
    return words(spark, sf_dir, ODD_WORD).groupBy("status").agg(F.count("*").alias("n")).select("status", header.status_text(F.col("status")).alias("status_name"), "n")


@query(f"select v as version, rate as sample_rate_hz, kbps as bitrate_kbps, count(*) as n, cast(sum(size) as bigint) as bytes, cast(sum(case when v = 3 then 1152 else 576 end) as bigint) as samples from {header_sql(WORD)} where status = 0 group by 1, 2, 3")
def frame_size_by_format(spark, sf_dir):
    return words(spark, sf_dir).where("status = 0").groupBy("version", "sample_rate_hz", "bitrate_kbps").agg(F.count("*").alias("n"), F.sum("frame_size_bytes").alias("bytes"), F.sum("samples_per_frame").alias("samples"))


@query(f"""select {', '.join(KEYS)}, n as length, case when n < 4 then 1 when status = 0 and size > n then 1 else status end as status,
  case when n >= 4 and status = 0 then size else 0 end as frame_size_bytes from (select *, cast(l_partkey % 3 * 2 + l_orderkey % 700 as integer) as n from {header_sql(ODD_WORD)})""")
def header_in_bytes(spark, sf_dir):
    """parse_header() over buffers of different lengths."""
    df = table(spark, sf_dir, "lineitem").select(*KEYS, F.expr(f"cast({ODD_WORD} as bigint)").alias("w"), F.expr("cast(l_partkey % 3 * 2 + l_orderkey % 700 as int)").alias("length"))
    df = df.withColumn("content", F.expr("substring(concat(unhex(lpad(hex(w), 8, '0')), unhex(repeat('00', 710))), 1, length)"))
    return header.parse_header(df).select(*KEYS, "length", "status", F.coalesce(F.when(F.col("length") >= 4, F.col("frame_size_bytes")), F.lit(0)).alias("frame_size_bytes"))


# --- Index, statistics, seeking -------------------------------------------------------------------


@query(f"""select stream_id, arg_max(v, frame_no) as version, arg_max(layer_bits, frame_no) as layer, arg_max(rate, frame_no) as sample_rate_hz, arg_max(ch, frame_no) as channels,
  cast(arg_max((w >> 6) & 3, frame_no) as integer) as channel_mode, arg_max(kbps, frame_no) as bitrate_kbps, count(*) as frame_count, cast(sum(spf) as bigint) as sample_count,
  count(*) as total_frames, cast(sum(spf) as bigint) as total_samples, 1 as bitrate_mode, cast(round(sum(spf) / arg_max(rate, frame_no) * 1e6) as bigint) as duration_us from {frames_sql()} group by 1""")
def stream_info(spark, sf_dir):
    info = frame_ops.stream_info(frames(spark, sf_dir))
    return info.select("stream_id", "version", "layer", "sample_rate_hz", "channels", "channel_mode", "bitrate_kbps", "frame_count", "sample_count", "total_frames", "total_samples", "bitrate_mode", micro(F.col("duration_seconds")).alias("duration_us"))


@query(f"""select stream_id, has_vbr_header, is_vbr, total_frames, total_samples, case when has_vbr_header = 1 and is_vbr = 1 then 2 else 1 end as bitrate_mode, has_vbr_header as gapless_available, encoder_delay from (
  select stream_id, cast(stream_id % 2 as integer) as has_vbr_header, cast(case when stream_id % 2 = 1 then stream_id % 4 // 2 else 0 end as integer) as is_vbr,
    cast(case when stream_id % 6 = 1 then 100 + stream_id else count(*) end as bigint) as total_frames,
    cast(case when stream_id % 6 = 1 then (100 + stream_id) * case when arg_max(v, frame_no) = 3 then 1152 else 576 end else sum(spf) end as bigint) as total_samples,
    cast(case when stream_id % 2 = 1 then stream_id * 3 else 0 end as integer) as encoder_delay from {frames_sql()} group by 1)""")
def stream_info_declared(spark, sf_dir):
    """Declared totals win over counted ones; a Xing header makes a stream variable."""
    fs = frames(spark, sf_dir)
    declared = fs.select("stream_id").distinct().where("stream_id % 2 = 1").select(
        "stream_id", F.lit(1).alias("has_vbr_header"), F.expr("cast(stream_id % 4 div 2 as int)").alias("is_vbr"), F.expr("if(stream_id % 6 = 1, 100 + stream_id, 0)").alias("total_frames"),
        F.lit(1).alias("has_gapless"), F.expr("cast(stream_id * 3 as int)").alias("encoder_delay"), F.lit(0).alias("end_padding"),
    )
    return frame_ops.stream_info(fs, declared).select("stream_id", "has_vbr_header", "is_vbr", "total_frames", "total_samples", "bitrate_mode", "gapless_available", "encoder_delay")


_index_sql = f"""(select *, coalesce(sum(size) over b, 0) as byte_offset, coalesce(sum(spf) over b, 0) as sample_offset from {frames_sql()} window b as (partition by stream_id order by frame_no rows between unbounded preceding and 1 preceding))"""


@query(f"select stream_id, frame_no, cast(byte_offset as bigint) as byte_offset, size as frame_size_bytes, spf as samples_per_frame, ch as channels, cast(sample_offset as bigint) as sample_offset from {_index_sql}")
def frame_index(spark, sf_dir):
    return frame_ops.frame_index(frames(spark, sf_dir)).select("stream_id", "frame_no", "byte_offset", "frame_size_bytes", "samples_per_frame", "channels", "sample_offset")


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("cast(event_id % 100 + 1 as bigint)").alias("stream_id"), F.expr("cast(event_id * 577 % 400000 as bigint)").alias("target"))


@query(f"""with i as (select * from {_index_sql}), p as (select event_id, cast(event_id % 100 + 1 as bigint) as stream_id, cast(event_id * 577 % 400000 as bigint) as target from events)
  select event_id, stream_id, target, coalesce(arg_max(frame_no, sample_offset), -1) as frame_no, cast(coalesce(max(sample_offset), -1) as bigint) as sample_offset from p left join i using (stream_id)
  where sample_offset is null or sample_offset <= target group by 1, 2, 3""")
def seek_lookup(spark, sf_dir):
    index = frame_ops.frame_index(frames(spark, sf_dir)).select("stream_id", "frame_no", "sample_offset", "samples_per_frame")
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return frame_ops.frame_at(index, _probes(spark, sf_dir), "target").select("event_id", "stream_id", "target", none("frame_no"), none("sample_offset"))


@query(f"""with i as (select * from {_index_sql}), s as (select stream_id, arg_min(rate, frame_no) as rate, sum(spf) as total from i group by 1),
  p as (select event_id, cast(event_id % 100 + 1 as bigint) as stream_id, (event_id % 37 - 3) / 4 as seconds from events),
  t as (select *, cast(floor(seconds * rate) as bigint) as target from p left join s using (stream_id)),
  f as (select event_id, max(frame_no) as frame_no, max(sample_offset) as landed from t join i using (stream_id) where sample_offset <= target group by 1)
  select event_id, stream_id, cast(case when seconds < 0 then -3 when rate is null then -9 when target >= total then -10 else 0 end as integer) as status,
    case when seconds >= 0 and target < total then frame_no else -1 end as frame_no,
    cast(round(case when seconds < 0 or rate is null then -1 when target >= total then total / rate else landed / rate end * 1e6) as bigint) as actual_us from t left join f using (event_id)""")
def seek_seconds(spark, sf_dir):
    index = frame_ops.frame_index(frames(spark, sf_dir))
    asked = table(spark, sf_dir, "events").select("event_id", F.expr("cast(event_id % 100 + 1 as bigint)").alias("stream_id"), F.expr("cast((event_id % 37 - 3) / 4 as double)").alias("seconds"))
    return frame_ops.seek(index, asked).select("event_id", "stream_id", "status", F.coalesce("frame_no", F.lit(-1)).alias("frame_no"), micro(F.coalesce("actual_seconds", F.lit(-1.0))).alias("actual_us"))


@query(f"""with i as (select * from {_index_sql})
  select stream_id, frame_no, coalesce(max(frame_no) over (partition by stream_id order by byte_offset range between unbounded preceding and 4096 preceding), 1) as warmup_frame from i""")
def warmup_start(spark, sf_dir):
    return frame_ops.warm_up_start(frames(spark, sf_dir)).select("stream_id", "frame_no", "warmup_frame")


@query(f"""with i as (select *, stream_id * 37 % 2000 as low, greatest(sum(spf) over (partition by stream_id) - stream_id * 53 % 1500, stream_id * 37 % 2000) as high from {_index_sql})
  select stream_id, count(*) as frames, cast(sum(greatest(least(sample_offset + spf, low) - sample_offset, 0)) as bigint) as cut_front,
    cast(sum(greatest(sample_offset + spf - greatest(sample_offset, high), 0)) as bigint) as cut_end,
    cast(sum(greatest(least(sample_offset + spf, high) - greatest(sample_offset, low), 0)) as bigint) as kept from i group by 1""")
def gapless_trim(spark, sf_dir):
    index = frame_ops.frame_index(frames(spark, sf_dir))
    out = frame_ops.trimmed(index, F.expr("stream_id * 37 % 2000"), F.expr("stream_id * 53 % 1500"))
    return out.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("cut_front").alias("cut_front"), F.sum("cut_end").alias("cut_end"), F.sum(F.greatest(F.col("keep_to") - F.col("keep_from"), F.lit(0))).alias("kept"))


@query("select user_id as stream_id, max(event_id) as generation, arg_max(cast(floor(value) as bigint), event_id) as target from events group by 1")
def player_latest_seek(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("generation"), F.floor("value").cast("long").alias("target"))
    return frame_ops.latest_seek(asked)


@query(f"""with i as (select * from {_index_sql}), p as (select event_id, cast(event_id % 100 + 1 as bigint) as stream_id, cast(event_id * 577 % 400000 as bigint) as target from events),
  f as (select event_id, stream_id, max(sample_offset) as at_sample from p join i using (stream_id) where sample_offset <= target group by 1, 2), r as (select stream_id, arg_min(rate, frame_no) as rate from i group by 1)
  select event_id, stream_id, frame_no, cast(sample_offset as bigint) as sample_offset from i join f using (stream_id) join r using (stream_id) where sample_offset >= at_sample and sample_offset < at_sample + 0.5 * r.rate""")
def page_from_seek(spark, sf_dir):
    """Half a second of frames from the position of each event."""
    index = frame_ops.frame_index(frames(spark, sf_dir))
    return frame_ops.page(index, _probes(spark, sf_dir), 0.5).select("event_id", "stream_id", "frame_no", "sample_offset")


_commands = "['load', 'play', 'pause', 'stop', 'play', 'pause', 'play']"


@query(f"""with recursive c as (select user_id as stream_id, event_id as seq, {_commands}[event_id * 5 % 7 + 1] as command, row_number() over (partition by user_id order by event_id) as k from events),
  s as (select stream_id, seq, command, k, case when command = 'load' then 'Loaded' else 'NoFile' end as state from c where k = 1
    union all select c.stream_id, c.seq, c.command, c.k, case when c.command = 'load' then 'Loaded' when s.state = 'NoFile' then 'NoFile' when c.command = 'play' then 'Playing' when c.command = 'stop' then 'Stopped'
      when s.state = 'Playing' then 'Paused' else s.state end from s join c on c.stream_id = s.stream_id and c.k = s.k + 1)
  select stream_id, seq, command, state from s""")
def player_states(spark, sf_dir):
    command = F.element_at(F.array(*map(F.lit, ("load", "play", "pause", "stop", "play", "pause", "play"))), F.expr("cast(event_id * 5 % 7 + 1 as int)"))
    return frame_ops.player_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), command.alias("command")))


@query("""select *, cast(round(audio / decode * 1e6) as bigint) as realtime_micro from (select count(*) as runs, cast(sum(l_partkey % 50 + 1) as bigint) as audio, cast(sum(l_suppkey % 9 + 1) as bigint) as decode, cast(sum(l_orderkey % 1000) as bigint) as bytes from lineitem)""")
def benchmark_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 50 + 1 as audio_seconds", "l_suppkey % 9 + 1 as decode_seconds", "l_orderkey % 1000 as bytes")
    return frame_ops.totals(runs).select("runs", F.col("audio_seconds").alias("audio"), F.col("decode_seconds").alias("decode"), "bytes", micro(F.col("realtime_factor")).alias("realtime_micro"))


# --- Tags and stream headers in bytes -------------------------------------------------------------


@query("""select *, cast(case when n < 3 then 1 when l_linenumber = 3 then -4 when n < 10 then 1 when major not between 2 and 4 or greatest(a, b, c, d) > 127 then -1 else 0 end as integer) as status,
  cast(case when n >= 10 and l_linenumber <> 3 and major between 2 and 4 and greatest(a, b, c, d) <= 127 then a * 2097152 + b * 16384 + c * 128 + d + 10 + case when major = 4 and flags & 16 <> 0 then 10 else 0 end else 0 end as integer) as size
  from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(1 + l_orderkey % 5 as integer) as major, cast(l_partkey % 2 * 16 as integer) as flags, cast(l_suppkey % 3 as integer) as a,
    cast(l_partkey % 130 as integer) as b, cast(l_orderkey % 128 as integer) as c, cast(l_suppkey % 128 as integer) as d, cast(12 - l_partkey % 11 as integer) as n from lineitem)""")
def id3_size(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(1 + l_orderkey % 5 as int) as major", "cast(l_partkey % 2 * 16 as int) as flags", "cast(l_suppkey % 3 as int) as a",
        "cast(l_partkey % 130 as int) as b", "cast(l_orderkey % 128 as int) as c", "cast(l_suppkey % 128 as int) as d", "cast(12 - l_partkey % 11 as int) as n",
    )
    hexed = "concat(if(l_linenumber = 3, '494434', '494433'), lpad(hex(major), 2, '0'), '00', lpad(hex(flags), 2, '0'), lpad(hex(a), 2, '0'), lpad(hex(b), 2, '0'), lpad(hex(c), 2, '0'), lpad(hex(d), 2, '0'), '0000')"
    df = df.withColumn("content", F.expr(f"substring(unhex({hexed}), 1, n)"))
    return df.withColumns({"status": metadata.id3_status(F.col("content")), "size": metadata.id3_size(F.col("content"))}).drop("content")


_XING = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"""select {_XING}, flags, kind, cast(case when kind = 2 then -4 else 0 end as integer) as vbr_status, case when kind = 2 then 0 else 1 end as has_vbr_header, case when kind = 0 then 1 else 0 end as is_vbr,
  case when kind < 2 and flags & 1 <> 0 then l_orderkey else 0 end as total_frames, case when kind < 2 and flags & 2 <> 0 then l_partkey * 417 else 0 end as total_bytes,
  case when kind < 2 and flags & 8 <> 0 then l_suppkey else 0 end as quality, case when kind < 2 and flags & 4 <> 0 then 1 else 0 end as has_toc,
  case when kind < 2 and l_linenumber % 2 = 1 then 1 else 0 end as has_gapless, cast(case when kind < 2 and l_linenumber % 2 = 1 then l_orderkey % 4096 else 0 end as integer) as encoder_delay,
  cast(case when kind < 2 and l_linenumber % 2 = 1 then l_partkey % 4096 else 0 end as integer) as end_padding, case when kind < 2 and l_linenumber % 2 = 1 then 'LAME3.100' end as encoder
  from (select *, cast(l_partkey % 16 as integer) as flags, cast(l_suppkey % 3 as integer) as kind from lineitem)""")
def vbr_xing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(*_XING.split(", "), "cast(l_partkey % 16 as int) as flags", "cast(l_suppkey % 3 as int) as kind")
    big = lambda x: f"lpad(hex(cast({x} as bigint)), 8, '0')"
    hexed = f"""concat(repeat('00', 36), case kind when 0 then hex('Xing') when 1 then hex('Info') else '00000000' end, {big("flags")},
      if(flags & 1 <> 0, {big("l_orderkey")}, ''), if(flags & 2 <> 0, {big("l_partkey * 417")}, ''), if(flags & 4 <> 0, repeat('07', 100), ''), if(flags & 8 <> 0, {big("l_suppkey")}, ''),
      if(l_linenumber % 2 = 1, concat(hex('LAME3.100'), repeat('00', 12), lpad(hex(l_orderkey % 4096), 3, '0'), lpad(hex(l_partkey % 4096), 3, '0')), ''), repeat('00', 40))"""
    df = df.withColumns({"content": F.expr(f"unhex({hexed})"), "side_start": F.lit(36)})
    return metadata.with_stream_header(df).drop("content", "side_start", "toc")


@query(f"""select {_XING}, case when ok then 0 else -4 end as vbr_status, case when ok then 1 else 0 end as is_vbr, case when ok then l_orderkey else 0 end as total_frames,
  case when ok then l_partkey * 417 else 0 end as total_bytes, case when ok then l_suppkey else 0 end as quality from (select *, l_linenumber <> 2 as ok from lineitem)""")
def vbr_vbri(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(*_XING.split(", "))
    hexed = "concat(repeat('00', 36), if(l_linenumber = 2, '00000000', hex('VBRI')), '00000000', lpad(hex(l_suppkey), 4, '0'), lpad(hex(l_partkey * 417), 8, '0'), lpad(hex(l_orderkey), 8, '0'), repeat('00', 20))"
    df = df.withColumns({"content": F.expr(f"unhex({hexed})"), "side_start": F.lit(21)})
    return metadata.with_stream_header(df).select(*_XING.split(", "), "vbr_status", "is_vbr", "total_frames", "total_bytes", "quality")


@query("""select o_orderkey, pos, case when pos + 13 > 64 then -1 else ((case when pos + 13 <= 32 then hi >> (19 - pos) when pos >= 32 then lo >> (51 - pos) else (hi << (pos - 19)) | (lo >> (51 - pos)) end) & 8191) end as slice
  from (select o_orderkey, cast(o_custkey % 60 as bigint) as pos, (o_orderkey * 2654435761) % 4294967296 as hi, (o_custkey * 40503) % 4294967296 as lo from orders)""")
def bit_slice(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_custkey % 60 as bigint) as pos", "unhex(concat(lpad(hex((o_orderkey * 2654435761) % 4294967296), 8, '0'), lpad(hex((o_custkey * 40503) % 4294967296), 8, '0'))) as content")
    return df.select("o_orderkey", "pos", F.coalesce(bits.bit_slice(F.col("content"), F.col("pos"), 13), F.lit(-1)).alias("slice"))


# --- Samples --------------------------------------------------------------------------------------


@query("select event_id, cast(round_even(greatest(least((value - 50) / 40 * 32768, 32767), -32768), 0) as smallint) as pcm16 from events")
def pcm_quantise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", pcm.quantise((F.col("value") - 50) / 40).alias("pcm16"))


@query("select vec_id, cast(i - 1 as integer) as pos, cast(embedding[case when i % 2 = 1 then (i + 1) // 2 else 32 + i // 2 end] as double) as value from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)")
def interleave(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pcm.interleave(F.slice(e, 1, 32), F.slice(e, 33, 32))).alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


@query("select vec_id, cast(i as integer) as pos, cast(embedding[2 * i + 2] as double) as value from (select vec_id, embedding, unnest(range(0, 32)) as i from embeddings)")
def deinterleave(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pcm.deinterleave(F.col("embedding"), 2, 1)).alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


def _signal(spark, sf_dir, scale: float = 1.0):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    q = pcm.quantise((F.col("value") - 50) / 40 * scale)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(by) - 1).cast("long").alias("sample_no"), q.alias("value"))


def _signal_sql(scale: float) -> str:
    return f"(select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_no, cast(round_even(greatest(least((value - 50) / 40 * {scale!r} * 32768, 32767), -32768), 0) as bigint) as v from events)"


@query(f"""select stream_id, count(*) as n, max(abs(x.v - y.v)) as max_diff, cast(round(sqrt(sum(x.v * x.v) / count(*)) * 1e6) as bigint) as rms_x, cast(round(sqrt(sum((x.v - y.v) * (x.v - y.v)) / count(*)) * 1e6) as bigint) as rms_diff,
  cast(round(case when sum((x.v - y.v) * (x.v - y.v)) = 0 then 999 when sum(x.v * x.v) = 0 then 0 else 10 * log10(sum(x.v * x.v) / sum((x.v - y.v) * (x.v - y.v))) end * 1e6) as bigint) as snr,
  count(*) filter (abs(x.v) >= 32767) as clipped_x, count(*) filter (abs(y.v) >= 32767) as clipped_y, sum((x.v - y.v) * (x.v - y.v)) = 0 as identical
  from {_signal_sql(1.0)} x join {_signal_sql(0.75)} y using (stream_id, sample_no) group by 1""")
def pcm_compare(spark, sf_dir):
    out = signal.compare(_signal(spark, sf_dir), _signal(spark, sf_dir, 0.75))
    return out.select("stream_id", "n", "max_diff", micro(F.col("rms_x")).alias("rms_x"), micro(F.col("rms_diff")).alias("rms_diff"), micro(F.col("snr_db")).alias("snr"), "clipped_x", "clipped_y", "identical")


@query("""select user_id as stream_id, count(*) as n, count(*) filter (event_id % 50 = 0) as not_finite, max(abs(value)) filter (event_id % 50 <> 0) as peak from events group by 1""")
def pcm_peaks(spark, sf_dir):
    x = F.when(F.col("event_id") % 100 == 0, float("nan")).when(F.col("event_id") % 50 == 0, float("-inf")).otherwise(F.col("value"))
    return signal.peaks(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), x.alias("value")))


@query(f"select stream_id, sample_no // 16 as granule_no, count(*) as n, min(v)::smallint as low, max(v)::smallint as high, cast(sum(v) as bigint) as total from {_signal_sql(1.0)} group by 1, 2")
def granule_windows(spark, sf_dir):
    return frame_ops.granule_windows(_signal(spark, sf_dir), 16)


@query(f"""with s as (select * from {_signal_sql(1.0)}), n as (select stream_id, max(sample_no) + 1 as n from s group by 1),
  o as (select stream_id, n, unnest(range(greatest(cast(round(n * 48000 / 44100) as bigint), 1))) as out_no from n),
  p as (select *, out_no * 44100.0::double / 48000.0::double as source from o), q as (select *, least(cast(floor(source) as bigint), n - 1) as i0 from p)
  select stream_id, out_no, cast(round((a.v / 32768 + (source - i0) * (b.v / 32768 - a.v / 32768)) * 1e6) as bigint) as value from q
  join s a using (stream_id) join s b using (stream_id) where a.sample_no = i0 and b.sample_no = least(i0 + 1, n - 1)""")
def resample_linear(spark, sf_dir):
    return signal.resample(_signal(spark, sf_dir), 44100, 48000).select("stream_id", "out_no", micro(F.col("value")).alias("value"))


@query("""select vec_id, cast(i as integer) as pos, cast(round_even(greatest(least((a + b) * 0.5 * 32767, 32767), -32768), 0) as smallint) as mono from
  (select vec_id, i, embedding[i + 1]::double as a, embedding[i + 33]::double as b from (select vec_id, embedding, unnest(range(0, 32)) as i from embeddings))""")
def device_downmix(spark, sf_dir):
    e = F.col("embedding")
    mono = F.zip_with(F.slice(e, 1, 32), F.slice(e, 33, 32), lambda a, b: signal.device_sample(signal.downmix(a.cast("double"), b.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mono).alias("pos", "mono"))


@query("select event_id, lpad(cast(cast(floor(value * 40 + 0.5) as bigint) // 60 as varchar), cast(greatest(2, length(cast(cast(floor(value * 40 + 0.5) as bigint) // 60 as varchar))) as integer), '0') || ':' || lpad(cast(cast(floor(value * 40 + 0.5) as bigint) % 60 as varchar), 2, '0') as label from events")
def mmss_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", pcm.mmss(F.col("value") * 40).alias("label"))


def _le(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', cast(({x}) // {256**i} % 256 as integer))" for i in range(n))


@query(f"""select user_id as stream_id, n, '52494646' || {_le("36 + 2 * n", 4)} || '57415645666D74201000000001000200' || {_le("44100", 4)} || {_le("176400", 4)} || '04001000' || '64617461' || {_le("2 * n", 4)} as header
  from (select user_id, count(*) as n from events group by 1)""")
def wav_header(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_id")).agg(F.count("*").alias("n"))
    return n.select("stream_id", "n", F.hex(wav.header(F.col("n"), F.lit(44100), F.lit(2))).alias("header"))


# --- Spectra --------------------------------------------------------------------------------------

_HALF = repr(math.sqrt(0.5))


@query(f"""select vec_id, cast(i as integer) as pos, cast(round((m + s) * {_HALF} * 1e6) as bigint) as l, cast(round((m - s) * {_HALF} * 1e6) as bigint) as r from
  (select vec_id, i, embedding[i + 1]::double as m, embedding[i + 33]::double as s from (select vec_id, embedding, unnest(range(0, 32)) as i from embeddings))""")
def ms_stereo(spark, sf_dir):
    e = F.col("embedding")
    left, right = spectrum.middle_side(F.slice(e, 1, 32), F.slice(e, 33, 32))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("pos", "x")).select("vec_id", "pos", micro(F.col("x.l")).alias("l"), micro(F.col("x.r")).alias("r"))


_ratio = lambda i: "[" + ", ".join(repr(x[i]) for x in [*tables.intensity_ratios(), (1.0, 0.0)]) + "]"


@query(f"""select vec_id, cast(i as integer) as pos, cast(round(case when go then m * {_ratio(0)}[p + 1] else m end * 1e6) as bigint) as l, cast(round(case when go then m * {_ratio(1)}[p + 1] else s end * 1e6) as bigint) as r from
  (select *, p < 7 and i >= from_line as go from (select vec_id, i, cast(vec_id % 9 as integer) as p, vec_id % 32 as from_line, embedding[i + 1]::double as m, embedding[i + 33]::double as s from (select vec_id, embedding, unnest(range(0, 32)) as i from embeddings)))""")
def intensity_stereo(spark, sf_dir):
    e = F.col("embedding")
    left, right = spectrum.intensity(F.slice(e, 1, 32), F.slice(e, 33, 32), F.expr("cast(vec_id % 32 as int)"), F.expr("cast(vec_id % 9 as int)"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("pos", "x")).select("vec_id", "pos", micro(F.col("x.l")).alias("l"), micro(F.col("x.r")).alias("r"))


_band_list = "[" + ", ".join(str(int(b)) for b in tables.band_of_line(44100)) + "]"
_pre_list = "[" + ", ".join(map(str, tables.PRETAB)) + "]"


@query(f"""select {', '.join(KEYS)}, line, cast(band as integer) as band, cast(round(case when v = 0 then 0 else sign(v) * power(abs(v), {4 / 3!r}) * power(2, (gain - 214) * 0.25 - (1 + scale) * 0.5 * (factor + case when pre = 1 then {_pre_list}[band + 1] else 0 end)) end * 1e6) as bigint) as xr
  from (select *, {_band_list}[line + 1] as band from (select *, cast((l_orderkey * 8 + l_linenumber) % 576 as integer) as line, l_partkey % 31 - 15 as v, 180 + l_suppkey % 40 as gain, l_orderkey % 2 as scale, l_partkey % 5 as factor, l_linenumber % 2 as pre from lineitem))""")
def requantise_long(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("line", F.expr("cast((l_orderkey * 8 + l_linenumber) % 576 as int)"))
    df = df.withColumn("band", spectrum.band_of(F.col("line"), 44100))
    pre = F.when(F.col("l_linenumber") % 2 == 1, header.pick(tables.PRETAB, F.col("band"))).otherwise(0)
    xr = spectrum.requantised(F.expr("l_partkey % 31 - 15"), F.expr("180 + l_suppkey % 40"), F.expr("l_orderkey % 2"), F.expr("l_partkey % 5"), pre)
    return df.select(*KEYS, "line", "band", micro(xr).alias("xr"))


_cos = lambda i: "[" + ", ".join(repr(x[i]) for x in tables.butterflies()) + "]"


@query(f"""with x as (select vec_id, i, embedding[i + 1]::double as v from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings)),
  k as (select *, i % 18 as low, case when i % 18 >= 10 and i < 54 then 17 - i % 18 when i % 18 < 8 and i >= 18 then i % 18 end as k from x),
  p as (select *, case when k is null then null when low >= 10 then i + 1 + 2 * k else i - 1 - 2 * k end as j from k)
  select p.vec_id, cast(p.i as integer) as pos, cast(round(case when p.k is null then p.v when p.low >= 10 then p.v * {_cos(0)}[p.k + 1] - coalesce(x.v, 0) * {_cos(1)}[p.k + 1] else p.v * {_cos(0)}[p.k + 1] + x.v * {_cos(1)}[p.k + 1] end * 1e6) as bigint) as value
  from p left join x on x.vec_id = p.vec_id and x.i = p.j""")
def antialias(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(spectrum.antialiased(F.col("embedding"), 3)).alias("pos", "v")).select("vec_id", "pos", micro(F.col("v")).alias("value"))


@query("select vec_id, cast(i as integer) as pos, case when i // 32 % 2 = 1 and i % 2 = 1 then -v else v end as value from (select vec_id, i, embedding[i + 1]::double as v from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings))")
def freq_inversion(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(hybrid.inverted(F.col("embedding"))).alias("pos", "value"))


@query("""select vec_id, cast(step as integer) as step, cast(i as integer) as pos, cast(round(sum(embedding[32 * step + k + 1]::double * 2 * cos((16 + i) * (2 * k + 1) * pi() / 64)) * 1e6) as bigint) as value
  from embeddings, range(0, 2) a(step), range(0, 64) b(i), range(0, 32) c(k) group by 1, 2, 3""")
def synthesis_step(spark, sf_dir):
    steps = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("step"))
    values = hybrid.synthesis_vector(F.slice("embedding", 32 * F.col("step") + 1, 32))
    return steps.select("vec_id", "step", F.posexplode(values).alias("pos", "v")).select("vec_id", "step", "pos", micro(F.col("v")).alias("value"))


@query("""select vec_id, cast(sb as integer) as sb, cast(i as integer) as pos, cast(round(sum(coalesce(embedding[18 * sb + k + 1]::double, 0) * cos(pi() / 72 * (2 * i + 19) * (2 * k + 1))) * 1e6) as bigint) as value
  from embeddings, range(0, 4) a(sb), range(0, 36) b(i), range(0, 18) c(k) group by 1, 2, 3""")
def imdct_long(spark, sf_dir):
    """Four blocks of 18 lines from each vector; zeros follow its end."""
    lines = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 8))
    blocks = table(spark, sf_dir, "embeddings").select("vec_id", lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sb"))
    values = hybrid.imdct_long(F.slice("lines", 18 * F.col("sb") + 1, 18))
    return blocks.select("vec_id", "sb", F.posexplode(values).alias("pos", "v")).select("vec_id", "sb", "pos", micro(F.col("v")).alias("value"))


@query("""select vec_id, count(*) filter (v <> 0) as non_zero, coalesce(max(i + 1) filter (v <> 0), 0) as zero_start from
  (select vec_id, i, trunc(embedding[i + 1]::double * 3) as v from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings)) group by 1""")
def coefficient_stats(spark, sf_dir):
    v = F.transform("embedding", lambda x: (x.cast("double") * 3).cast("int"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    last = F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return df.select("vec_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("non_zero"), last.cast("long").alias("zero_start"))


@query(f"""select {', '.join(KEYS)}, cast(case when one then {[s[0] for s in tables.SLEN]}[c % 16 + 1] when c < 400 then c // 16 // 5 when c < 500 then (c - 400) // 4 // 5 else (c - 500) // 3 end as integer) as slen1,
  cast(case when one then {[s[1] for s in tables.SLEN]}[c % 16 + 1] when c < 400 then c // 16 % 5 when c < 500 then (c - 400) // 4 % 5 else (c - 500) % 3 end as integer) as slen2,
  cast(case when one then 0 when c < 400 then c % 16 // 4 when c < 500 then (c - 400) % 4 else 0 end as integer) as slen3, cast(case when one or c >= 400 then 0 else c % 4 end as integer) as slen4
  from (select *, l_partkey * 7 % 512 as c, l_orderkey % 2 = 1 as one from lineitem)""")
def scalefactor_lengths(spark, sf_dir):
    cols = entropy.slen_columns(F.expr("if(l_orderkey % 2 = 1, 3, 2)"), F.expr("cast(l_partkey * 7 % 512 as int)"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, *[c.alias(f"slen{i}") for i, c in enumerate(cols, 1)])


_bands_values = ", ".join(f"({r}, {i}, {b})" for r in (44100, 48000, 32000, 22050, 24000) for i, b in enumerate(tables.LONG_BANDS[r]))


@query(f"""with b(rate, i, line) as (values {_bands_values}), g as (select *, [44100, 48000, 32000, 22050, 24000][l_suppkey % 5 + 1] as rate, l_partkey % 16 + 1 as i0, l_partkey % 16 + l_orderkey % 8 + 2 as i1 from lineitem)
  select {', '.join('g.' + k for k in KEYS)}, coalesce(x.line, 576) as region0_end, coalesce(y.line, 576) as region1_end from g left join b x on x.rate = g.rate and x.i = g.i0 left join b y on y.rate = g.rate and y.i = g.i1""")
def region_split(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    all_bands = F.array(*[F.array(*map(F.lit, tables.LONG_BANDS[r])) for r in (44100, 48000, 32000, 22050, 24000)])
    mine = F.element_at(all_bands, F.expr("cast(l_suppkey % 5 as int)") + 1)
    at = lambda e: F.coalesce(F.get(mine, F.expr(f"cast({e} as int)")), F.lit(576))
    return df.select(*KEYS, at("l_partkey % 16 + 1").alias("region0_end"), at("l_partkey % 16 + l_orderkey % 8 + 2").alias("region1_end"))


# --- Reservoir, bytes to samples ------------------------------------------------------------------

_begin, _bits = "l_partkey * 7 % 512", "l_orderkey * 13 % (8 * (size - head - side) + 1)"


@query(f"""with recursive f as (select stream_id, frame_no, cast({_begin} as integer) as b, size - head - side as n, cast({_bits} as integer) as bits, l_partkey % 29 <> 0 as ok from {frames_sql()}),
  r as (select stream_id, frame_no, 0 as held, b, n, bits, ok from f where frame_no = 1
    union all select f.stream_id, f.frame_no, case when not r.ok then 0 when r.held < r.b then least(r.held + r.n, 2048) else least(greatest(r.b + r.n - (r.bits + 7) // 8, 0), 2048) end, f.b, f.n, f.bits, f.ok
      from r join f on f.stream_id = r.stream_id and f.frame_no = r.frame_no + 1)
  select stream_id, frame_no, held, cast(case when not ok then -1 when held < b then -5 else 0 end as integer) as status, case when ok and held >= b then b + n else 0 end as assembled from r""")
def reservoir_fold(spark, sf_dir):
    fs = frames(spark, sf_dir).withColumn("size", F.col("frame_size_bytes")).withColumn("main_len", F.expr("frame_size_bytes - header_bytes - side_info_bytes"))
    bits_ = F.expr("cast(l_orderkey * 13 % (8 * main_len + 1) as int)")
    fs = fs.select("stream_id", "frame_no", F.expr(f"cast({_begin} as int)").alias("main_data_begin"), "main_len", bits_.alias("part2_3_bits"), F.expr("l_partkey % 29 <> 0").alias("side_ok"))
    return reservoir_ops.fold_sizes(fs).select("stream_id", "frame_no", "held", "status", "assembled")


def _stream_bytes(spark, sf_dir):
    """One source for each supplier: silent frames, five junk bytes before each."""
    import pyarrow as pa

    def run(batches):
        now, parts = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([str(now)]), pa.array([b"".join(parts)], pa.binary())], ["stream_id", "content"])

        for batch in batches:
            for stream, word, size in zip(*[batch.column(c).to_pylist() for c in ("stream_id", "header_word", "frame_size_bytes")], strict=True):
                if stream != now:
                    if parts:
                        yield row()
                    now, parts = stream, []
                parts += [b"\x55" * 5, word.to_bytes(4, "big"), bytes(size - 4)]
        if parts:
            yield row()

    few = frames(spark, sf_dir).select("stream_id", "frame_no", "header_word", "frame_size_bytes")
    dealt = few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_id").sortWithinPartitions("stream_id", "frame_no")
    return dealt.mapInArrow(run, "stream_id string, content binary")


_scan_sql = f"select cast(stream_id as varchar) as stream_id, frame_no - 1 as frame_no, cast(byte_offset + 5 * frame_no as bigint) as byte_offset, size as frame_size_bytes from {_index_sql}"


@query(_scan_sql)
def frame_scan(spark, sf_dir):
    return files.scan_frames(_stream_bytes(spark, sf_dir)).select("stream_id", "frame_no", "byte_offset", "frame_size_bytes")


@query(f"""with n as (select stream_id, count(*) as n from {frames_sql()} group by 1)
  select cast(s_suppkey as varchar) as stream_id, case when n is not null then 0 when s_suppkey % 8 = 3 then -3 else -4 end as status, n is not null as seekable, coalesce(n, 0) as n_frames from supplier left join n on s_suppkey = stream_id""")
def source_status(spark, sf_dir):
    """Sources with frames, with bytes that hold none, and without bytes."""
    bare = F.when(F.col("s_suppkey") % 8 != 3, F.encode(F.concat_ws(" ", F.lit("no audio here"), F.col("s_suppkey").cast("string")), "utf-8"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stream_id"), bare.alias("bare"))
    sources = sources.join(_stream_bytes(spark, sf_dir), "stream_id", "left").select("stream_id", F.coalesce("content", "bare").alias("content"))
    return files.source_status(sources, files.scan_frames(sources))


@query(f"select cast(stream_id as varchar) as stream_id, count(*) as frames, cast(sum(spf * ch) as bigint) as samples, 0.0::double as peak, cast(0 as smallint) as low16, cast(0 as smallint) as high16 from {frames_sql()} group by 1")
def decode_pcm(spark, sf_dir):
    """Silent streams through the whole decoder."""
    out = decode.pcm_sources(_stream_bytes(spark, sf_dir))
    peak = F.greatest(F.array_max("pcm_float"), -F.array_min("pcm_float")).cast("double")
    return out.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum(F.size("pcm16")).alias("samples"), F.max(peak).alias("peak"), F.min(F.array_min("pcm16")).alias("low16"), F.max(F.array_max("pcm16")).alias("high16"))


@query(f"""select cast(stream_id as varchar) as stream_id, count(*) as frames, cast(sum(spf // 576 * ch) as bigint) as granules, cast(0 as bigint) as bad from {frames_sql()} group by 1""")
def granule_table(spark, sf_dir):
    out = decode.granules(files.scan_frames(_stream_bytes(spark, sf_dir)))
    return out.groupBy("stream_id").agg(F.count_if((F.col("gr") == 0) & (F.col("ch") == 0)).alias("frames"), F.count_if(F.size("xr") == 576).alias("granules"), F.count_if((F.col("status") != 0) | (F.col("non_zero") != 0)).alias("bad"))


@query(f"""with f as (select * from {frames_sql()})
  select cast(stream_id as varchar) as stream_id, count(*) + 1 as frame_count, cast(case when stream_id % 2 = 1 then 500 + stream_id else count(*) + 1 end as bigint) as total_frames,
    cast(case when stream_id % 2 = 1 then (500 + stream_id) * case when arg_max(v, frame_no) = 3 then 1152 else 576 end else sum(spf) + 1152 end as bigint) as total_samples, 1 as bitrate_mode from f group by stream_id""")
def stream_info_from_bytes(spark, sf_dir):
    """Statistics of whole streams: an Info frame (of 44.1 kHz, stereo) comes first in every second."""
    info = "concat(unhex('FFFB9000'), unhex(repeat('00', 32)), unhex(if(cast(stream_id as int) % 2 = 1, concat(hex('Info'), '00000001', lpad(hex(500 + cast(stream_id as int)), 8, '0')), repeat('00', 12))), unhex(repeat('00', 369)))"
    sources = _stream_bytes(spark, sf_dir).select("stream_id", F.expr(f"concat({info}, content)").alias("content"))
    found = files.scan_frames(sources)
    return frame_ops.stream_info(found, frame_ops.stream_headers(found)).select("stream_id", "frame_count", "total_frames", "total_samples", "bitrate_mode")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(status as integer) as status, x0, y0, x1, y1, cast(case when y1 <> 0 then 4 when x1 <> 0 then 3 when y0 <> 0 then 2 when x0 <> 0 then 1 else 0 end as integer) as zero_start from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 as status, cast(l_partkey % 3 - 1 as integer) as x0, cast(l_suppkey % 3 - 1 as integer) as y0, cast(l_orderkey % 3 - 1 as integer) as x1, cast(l_linenumber % 3 - 1 as integer) as y1 from lineitem)")
def huffman_decode(spark, sf_dir):
    """Two pairs coded with table 1 and decoded again."""
    import pyarrow as pa

    code = lambda x, y: f"concat(case when {x} = 0 and {y} = 0 then '1' when {x} = 0 then '001' when {y} = 0 then '01' else '000' end, if({x} = 0, '', if({x} < 0, '1', '0')), if({y} = 0, '', if({y} < 0, '1', '0')))"
    df = table(spark, sf_dir, "lineitem").selectExpr(*KEYS, "cast(l_partkey % 3 - 1 as int) as x0", "cast(l_suppkey % 3 - 1 as int) as y0", "cast(l_orderkey % 3 - 1 as int) as x1", "cast(l_linenumber % 3 - 1 as int) as y1")
    df = df.withColumn("code", F.expr(f"concat({code('x0', 'y0')}, {code('x1', 'y1')})"))
    df = df.select(*KEYS, F.length("code").alias("n"), F.expr("unhex(lpad(conv(rpad(code, 16, '0'), 2, 16), 4, '0'))").alias("data"))

    def run(batches):
        books = tables.codebooks()
        g = {"window_switching": 0, "region0_count": 0, "region1_count": 0, "big_values": 2, "table_select": [1, 1, 1], "count1table": 0}
        for batch in batches:
            rows = [entropy.spectrum(bits.Bits(d), 44100, g, n, books) for n, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            out = [[s for s, _ in rows], *[[v[i] for _, v in rows] for i in range(4)], [entropy.zero_start(v) for _, v in rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(x, pa.int32()) for x in out]], [*KEYS, "status", "x0", "y0", "x1", "y1", "zero_start"])

    return df.mapInArrow(run, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, status int, x0 int, y0 int, x1 int, y1 int, zero_start int")


def _streamed(spark, source, decoded):
    """What decoded() makes of the streams cut into chunks of an odd size, run until all are read."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="bitwave-")
    at = f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"
    size = 4093
    pieces = source.select("stream_id", "content", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / size).cast("int"))).alias("i"))
    pieces.select("stream_id", F.col("i").cast("long").alias("seq"), F.expr(f"substring(content, i * {size} + 1, {size})").alias("chunk")).write.parquet(f"{at}/chunks")
    out = decoded(spark.readStream.schema(stream_decoder.CHUNKS).parquet(f"{at}/chunks"))
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(_scan_sql)
def stream_decode(spark, sf_dir):
    """The frames by Structured Streaming."""
    return _streamed(spark, _stream_bytes(spark, sf_dir), lambda chunks: stream_decoder.stream_frames(chunks).select("stream_id", "frame_no", "byte_offset", "frame_size_bytes"))


@query(f"select cast(stream_id as varchar) as stream_id, count(*) as frames, cast(sum(spf * ch) as bigint) as samples, cast(0 as smallint) as low16, cast(0 as smallint) as high16 from {frames_sql()} group by 1")
def stream_pcm(spark, sf_dir):
    """The samples by Structured Streaming."""
    each = [F.size("pcm16").alias("n"), F.array_min("pcm16").alias("low"), F.array_max("pcm16").alias("high")]
    out = _streamed(spark, _stream_bytes(spark, sf_dir), lambda chunks: stream_samples(chunks, columns=("stream_id", "pcm16")).select("stream_id", *each))
    return out.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("n").alias("samples"), F.min("low").alias("low16"), F.max("high").alias("high16"))


@query(coded.ORACLES["decode_frames"])
def stream_coded(spark, sf_dir):
    """The samples of coded streams by Structured Streaming, as those of the batch."""
    out = _streamed(spark, coded.streams(spark, sf_dir), stream_samples).where("status = 0")
    sample = out.select("stream_id", F.explode("pcm16").alias("v"))
    return sample.groupBy("stream_id").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


QUERIES |= coded.QUERIES
ORACLES |= coded.ORACLES
