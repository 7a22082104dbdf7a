"""Frame headers as column expressions: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

FIELDS = (
    "status", "version", "layer", "bitrate_kbps", "sample_rate_hz", "channels", "channel_mode", "mode_extension", "has_crc", "padding",
    "private_bit", "copyright", "original", "emphasis", "frame_size_bytes", "samples_per_frame", "header_bytes", "side_info_bytes",
)


def bits(word: Column, shift: int, width: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def word_at(content: Column, pos: Column) -> Column:
    """The big-endian 32-bit word at a zero-based byte position of a binary column, as a long."""
    return F.conv(F.hex(F.substring(content, pos + 1, F.lit(4))), 16, 10).cast("long")


def with_header(df: DataFrame, word: str = "header_word") -> DataFrame:
    """df with the header fields of a 32-bit word in a long column; all but status are null unless the
    status is 0."""
    w, s = F.col(word), tables.STATUS
    version, layer, key = bits(w, 19, 2), bits(w, 17, 2), bits(w, 10, 11)
    statuses, sizes = tables.header_tables()
    one = version == 3
    kbps = pick(tables.BITRATES_2 + tables.BITRATES_1, F.when(one, 16).otherwise(0) + bits(w, 12, 4))
    rate = pick(tables.RATES, version * 4 + bits(w, 10, 2))
    channels = F.when(bits(w, 6, 2) == 3, 1).otherwise(2)
    side = pick((17, 9, 32, 17), F.when(one, 2).otherwise(0) + (2 - channels))
    head = F.when(bits(w, 16, 1) == 0, 6).otherwise(4)
    size = pick(sizes, key) + bits(w, 9, 1)
    # Tables by the bits of the word keep this short: a filter on the status is not worth a page of code.
    known = pick(statuses, key)
    status = F.when(bits(w, 21, 11) != 2047, s["INVALID_HEADER"]).when((known == 0) & (bits(w, 0, 2) == 2), s["INVALID_HEADER"]).otherwise(known)
    values = {
        "version": version, "layer": layer, "bitrate_kbps": kbps, "sample_rate_hz": rate, "channels": channels, "channel_mode": bits(w, 6, 2),
        "mode_extension": bits(w, 4, 2), "has_crc": F.when(bits(w, 16, 1) == 0, 1).otherwise(0), "padding": bits(w, 9, 1), "private_bit": bits(w, 8, 1),
        "copyright": bits(w, 3, 1), "original": bits(w, 2, 1), "emphasis": bits(w, 0, 2), "frame_size_bytes": size,
        "samples_per_frame": F.when(one, 1152).otherwise(576), "header_bytes": head, "side_info_bytes": side,
    }
    df = df.withColumn("status", status)
    return df.withColumns({k: F.when(F.col("status") == 0, v).cast("int") for k, v in values.items()})


def parse_header(df: DataFrame, content: str = "content") -> DataFrame:
    """df with the header at the start of a binary column: null is INVALID_ARG, fewer than four bytes
    or a frame longer than the column NEED_MORE_DATA (then with the fields filled)."""
    c = F.col(content)
    out = with_header(df.withColumn("header_word", F.when(F.length(c) >= 4, word_at(c, F.lit(0)))))
    s = tables.STATUS
    status = (
        F.when(c.isNull(), s["INVALID_ARG"]).when(F.length(c) < 4, s["NEED_MORE_DATA"])
        .when((F.col("status") == 0) & (F.col("frame_size_bytes") > F.length(c)), s["NEED_MORE_DATA"]).otherwise(F.col("status"))
    )
    return out.withColumn("status", status)


def status_text(status: Column) -> Column:
    """The name of a status number; others are UNKNOWN."""
    pairs = [x for k, v in tables.STATUS.items() for x in (F.lit(v), F.lit(k))]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), F.lit("UNKNOWN"))
