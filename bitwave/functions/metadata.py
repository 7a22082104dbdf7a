"""Tags and stream headers in bytes: ID3v2 size, Xing/Info, VBRI, encoder delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def byte_at(content: Column, pos: Column | int) -> Column:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.conv(F.hex(F.substring(content, pos + 1, F.lit(1))), 16, 10).cast("int")


def uint_at(content: Column, pos: Column | int, size: int) -> Column:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.conv(F.hex(F.substring(content, pos + 1, F.lit(size))), 16, 10).cast("long")


def text_at(content: Column, pos: Column | int, size: int) -> Column:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.substring(content, pos + 1, F.lit(size)).cast("string")


def synchsafe(a: Column, b: Column, c: Column, d: Column) -> Column:
    low = lambda x: x.bitwiseAND(127)
    return F.shiftleft(low(a), 21) + F.shiftleft(low(b), 14) + F.shiftleft(low(c), 7) + low(d)


def id3_status(content: Column) -> Column:
    s, n = tables.STATUS, F.length(content)
    size = [byte_at(content, i) for i in (6, 7, 8, 9)]
    return (
        F.when(content.isNull(), s["INVALID_ARG"]).when(n < 3, s["NEED_MORE_DATA"])
        .when(F.hex(F.substring(content, 1, 3)) != "494433", s["SYNC_NOT_FOUND"])
        .when(n < 10, s["NEED_MORE_DATA"])
        .when(~byte_at(content, 3).between(2, 4), s["INVALID_HEADER"])
        .when((size[0] > 127) | (size[1] > 127) | (size[2] > 127) | (size[3] > 127), s["INVALID_HEADER"])
        .otherwise(s["OK"])
    )


def id3_size(content: Column) -> Column:
    """Bytes of the tag with its header and footer, 0 without a whole valid header."""
    footer = F.when((byte_at(content, 3) == 4) & (byte_at(content, 5).bitwiseAND(16) != 0), 10).otherwise(0)
    size = synchsafe(*[byte_at(content, i) for i in (6, 7, 8, 9)]) + 10 + footer
    return F.when(id3_status(content) == 0, size).otherwise(0)


def with_stream_header(df: DataFrame, content: str = "content", side_start: str = "side_start") -> DataFrame:
    """df with vbr_status and the fields of a Xing/Info header at the end of the side information
    (side_start: its zero-based end), else of a VBRI header at byte 36."""
    c, n, at = F.col(content), F.length(F.col(content)), F.col(side_start)
    tag = text_at(c, at, 4)
    df = df.withColumn("x_kind", F.when(n >= at + 8, F.when(tag == "Xing", 1).when(tag == "Info", 0)))
    df = df.withColumn("x_flags", F.when(F.col("x_kind").isNotNull(), uint_at(c, at + 4, 4)))
    cursor, flags = at + 8, F.col("x_flags")
    for i, (name, size) in enumerate((("frames", 4), ("bytes", 4), ("toc", 100), ("quality", 4))):
        df = df.withColumn(f"x_has_{name}", F.coalesce(flags.bitwiseAND(1 << i) != 0, F.lit(False)) & (n >= cursor + size))
        df = df.withColumn(f"x_at_{name}", cursor)
        df = df.withColumn("x_cursor", cursor + F.when(F.col(f"x_has_{name}"), size).otherwise(0))
        cursor = F.col("x_cursor")
    field = lambda name: F.when(F.col(f"x_has_{name}"), uint_at(c, F.col(f"x_at_{name}"), 4)).otherwise(0)
    vbri = (n >= 62) & (text_at(c, 36, 4) == "VBRI")
    kind = F.col("x_kind")
    lame = kind.isNotNull() & (n >= F.col("x_cursor") + 24) & text_at(c, F.col("x_cursor"), 4).isin("LAME", "Lavc", "Lavf")
    gap = [byte_at(c, F.col("x_cursor") + 21 + i) for i in range(3)]
    out = df.withColumns({
        "vbr_status": F.when(kind.isNotNull() | vbri, 0).otherwise(tables.STATUS["SYNC_NOT_FOUND"]),
        "has_vbr_header": F.when(kind.isNotNull() | vbri, 1).otherwise(0),
        "is_vbr": F.when(kind.isNotNull(), kind).when(vbri, 1).otherwise(0),
        "total_frames": F.when(kind.isNotNull(), field("frames")).when(vbri, uint_at(c, 50, 4)).otherwise(0),
        "total_bytes": F.when(kind.isNotNull(), field("bytes")).when(vbri, uint_at(c, 46, 4)).otherwise(0),
        "quality": F.when(kind.isNotNull(), field("quality")).when(vbri, uint_at(c, 44, 2)).otherwise(0),
        "has_toc": F.when(F.col("x_has_toc"), 1).otherwise(0),
        "toc": F.when(F.col("x_has_toc"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: byte_at(c, F.col("x_at_toc") + i).cast("short"))),
        "has_gapless": F.when(lame, 1).otherwise(0),
        "encoder_delay": F.when(lame, F.shiftleft(gap[0], 4) + F.shiftright(gap[1], 4)).otherwise(0),
        "end_padding": F.when(lame, F.shiftleft(gap[1].bitwiseAND(15), 8) + gap[2]).otherwise(0),
        "encoder": F.when(lame, text_at(c, F.col("x_cursor"), 9)),
    })
    return out.drop(*[x for x in out.columns if x.startswith("x_")])
