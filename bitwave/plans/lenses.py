"""Audio inputs derived from the shared test tables, as Spark columns and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import header

WORD = "4292870144 + (l_orderkey % 4) * 524288 + 131072 + (l_linenumber % 2) * 65536 + (l_partkey % 16) * 4096 + (l_suppkey % 4) * 1024 + (l_orderkey % 2) * 512 + (l_partkey % 4) * 64"
#: The same with other layers, emphasis, mode extensions and broken sync.
ODD_WORD = f"{WORD} - 131072 + (l_partkey % 4) * 131072 + l_orderkey % 4 + (l_linenumber % 4) * 16 - case when l_linenumber = 7 then 2147483648 else 0 end"
FRAME_ORDER = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, word: str = WORD) -> DataFrame:
    return header.with_header(table(spark, sf_dir, "lineitem").withColumn("header_word", F.expr(f"cast({word} as bigint)")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid headers as frames of one stream for each supplier."""
    by = Window.partitionBy("stream_id").orderBy(*FRAME_ORDER.split(", "))
    good = words(spark, sf_dir).where("status = 0").withColumn("stream_id", F.col("l_suppkey"))
    return good.withColumn("frame_no", F.row_number().over(by).cast("long"))


def header_sql(word: str) -> str:
    """A subquery over lineitem with the header fields."""
    kbps = "[32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]"
    low = "[8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]"
    return f"""(
  select *, case when (w >> 21) & 2047 <> 2047 or v = 1 or layer_bits = 0 then -1 when layer_bits <> 1 then -2 when bi = 15 then -1 when bi = 0 then -2
                 when ri = 3 or w & 3 = 2 then -1 when size < head + side then -1 else 0 end as status
  from (select *, cast((case when v = 3 then 144000 else 72000 end * kbps) // greatest(rate, 1) + ((w >> 9) & 1) as integer) as size,
               case when v = 3 then case when ch = 1 then 17 else 32 end else case when ch = 1 then 9 else 17 end end as side,
               case when (w >> 16) & 1 = 0 then 6 else 4 end as head
        from (select *, case when bi between 1 and 14 then case when v = 3 then {kbps}[bi] else {low}[bi] end else 0 end as kbps,
                     case when ri = 3 then 0 when v = 3 then [44100, 48000, 32000][ri + 1] when v = 2 then [22050, 24000, 16000][ri + 1] when v = 0 then [11025, 12000, 8000][ri + 1] else 0 end as rate,
                     case when (w >> 6) & 3 = 3 then 1 else 2 end as ch
              from (select *, cast((w >> 19) & 3 as integer) as v, cast((w >> 17) & 3 as integer) as layer_bits, cast((w >> 12) & 15 as integer) as bi, cast((w >> 10) & 3 as integer) as ri
                    from (select *, cast({word} as bigint) as w from lineitem)))))"""


def frames_sql() -> str:
    """A subquery: stream_id, frame_no, size, spf, rate and more of the frames."""
    return f"""(select *, l_suppkey as stream_id, cast(case when v = 3 then 1152 else 576 end as integer) as spf,
      row_number() over (partition by l_suppkey order by {FRAME_ORDER}) as frame_no from {header_sql(WORD)} where status = 0)"""
