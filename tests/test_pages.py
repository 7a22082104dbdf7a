from pyspark.sql import functions as F

from bitwave.operators import frames
from bitwave.plans import catalogue


def test_page_of_each_request(spark):
    index = spark.range(10).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("frame_no"), (F.col("id") * 100).alias("sample_offset"), F.lit(100).alias("samples_per_frame"), F.lit(1000).alias("sample_rate_hz"))
    asked = spark.createDataFrame([(7, 1, 150), (8, 1, 150), (9, 1, 820), (10, 2, 0)], "request long, stream_id long, target long")
    got = sorted((r.request, r.frame_no) for r in frames.page(index, asked, 0.25).collect())
    assert got == [(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (8, 3), (9, 8), (9, 9)]


def test_every_event_gets_a_page(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    got = sorted(map(tuple, catalogue.QUERIES["page_from_seek"](spark, at).collect()))
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "supplier"):
        con.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLES["page_from_seek"]).fetchall())
    assert max(r[0] for r in got) > 100
