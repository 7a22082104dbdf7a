"""Comparison, statistics and conversion of sample tables (stream_id, sample_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, clip: int = 32767) -> DataFrame:
    """Per stream: samples in common, largest difference, RMS of both and of the error, SNR in dB (999
    without error), clipped samples, identical flag. Values are 16-bit integers, so sums are exact."""
    both = a.select("stream_id", "sample_no", F.col("value").cast("long").alias("x")).join(b.select("stream_id", "sample_no", F.col("value").cast("long").alias("y")), ["stream_id", "sample_no"])
    d = F.col("x") - F.col("y")
    out = both.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.max(F.abs(d)).alias("max_diff"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(d * d).alias("dd"),
        F.count_if(F.abs("x") >= clip).alias("clipped_x"), F.count_if(F.abs("y") >= clip).alias("clipped_y"),
    )
    rms = lambda s: F.sqrt(F.col(s) / F.col("n"))
    snr = F.when(F.col("dd") == 0, 999.0).when(F.col("xx") == 0, 0.0).otherwise(10 * F.log10(F.col("xx") / F.col("dd")))
    return out.select("stream_id", "n", "max_diff", rms("xx").alias("rms_x"), rms("yy").alias("rms_y"), rms("dd").alias("rms_diff"), snr.alias("snr_db"), "clipped_x", "clipped_y", (F.col("dd") == 0).alias("identical"))


def peaks(samples: DataFrame) -> DataFrame:
    """Per stream: samples, those that are not finite, and the peak of the rest."""
    x = F.col("value")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return samples.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(odd).alias("not_finite"), F.max(F.when(~odd, F.abs(x))).alias("peak"))


def resample(samples: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Linear interpolation: stream_id, out_no and value (double, of 16-bit input as a share of 32768).

    The positions of a stream are made from its length; the two neighbours come from keyed joins."""
    lengths = samples.groupBy("stream_id").agg((F.max("sample_no") + 1).alias("n"))
    count = F.round(F.col("n") * F.lit(rate_out) / F.lit(rate_in)).cast("long")
    at = lengths.where("n > 0").select("stream_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1)).alias("out_no"))
    source = F.col("out_no") * F.lit(float(rate_in)) / F.lit(float(rate_out))
    at = at.withColumn("source", source).withColumn("i0", F.least(F.floor("source"), F.col("n") - 1)).withColumn("i1", F.least(F.col("i0") + 1, F.col("n") - 1))
    side = lambda i: samples.select("stream_id", F.col("sample_no").alias(i), (F.col("value") / 32768.0).alias(f"v{i}"))
    out = at.join(side("i0"), ["stream_id", "i0"]).join(side("i1"), ["stream_id", "i1"])
    return out.select("stream_id", "out_no", (F.col("vi0") + (F.col("source") - F.col("i0")) * (F.col("vi1") - F.col("vi0"))).alias("value"))


def device_sample(x: Column) -> Column:
    """A share of full scale as 16 bits of a device: times 32767, clamped, rounded half to even."""
    return F.rint(F.greatest(F.least(x * 32767.0, F.lit(32767.0)), F.lit(-32768.0))).cast("smallint")


def downmix(left: Column, right: Column) -> Column:
    return (left + right) * 0.5
