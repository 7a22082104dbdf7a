"""Sample expressions: quantising, interleaving, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(x: Column) -> Column:
    """A sample as 16 bits: scaled by 32768, clamped, rounded half to even; NaN is 0."""
    scaled = F.rint(F.least(F.greatest(x.cast("double") * 32768.0, F.lit(-32768.0)), F.lit(32767.0)))
    return F.when(F.isnan(x), 0).otherwise(scaled).cast("smallint")


def quantise_all(xs: Column) -> Column:
    return F.transform(xs, quantise)


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))


def deinterleave(xs: Column, channels: int, channel: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(xs) / channels).cast("int") - 1), lambda i: F.element_at(xs, i * channels + channel + 1))


def mmss(seconds: Column) -> Column:
    """m:ss labels with two digits each, seconds rounded half up."""
    whole = F.floor(seconds + 0.5).cast("long")
    return F.concat_ws(":", _two(F.floor(whole / 60).cast("long")), _two(whole % 60))


def _two(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
