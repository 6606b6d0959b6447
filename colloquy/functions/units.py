"""Seconds, samples and frames: one function for each rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FRAME_SHIFT, FRAME_WINDOW, SAMPLE_RATE


def rounded(value: Column, digits: int) -> Column:
    """Halves away from zero; what rounds to zero keeps its sign (-0.0), which Spark's round drops."""
    x = value.cast("double")
    near = F.round(x, digits)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def samples_by_float(seconds: Column, rate: int = SAMPLE_RATE) -> Column:
    """Truncates the floating-point product."""
    return (seconds.cast("double") * F.lit(float(rate))).cast("bigint")


def samples_by_decimal(seconds: Column, rate: int = SAMPLE_RATE) -> Column:
    """Truncates the exact decimal product."""
    return (seconds.cast("decimal(18,7)") * F.lit(rate)).cast("bigint")


def samples_by_half_even(seconds: Column, rate: int = SAMPLE_RATE) -> Column:
    """Rounds the exact decimal product, halves to even."""
    return F.bround(seconds.cast("decimal(18,7)") * F.lit(rate), 0).cast("bigint")


def seconds(samples: Column) -> Column:
    """Exact seconds of samples at 16 kHz, which need seven digits."""
    return (samples.cast("decimal(18,0)") * F.lit("0.0000625").cast("decimal(8,7)")).cast("decimal(18,7)")


def first_sample(frame: Column, window: int = FRAME_WINDOW, shift: int = FRAME_SHIFT) -> Column:
    """The first sample of a faded frame."""
    return F.greatest(F.lit(0), shift * frame - (window - shift)).cast("bigint")


def last_sample(frame: Column, shift: int = FRAME_SHIFT) -> Column:
    """The last sample of a faded frame; applied to an exclusive end frame, its sample stop."""
    return (shift * frame + (shift - 1)).cast("bigint")


def frame_of(sample: Column, window: int = FRAME_WINDOW, shift: int = FRAME_SHIFT) -> Column:
    """The frame whose first sample is the last one not after ``sample``."""
    return F.floor((sample + (window - shift)) / shift).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return day + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + second
