"""Centred windows over frames, and overlapping chunks with a region of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _around(keys: list[str], size: int, frame: str):
    return Window.partitionBy(*keys).orderBy(frame).rowsBetween(-(size // 2), size // 2)


def max_filter(frames: DataFrame, keys: list[str], size: int, value: str = "p", frame: str = "frame") -> DataFrame:
    """Dilation: the maximum of an odd number of frames around each, truncated at the ends."""
    return frames.withColumn(value, F.max(value).over(_around(keys, size, frame)))


def min_filter(frames: DataFrame, keys: list[str], size: int, value: str = "p", frame: str = "frame") -> DataFrame:
    """Erosion, truncated at the ends like dilation."""
    return frames.withColumn(value, F.min(value).over(_around(keys, size, frame)))


def closing(frames: DataFrame, keys: list[str], max_size: int, min_size: int, threshold: float, value: str = "p", frame: str = "frame") -> DataFrame:
    """Dilation, erosion and a threshold: ``active``. Both windows share one sort."""
    wide = max_filter(frames, keys, max_size, value, frame)
    return min_filter(wide, keys, min_size, value, frame).withColumn("active", F.col(value) >= threshold)


def median_filter(frames: DataFrame, keys: list[str], size: int, value: str = "p", frame: str = "frame") -> DataFrame:
    """The lower median of an odd number of frames around each."""
    near = F.sort_array(F.collect_list(value).over(_around(keys, size, frame)))
    return frames.withColumn("_near", near).withColumn(value, F.get("_near", ((F.size("_near") - 1) / 2).cast("int"))).drop("_near")


def max_normalised(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Absolute values over their maximum in the key; zero stays zero.

    The maxima are aggregated and joined back, so that a key with many rows isn't one task.
    """
    tops = frames.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.max(F.abs(value)).alias("_top"))
    joined = frames.join(tops, [frames[k].eqNullSafe(tops[f"_key{i}"]) for i, k in enumerate(keys)], "left")
    normal = F.coalesce(F.abs(value) / F.nullif(F.col("_top"), F.lit(0)), F.lit(0.0))
    return joined.withColumn(value, normal).select(*frames.columns)


def tiles(regions: DataFrame, length: int, hop: int, start: Column, stop: Column) -> DataFrame:
    """Chunks of a region: ``s, e`` is read, ``s_ins, e_ins`` is kept, ``s_cut, e_cut`` inside.

    The last chunk is moved back to end with the region. The kept parts tile the region.
    """
    trim = (hop + 1) // 2
    n = F.greatest(F.lit(0), F.ceil((stop - start - length) / hop)).cast("bigint")
    k = F.col("_k")
    rows = regions.withColumns({"_start": start, "_stop": stop, "_n": n}).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    final = k == F.col("_n")
    at = F.col("_start")
    rows = rows.withColumns({
        "s": F.when(final, F.greatest(F.col("_stop") - length, at)).otherwise(at + k * hop),
        "e": F.when(final, F.col("_stop")).otherwise(at + k * hop + length),
        "s_ins": F.when(k == 0, at).otherwise(at + (k - 1) * hop + length - trim),
        "e_ins": F.when(final, F.col("_stop")).otherwise(at + k * hop + length - trim),
    })
    return rows.withColumns({"s_cut": F.col("s_ins") - F.col("s"), "e_cut": F.col("e_ins") - F.col("s")}).drop("_start", "_stop", "_n", "_k")


def tile_of(place: Column, length: int, hop: int, size: Column) -> Column:
    """``s`` of the chunk of tiles() over 0 to ``size`` that keeps a place in it."""
    n = F.greatest(F.lit(0), F.ceil((size - length) / hop)).cast("bigint")
    k = F.greatest(F.lit(0), F.floor((place - (length - (hop + 1) // 2)) / hop) + 1).cast("bigint")
    return F.when(k >= n, F.greatest(size - length, F.lit(0))).otherwise(k * hop).cast("bigint")


def differences(frames: DataFrame, keys: list[str], value: str, first: Column, frame: str = "frame") -> DataFrame:
    """``diff``: each value less the one before, the first less ``first``."""
    by = Window.partitionBy(*keys).orderBy(frame)
    return frames.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(by), first))


def is_sorted(frames: DataFrame, keys: list[str], value: str, frame: str = "frame") -> DataFrame:
    """``*keys, sorted``: whether the values never fall."""
    by = Window.partitionBy(*keys).orderBy(frame)
    rows = frames.withColumn("_up", F.coalesce(F.lag(value).over(by) <= F.col(value), F.lit(True)))
    return rows.groupBy(*keys).agg(F.bool_and("_up").alias("sorted"))
