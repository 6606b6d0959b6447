"""Interval algebra: rows ``*keys, s, e`` are half-open spans of whole numbers, s < e.

Everything is one sort a key and window functions over it. Where one key holds a large share of
the rows, ``within`` cuts it into slices of that length by the starts of its spans: each slice is
sorted on its own, and only one row a slice is carried along the key. The results are the same.
Each such step reads its input twice or more, so a chain of them (exclusive, combine, subtract) is for
spans that have been written, or for keys that a task can't sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried

Keys = list[str]


def union(spans: DataFrame, keys: Keys, *, within: int | None = None) -> DataFrame:
    """Overlapping or touching spans of a key as one."""
    if not within:
        return _union(spans, keys)
    spans = _union(spans.withColumn("_part", F.floor(F.col("s") / within)), [*keys, "_part"])
    spans = carried(spans, keys, "_part", maxima={"_reach": F.col("e")})
    by = Window.partitionBy(*keys, "_part").orderBy("s", "e")
    reach = F.greatest("_reach", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    runs = spans.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), F.col("s")))
    runs = carried(runs, keys, "_part", maxima={"_open": F.col("_new")})
    run = F.coalesce(F.last("_new", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_open")
    return runs.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e")


def _union(spans: DataFrame, keys: Keys) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.select(*keys, "s", "e").withColumn("_new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e")


def depths(spans: DataFrame, keys: Keys, *, within: int | None = None, **weights: Column) -> DataFrame:
    """``*keys, s, e, depth`` and a sum of each weight: how many spans cover each elementary
    segment between their ends; segments without any are left out."""
    weights = {"depth": F.lit(1)} | weights
    weighed = spans.select(*keys, "s", "e", *[w.alias(n) for n, w in weights.items()])
    edge = lambda at, sign: weighed.select(*keys, F.col(at).alias("s"), *[(sign * F.col(n)).alias(n) for n in weights])
    steps = edge("s", 1).union(edge("e", -1)).groupBy(*keys, "s").agg(*[F.sum(n).alias(n) for n in weights])
    if within:
        steps = steps.withColumn("_part", F.floor(F.col("s") / within))
        steps = carried(steps, keys, "_part", sums={f"_{n}": F.col(n) for n in weights}, minima_after={"_next": F.col("s")})
        by = Window.partitionBy(*keys, "_part").orderBy("s")
        stop = F.coalesce(F.lead("s").over(by), "_next")
    else:
        by = Window.partitionBy(*keys).orderBy("s")
        stop = F.lead("s").over(by)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda n: F.sum(n).over(so_far) + F.coalesce(f"_{n}", F.lit(0)) if within else F.sum(n).over(so_far)
    rows = steps.select(*keys, "s", stop.alias("e"), *[total(n).alias(n) for n in weights])
    return rows.where("depth > 0 AND e IS NOT NULL")


def overlap(spans: DataFrame, keys: Keys, at_least: int = 2, *, within: int | None = None) -> DataFrame:
    """Where ``at_least`` spans are active at once."""
    return union(depths(spans, keys, within=within).where(F.col("depth") >= at_least), keys, within=within)


def exclusive(spans: DataFrame, keys: Keys, speaker: str, *, within: int | None = None) -> DataFrame:
    """Where a speaker is active and no other of the key is.

    The only speaker of a segment is the sum of the codes of those active there.
    """
    active = union(spans, [*keys, speaker], within=within)
    code = F.xxhash64(speaker).cast("decimal(20,0)")
    alone = depths(active, keys, within=within, _code=code).where("depth = 1")
    names = active.select(*keys, speaker).distinct().withColumn("_code", code.cast("decimal(38,0)"))
    alone = alone.withColumn("_code", F.col("_code").cast("decimal(38,0)"))
    return union(alone.join(names, [*keys, "_code"]), [*keys, speaker], within=within)


def complement(spans: DataFrame, keys: Keys, start: Column, stop: Column) -> DataFrame:
    """What the spans of a key leave free between ``start`` and ``stop`` (columns of spans)."""
    rows = union_with(spans, keys, start, stop)
    by = Window.partitionBy(*keys).orderBy("s")
    before = F.coalesce(F.lag("e").over(by), F.col("_start"))
    last = F.lead("s").over(by).isNull()
    gaps = rows.select(*keys, F.array(F.struct(before.alias("s"), F.col("s").alias("e")), F.when(last, F.struct(F.col("e").alias("s"), F.col("_stop").alias("e")))).alias("g"))
    return gaps.select(*keys, F.explode("g").alias("g")).where("g.s < g.e").select(*keys, "g.s", "g.e")


def union_with(spans: DataFrame, keys: Keys, start: Column, stop: Column) -> DataFrame:
    """union() with the bounds of each key, to which spans are clipped."""
    bounded = spans.select(*keys, F.greatest("s", start).alias("s"), F.least("e", stop).alias("e"), start.alias("_start"), stop.alias("_stop"))
    bounds = bounded.groupBy(*keys).agg(F.min("_start").alias("_start"), F.max("_stop").alias("_stop"))
    return union(bounded.where("s < e"), keys).join(bounds, keys)


def combine(sources: list[DataFrame], keys: Keys, at_least: int | None = None, *, within: int | None = None) -> DataFrame:
    """Where at least so many (all, if not given) of the sources are active."""
    whole = reduce(DataFrame.unionByName, [union(x, keys, within=within) for x in sources])
    return overlap(whole, keys, at_least or len(sources), within=within)


def subtract(a: DataFrame, b: DataFrame, keys: Keys, *, within: int | None = None) -> DataFrame:
    """Where a is active and b isn't."""
    marked = union(a, keys, within=within).withColumn("_a", F.lit(1)).unionByName(union(b, keys, within=within).withColumn("_a", F.lit(0)))
    return union(depths(marked, keys, within=within, _in=F.col("_a")).where("depth = 1 AND _in = 1"), keys, within=within)


def at_least(spans: DataFrame, length: int) -> DataFrame:
    return spans.where(F.col("e") - F.col("s") >= length)


def clip(spans: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Spans cut to a region and counted from its start."""
    low, high = F.greatest(F.col("s"), start), F.least(F.col("e"), stop)
    return spans.withColumns({"s": low - start, "e": high - start}).where("s < e")


def with_context(spans: DataFrame, context: int) -> DataFrame:
    """Spans widened on both sides, on the left not beyond 0."""
    return spans.withColumns({"s": F.greatest(F.lit(0), F.col("s") - context), "e": F.col("e") + context})


def with_always_on(spans: DataFrame, keys: Keys, speaker: str, name: str) -> DataFrame:
    """An additional speaker that is active from each key's first to its last sample."""
    noise = spans.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn(speaker, F.lit(name))
    return spans.unionByName(noise.select(*spans.columns))


def islands(frames: DataFrame, keys: Keys, frame: str = "frame") -> DataFrame:
    """Runs of consecutive whole numbers as spans."""
    by = Window.partitionBy(*keys).orderBy(frame)
    new = F.coalesce((F.col(frame) - F.lag(frame).over(by) > 1).cast("int"), F.lit(1))
    runs = frames.select(*keys, frame).distinct().withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(*keys, "_run").agg(F.min(frame).alias("s"), (F.max(frame) + 1).alias("e")).select(*keys, "s", "e")


def dilated_islands(frames: DataFrame, keys: Keys, kernel: int, n: int | Column, frame: str = "frame") -> DataFrame:
    """Spans of the active frames dilated by an odd kernel, within 0 to n, without dense frames."""
    half, n = kernel // 2, F.lit(n) if isinstance(n, int) else n
    wide = frames.select(*keys, F.greatest(F.lit(0), F.col(frame) - half).alias("s"), F.least(n, F.col(frame) + half + 1).alias("e"))
    return union(wide, keys)


def hysteresis(runs: DataFrame, keys: Keys, min_speech: int, min_silence: int) -> DataFrame:
    """Runs ``s, e, active`` with short ones given the state before them, as spans of activity.

    The run at 0 keeps its state whatever its length.
    """
    by = Window.partitionBy(*keys).orderBy("s")
    long = F.col("e") - F.col("s") >= F.when(F.col("active"), min_speech).otherwise(min_silence)
    state = F.last(F.when(long | (F.col("s") == 0), F.col("active")), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return union(runs.withColumn("_state", state).where("_state"), keys)
