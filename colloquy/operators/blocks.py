"""Long frame sequences in blocks: ``*keys, block, values`` has the frames from block * size on.

A recording is neither one row nor one task: a slice is joined with the blocks it needs by key and
number of the block, and its pieces are put together only where an array is wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import intervals

#: The number of frames of a recording is read by this many tasks at most.
SALTS = 32


def blocked(frames: DataFrame, keys: list[str], frame: str, value: str, size: int) -> DataFrame:
    """Frames from 0 on, each once; a block with a gap or a repeated frame raises."""
    inside = F.pmod(F.col(frame), F.lit(size)).cast("bigint")
    rows = frames.select(*keys, F.floor(F.col(frame) / size).alias("block"), F.struct(inside.alias("at"), F.col(value).alias("value")).alias("_x"))
    packed = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_x"), lambda a, b: (a["at"] - b["at"]).cast("int")).alias("_x"))
    dense = F.transform("_x", lambda x: x["at"]) == F.sequence(F.lit(0).cast("bigint"), F.size("_x").cast("bigint") - 1)
    values = F.transform("_x", lambda x: x["value"])
    return packed.select(*keys, "block", F.when(dense, values).otherwise(F.raise_error(F.lit("a frame is missing or repeated"))).alias("values"))


def active_blocks(spans: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Spans ``s, e`` of whole frames as blocks of booleans; a block without activity has no row."""
    last = F.floor((F.col("e") - 1) / size)
    cut = spans.where("s < e").select(*keys, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / size), last)).alias("block"))
    first = F.col("block") * size
    cut = cut.select(*keys, "block", F.greatest(F.col("s") - first, F.lit(0)).alias("s"), F.least(F.col("e") - first, F.lit(size)).alias("e")).distinct()
    packed = intervals.union(cut, [*keys, "block"]).groupBy(*keys, "block").agg(F.collect_list(F.struct("s", "e")).alias("_x"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return packed.select(*keys, "block", F.transform(places, lambda i: F.exists("_x", lambda x: (x["s"] <= i) & (i < x["e"]))).alias("values"))


def _lengths(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``*keys, _n, _salt``: frames of each key; a missing or repeated block raises."""
    count, stop = F.sum(F.size("values")), F.max(F.col("block") * size + F.size("values"))
    whole = blocks.groupBy(*keys).agg(F.when(count == stop, stop).otherwise(F.raise_error(F.lit("a block is missing or repeated")).cast("bigint")).alias("_n"))
    return whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _joined(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which nulls are equal and the left side's columns stay."""
    other = other.withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    return rows.join(other, same, how).drop(*[f"_on_{k}" for k in on])


def pieces(spans: DataFrame, blocks: DataFrame, keys: list[str], size: int, missing: Column | None = None) -> DataFrame:
    """The columns of ``spans`` (with ``s, e``), ``at`` and ``values``: frames s to e in pieces of blocks.

    ``at`` is the place of a piece in its slice. Before its first and after its last frame a key has
    these repeated; with ``missing``, blocks are whole, and what has no block has that value. An empty
    span or one with a null has no piece; a key without blocks raises unless there is ``missing``.
    """
    s, e = F.col("s"), F.col("e")
    rows = spans.where(s < e)
    if missing is None:
        salt = F.pmod(F.xxhash64("s", "e"), F.lit(SALTS)).cast("int")
        rows = _joined(rows.withColumn("_salt", salt), _lengths(blocks, keys, size), [*keys, "_salt"], "left").drop("_salt")
        n = F.coalesce("_n", F.raise_error(F.lit("no frames of a slice's key")).cast("bigint"))
        inside = lambda x: F.greatest(F.least(x, n - 1), F.lit(0))
    else:
        inside = lambda x: x
    rows = rows.withColumns({"_b0": F.floor(inside(s) / size), "_b1": F.floor(inside(e - 1) / size)})
    rows = rows.withColumn("block", F.explode(F.sequence("_b0", "_b1")))
    start = F.when(F.col("block") == F.col("_b0"), s).otherwise(F.col("block") * size)
    stop = F.when(F.col("block") == F.col("_b1"), e).otherwise((F.col("block") + 1) * size)
    found = _joined(rows, blocks.select(*keys, "block", "values"), [*keys, "block"], "left")
    values = vectors.edge_slice(F.col("values"), start - F.col("block") * size, stop - F.col("block") * size)
    if missing is not None:
        values = F.when(F.col("values").isNull(), F.array_repeat(missing, (stop - start).cast("int"))).otherwise(values)
    return found.select(*spans.columns, (start - s).alias("at"), values.alias("values"))


def stitched(rows: DataFrame, by: list[str]) -> DataFrame:
    """``*by, values``: the pieces of each slice as one array; ``by`` names the slice."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "values")), lambda a, b: (a["at"] - b["at"]).cast("int"))
    return rows.groupBy(*by).agg(F.flatten(F.transform(ordered, lambda x: x["values"])).alias("values"))


def framewise_region(start: Column, end: Column, window: int = 400, shift: int = 160, stride: int = 4, lost: int = 5) -> tuple[Column, Column]:
    """First and last (exclusive) strided frame for samples start to end, before 0 or beyond the end too.

    A span has ceil((samples - window + shift) / shift) frames, whole or not, and begins with the frame
    whose centre is nearest to its start. Every ``stride``-th one has an embedding, but for the first
    ``lost`` of these.
    """
    frames = F.greatest(F.ceil((end - start - window + shift) / shift), F.lit(1))
    first = F.greatest(F.floor((start - window // 2 + shift // 2) / shift), F.lit(0))
    begin = F.floor(first / stride) - lost
    return begin.cast("bigint"), (begin + F.ceil(frames / stride)).cast("bigint")
