"""Splitting long segments at candidates, one small search for each segment."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, intervals


def optimal(candidates: Sequence[int], start: int, stop: int, max_len: int) -> list[int]:
    """Fewest splits with no piece over max_len (but where no candidate lies inside one), then
    the least sum of squared lengths, then the first in order. Quadratic in the candidates."""
    if stop - start <= max_len:
        return []
    points = [start, *candidates, stop]
    best: list[tuple[int, int, tuple[int, ...]] | None] = [(0, 0, ())] + [None] * (len(points) - 1)
    for j in range(1, len(points)):
        for i in range(j):
            length = points[j] - points[i]
            if best[i] is None or length > max_len and j - i > 1:
                continue
            n, cost, splits = best[i]
            inner = j < len(points) - 1
            now = (n + inner, cost + length * length, splits + ((points[j],) if inner else ()))
            if best[j] is None or now < best[j]:
                best[j] = now
    return list(best[-1][2])


def greedy(candidates: Sequence[int], start: int, stop: int, max_len: int) -> list[int]:
    """From left to right, a split where the next candidate would be out of reach; the last
    candidate too if the end is."""
    splits, reach = [], start + max_len
    for candidate, following in pairwise(candidates):
        if following > reach:
            splits.append(candidate)
            reach = candidate + max_len
    return [*splits, candidates[-1]] if len(candidates) and stop > reach else splits


def partial(candidates: Sequence[int], start: int, stop: int, max_len: int, redo: int = 2) -> list[int]:
    """greedy() without its last splits, and optimal() on what they leave."""
    fixed = greedy(candidates, start, stop, max_len)[:-redo]
    at = fixed[-1] if fixed else start
    return fixed + optimal([c for c in candidates if c > at], at, stop, max_len)


def quiet_centres(frames_: DataFrame, keys: list[str], *, kernel: int = 21, threshold: float = 0.2, border: int = 20, value: str = "p", frame: str = "frame") -> DataFrame:
    """``*keys, s, e, candidates`` of segments given as their frames from 0 on, none left out.

    Candidates are the centres of the runs whose dilated value is at most the threshold, if they lie
    ``border`` frames or more from both ends. A segment without any has an empty array.
    """
    wide = frames.max_filter(frames_, keys, kernel, value, frame)
    sizes = frames_.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    runs = intervals.islands(wide.where(F.col(value) <= threshold), keys, frame).join(sizes, keys)
    runs = runs.where((F.col("s") >= border) & (F.col("_n") - F.col("e") >= border))
    centres = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.floor((F.col("s") + F.col("e")) / 2))).alias("candidates"))
    rows = sizes.join(centres, keys, "left")
    none = F.array().cast("array<bigint>")
    return rows.select(*keys, F.lit(0).cast("bigint").alias("s"), F.col("_n").cast("bigint").alias("e"), F.coalesce("candidates", none).alias("candidates"))


METHODS = {"optimal": optimal, "greedy": greedy, "partial": partial}


def split_long(segments: DataFrame, max_len: int, *, method: str = "partial", margin: int = 0) -> DataFrame:
    """Segments ``..., s, e, candidates`` (array, sorted) as pieces ``..., s, e``; each split
    takes ``margin`` away on both sides. A segment is one row, so no group is gathered."""
    search = METHODS[method]

    @F.pandas_udf("array<bigint>")
    def splits(candidates: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([search([int(x) for x in c], int(a), int(b), max_len) for c, a, b in zip(candidates, s, e)])

    rows = segments.withColumn("_at", splits("candidates", "s", "e"))
    starts = F.concat(F.array("s"), F.transform("_at", lambda x: x + margin))
    stops = F.concat(F.transform("_at", lambda x: x - margin), F.array("e"))
    rows = rows.withColumn("_p", F.explode(F.arrays_zip(starts.alias("s"), stops.alias("e"))))
    return rows.withColumns({"s": F.col("_p.s"), "e": F.col("_p.e")}).drop("_at", "_p", "candidates")
