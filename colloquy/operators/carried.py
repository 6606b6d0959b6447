"""Running values over long keys without one sort a key.

Rows of a key are cut into parts that follow each other. Each part is reduced to one row, these few
rows are run through in order, and what they come to is carried into the parts, which then run on
their own. A task holds one part; a part is to be chosen so that it fits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, keys: list[str], part: str, *, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, minima_after: dict[str, Column] | None = None) -> DataFrame:
    """The rows with the sum or maximum of each expression over all earlier parts of their key, and
    the minimum over all later ones; null where there is no such part. Null keys are a key."""
    sums, maxima, minima_after = sums or {}, maxima or {}, minima_after or {}
    totals = rows.groupBy(*keys, part).agg(
        *[F.sum(x).alias(n) for n, x in sums.items()], *[F.max(x).alias(n) for n, x in maxima.items()], *[F.min(x).alias(n) for n, x in minima_after.items()]
    )
    by = Window.partitionBy(*keys).orderBy(part)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, part])],
        *[F.sum(n).over(before).alias(n) for n in sums],
        *[F.max(n).over(before).alias(n) for n in maxima],
        *[F.min(n).over(after).alias(n) for n in minima_after],
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, part])])
    return rows.join(carry, same).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def numbered(rows: DataFrame, keys: list[str], order: list[str], part: Column, place: str = "place") -> DataFrame:
    """The place of each row in its key, from 0, by ``order``; ``part`` may not fall along that order."""
    rows = carried(rows.withColumn("_part", part), keys, "_part", sums={"_before": F.lit(1)})
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("bigint") - 1
    return rows.withColumn(place, F.coalesce("_before", F.lit(0).cast("bigint")) + inside).drop("_part", "_before")
