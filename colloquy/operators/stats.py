"""Two-moment statistics of vectors, domain adaptation and profiles. Deviations are population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def mean_std(rows: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """``*by, dim, mean, std, n`` of the elements of an array column."""
    by = by or []
    each = rows.select(*by, F.posexplode(vector).alias("dim", "_x")).withColumn("_x", F.col("_x").cast("double"))
    return each.groupBy(*by, "dim").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.count("_x").alias("n"))


def moments(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """``*by, n, x, xx``: sums that can be stored and merged."""
    v = value.cast("double")
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("x"), F.sum(v * v).alias("xx"))


def merged_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation out of stored moments."""
    total = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    mean = F.col("x") / F.col("n")
    return total.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("xx") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def embedding_mean_std(rows: DataFrame, vector: str, path: str, by: list[str] | None = None) -> DataFrame:
    """mean_std() over distinct paths that aren't empty."""
    return mean_std(rows.where(F.col(path) != "").dropDuplicates([path]), vector, by)


def auxiliary_mean_std(rows: DataFrame, auxiliary: str, by: list[str] | None = None) -> DataFrame:
    """mean_std() of vectors, or of all vectors in matrices (arrays of vectors, a row for each speaker)."""
    element = rows.schema[auxiliary].dataType.elementType
    flat = rows.select(*(by or []), F.explode(auxiliary).alias(auxiliary)) if isinstance(element, ArrayType) else rows
    return mean_std(flat, auxiliary, by)


def as_arrays(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``*by, mean, std`` as arrays in the order of ``dim``: one row a group, as long as a vector."""
    rows = stats.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    return rows.select(*(by or []), F.col("_s.mean").alias("mean"), F.col("_s.std").alias("std"))


def adapted(rows: DataFrame, vector: str, source: DataFrame, target: DataFrame, method: str = "mean_std") -> DataFrame:
    """Vectors moved from the source's statistics (as_arrays()) to the target's.

    ``mean_std`` scales each dimension, ``mean_scale`` all by the ratio of the mean deviations,
    ``mean`` only shifts. The statistics are one row each, as long as a vector.
    """
    one = source.select(F.col("mean").alias("_me"), F.col("std").alias("_se")).crossJoin(target.select(F.col("mean").alias("_mv"), F.col("std").alias("_sv")))
    both = rows.crossJoin(F.broadcast(one))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scale = {
        "mean_std": lambda i: F.get("_sv", i) / F.get("_se", i),
        "mean_scale": lambda i: total(F.col("_sv")) / total(F.col("_se")),
        "mean": lambda i: F.lit(1.0),
    }[method]
    move = lambda x, i: (x.cast("double") - F.get("_me", i)) * scale(i) + F.get("_mv", i)
    return both.withColumn(vector, F.transform(vector, move)).drop("_me", "_se", "_mv", "_sv")


def lower_median(value: Column) -> Column:
    """The lower middle element, not the mean of two."""
    return F.percentile_disc(value, F.lit(0.5)) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value._jc.toString()})")


def profile(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Counts of NaN, infinite and finite values, and the range of the finite."""
    x = F.col(value).cast("double")
    infinite = F.abs(x) == float("inf")
    finite = F.when(~F.isnan(x) & ~infinite, x)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(infinite).alias("n_inf"),
        F.count(finite).alias("n_finite"),
        F.min(finite).alias("low"),
        F.percentile(finite, 0.5).alias("median"),
        F.max(finite).alias("high"),
    )


def mean_without(rows: DataFrame, path: str, part: int, value: str) -> DataFrame:
    """``path, mean, n`` over rows whose paths (arrays) differ in one part only, which is left out; the part from 1."""
    rest = F.concat(F.slice(path, 1, part - 1), F.slice(path, part + 1, F.greatest(F.size(path) - part, F.lit(0))))
    return rows.groupBy(rest.alias(path)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
