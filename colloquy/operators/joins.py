"""Lookups with a defined miss: error, fallback key, prefix, or first of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """An inner join, and the rows whose key the table lacks, for a check."""
    return rows.join(table, key), rows.join(table, key, "left_anti")


def with_fallback(rows: DataFrame, table: DataFrame, key: str, fallback: Column, value: str) -> DataFrame:
    """``value`` by the exact key, else by the fallback key, else null."""
    exact = table.select(F.col(key).alias("_k"), F.col(value).alias("_exact"))
    other = table.select(F.col(key).alias("_k2"), F.col(value).alias("_other"))
    joined = rows.join(exact, F.col(key) == F.col("_k"), "left").withColumn("_f", fallback)
    joined = joined.join(other, F.col("_f") == F.col("_k2"), "left")
    return joined.withColumn(value, F.coalesce("_exact", "_other")).drop("_k", "_k2", "_exact", "_other", "_f")


def by_prefix(rows: DataFrame, table: DataFrame, key: str, value: str, min_length: int = 1) -> DataFrame:
    """``value`` by the exact key, else the one value that all keys beginning with it share.

    Keys are exploded to their prefixes, so the join stays one on equality; a key whose prefix
    matches several values gets null. A key is short, so its prefixes are few.
    """
    prefixes = table.select(F.explode(F.transform(F.sequence(F.lit(min_length), F.greatest(F.length(key), F.lit(min_length))), lambda i: F.substring(key, F.lit(1), i))).alias("_p"), F.col(key).alias("_key"), value)
    known = prefixes.groupBy("_p").agg(
        F.max(F.when(F.col("_key") == F.col("_p"), F.col(value))).alias("_exact"),
        F.when(F.min(value) == F.max(value), F.min(value)).alias("_shared"),
    )
    return rows.join(known, F.col(key) == F.col("_p"), "left").withColumn(value, F.coalesce("_exact", "_shared")).drop("_p", "_exact", "_shared")


def first_of_equals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_if_equal(rows: DataFrame, keys: list[str], order: list[str], equal: list[str]) -> DataFrame:
    """One row a key: the first in order; raises where rows of a key differ in ``equal``."""
    whole, same = F.struct(*rows.columns), F.struct(*equal)
    once = rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_r"), F.min(same).alias("_a"), F.max(same).alias("_b"))
    checked = F.when(F.col("_a") == F.col("_b"), F.col("_r")).otherwise(F.raise_error(F.lit("rows of one key differ")))
    return once.select(checked.alias("_r")).select("_r.*")


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """ValueError with one of them if a and b share keys; nulls are equal."""
    shared = a.select(*keys).intersect(b.select(*keys)).first()
    if shared is not None:
        raise ValueError(f"in both: {shared.asDict()}")


def renamed_ids(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """``key`` replaced by ``name``, a column made of it; raises where there is no name or two keys get one.

    Names are counted over distinct keys; only those that are wrong are joined with the rows.
    """
    known = rows.select(F.col(key)).distinct().withColumn("_name", name)
    names = known.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("no name of its own: "), F.coalesce(F.col(key), F.lit("null")))).cast("string")
    checked = names.where("_n > 1 OR _name IS NULL").withColumnRenamed("_name", "_bad")
    joined = rows.withColumn("_name", name).join(checked, F.col("_name").eqNullSafe(F.col("_bad")), "left")
    fine = F.col("_n").isNull()
    return joined.withColumn(key, F.when(fine, F.col("_name")).otherwise(wrong)).drop("_name", "_bad", "_n")


def same_sets(a: Column, b: Column) -> Column:
    """Whether two arrays have the same elements."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def once_for_each(rows: DataFrame, key: str, compute, weight: Column | None = None) -> DataFrame:
    """``compute`` (a function of a DataFrame of distinct keys) joined back to every row.

    Catalyst doesn't merge equal inputs of a UDF; this does. With a weight, the longest inputs
    are dealt out first, so that none is left for the end.
    """
    distinct = rows.select(key).distinct() if weight is None else rows.groupBy(key).agg(F.max(weight).alias("_w"))
    if weight is not None:
        distinct = distinct.repartition(key).sortWithinPartitions(F.desc("_w")).drop("_w")
    return rows.join(compute(distinct), key, "left")


def speaker_vectors(examples: DataFrame, table: DataFrame, *, estimate: Column | None = None) -> DataFrame:
    """Examples with ``vectors``, one for each of their speakers, and ``reason``, null where they have all of them.

    examples: ``example_id, embedding_id, speaker_id`` (an array, repeats allowed); they take the vectors of
    ``embedding_id``, else of ``example_id``. table: ``example_id, speaker_id, ord, path, embedding``, a row for
    each speaker of a recording, whose last row counts. Vectors come in order of the example's speakers; where
    ``estimate`` holds, whose speakers have no names in common, in order of the table's. The reasons: no
    vectors, other speakers, an empty path.
    """
    entry = F.struct("ord", "speaker_id", "path", "embedding")
    held = table.groupBy(F.col("example_id").alias("_id")).agg(F.array_sort(F.collect_list(entry)).alias("_t"))
    both = examples.withColumn("_key", F.coalesce("embedding_id", "example_id")).join(held, F.col("_key") == F.col("_id"), "left")
    theirs = F.array_distinct(F.col("_t.speaker_id"))
    own = F.array_distinct("speaker_id")
    free = F.coalesce(estimate, F.lit(False)) if estimate is not None else F.lit(False)
    empty = F.exists("_t", lambda x: F.coalesce(x["path"], F.lit("")) == "")
    reason = F.when(F.col("_t").isNull(), "no vectors").when(~free & ~F.coalesce(same_sets(own, theirs), F.lit(False)), "other speakers").when(~free & empty, "an empty path")
    of = lambda speaker: F.element_at(F.filter("_t", lambda x: x["speaker_id"] == speaker), -1)["embedding"]
    vectors = F.transform(F.when(free, theirs).otherwise(own), of)
    return both.withColumn("reason", reason).withColumn("vectors", F.when(F.col("reason").isNull(), vectors)).select(*examples.columns, "vectors", "reason")
