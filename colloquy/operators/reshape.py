"""Nested examples to rows and back, channels, guards and set checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ..functions.commands import with_channel


def utterances(examples: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays as a row for each element with ``ord``; unequal lengths are an error."""
    sizes = F.array(*[F.size(a) for a in arrays])
    equal = F.array_min(sizes) == F.array_max(sizes)
    checked = examples.withColumn("_ok", F.assert_true(equal, F.lit("parallel arrays differ in length")))
    rows = checked.where(F.col("_ok").isNull()).select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("ord", "_u"))
    return rows.select(*keys, "ord", *[F.col(f"_u.{a}").alias(a) for a in arrays])


def examples(rows: DataFrame, keys: list[str], order: str, columns: list[str], constant: list[str] | None = None) -> DataFrame:
    """Rows of a key as parallel arrays in order. constant: columns of one value a key, kept once; two values raise."""
    constant = constant or []
    ends = [F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("n")).alias(f"_{c}") for c in constant]
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), *columns))).alias("_u"), F.count(F.lit(1)).alias("_rows"), *ends)
    equal = lambda c: F.col(f"_{c}.a").eqNullSafe(F.col(f"_{c}.b")) & F.col(f"_{c}.n").isin(F.lit(0), F.col("_rows"))
    one = [F.when(equal(c), F.col(f"_{c}.a")).otherwise(F.raise_error(F.lit(f"{c} differs inside a key"))).alias(c) for c in constant]
    return packed.select(*keys, *[F.col(f"_u.{c}").alias(c) for c in columns], *one)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; raises where a key is there twice. Only such keys are joined with the rows."""
    twice = duplicates(rows, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(twice, same, "left")
    checked = F.when(F.col("n").isNull(), F.col(keys[0])).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.concat_ws(" ", *keys))))
    return joined.withColumn(keys[0], checked).select(*rows.columns)


def explode_channels(rows: DataFrame, key: str, files: str, suffix, *, parallel: list[str] | None = None, each: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """A row for each file: ``key`` gets the file's suffix, ``parent`` keeps the old key.

    parallel: columns cut along: of an array the file's own element, as an array; a path to all channels gets the
    slice of the file's channel. each: arrays of such columns. within: columns inside which the new keys must
    differ (none: everywhere); equal ones raise. Without any of the three nothing is cut or compared.
    """
    cut = rows.withColumn("parent", F.col(key)).select(*rows.columns, "parent", F.posexplode(files).alias("_at", "_file")).withColumn(files, F.col("_file"))

    def channel(kind: DataType) -> Callable[[Column], Column]:
        return (lambda x: with_channel(x, F.col("_at"))) if isinstance(kind, StringType) else (lambda x: F.array(F.get(x, F.col("_at"))))

    for name in parallel or []:
        cut = cut.withColumn(name, channel(rows.schema[name].dataType)(F.col(name)))
    for name in each or []:
        cut = cut.withColumn(name, F.transform(name, channel(rows.schema[name].dataType.elementType)))
    named = cut.withColumn(key, F.concat_ws("_", F.col(key), suffix(F.col(files)))).drop("_at", "_file")
    return named if parallel is None and each is None and within is None else once(named, [key, *(within or [])])


def broadcast_channels(rows: DataFrame, key: str, n: int, template: str = "{}_ch{}") -> DataFrame:
    """Each row for channels 0 to n - 1 under a key of its own."""
    before, _, after = template.partition("{}")
    middle, _, end = after.partition("{}")
    each = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn(key, F.concat(F.lit(before), F.col(key), F.lit(middle), F.col("channel").cast("string"), F.lit(end)))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def retention(rows: DataFrame, kept: Column, divisor: int) -> DataFrame:
    """One row: rows, rows kept, and whether more than rows / divisor (whole) were kept."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("n_kept"))
    return counted.withColumn("enough", F.col("n_kept") > F.floor(F.col("n") / divisor))


def retained(rows: DataFrame, kept: Column, divisor: int) -> DataFrame:
    """The kept rows; ValueError, after one pass over the rows, unless they are more than rows / divisor."""
    found = retention(rows, kept, divisor).first()
    if not found["enough"]:
        raise ValueError(f"only {found['n_kept']} of {found['n']} rows would be kept")
    return rows.where(kept)


def speaker_spans(rows: DataFrame, spans: str, speaker: str = "speaker") -> DataFrame:
    """A map from speakers to arrays of structs, as a row for each struct; no row for an empty or null one."""
    others = [c for c in rows.columns if c != spans]
    each = rows.select(*others, F.explode(spans).alias(speaker, "_spans"))
    return each.select(*others, speaker, F.inline("_spans"))


def stacked(rows: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """``*keys, values``: the channels of a key in order; a channel missing from 0 on, or there twice, raises."""
    order = F.array_sort(F.collect_list(F.struct(F.col(channel).alias("at"), F.col(value).alias("value"))), lambda a, b: (a["at"] - b["at"]).cast("int"))
    packed = rows.groupBy(*keys).agg(order.alias("_x"))
    whole = F.transform("_x", lambda x: x["at"].cast("bigint")) == F.sequence(F.lit(0).cast("bigint"), F.size("_x").cast("bigint") - 1)
    return packed.select(*keys, F.when(whole, F.transform("_x", lambda x: x["value"])).otherwise(F.raise_error(F.lit("a channel is missing or repeated"))).alias("values"))


def inverted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``value, keys``: the sorted distinct keys of each value."""
    return rows.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def with_default_region(rows: DataFrame) -> DataFrame:
    """``uem``: where it isn't given, from ``start`` (else 0) to ``end``."""
    return rows.withColumn("uem", F.coalesce("uem", F.struct(F.coalesce("start", F.lit(0).cast("bigint")).alias("s"), F.col("end").alias("e"))))
