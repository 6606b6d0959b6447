"""Operator 7, document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct hashes of a text's shingles of five
words (fewer words: all of them as one shingle). Sketches of parts merge into the sketch of the
whole, and estimate resemblance, containment and the number of distinct shingles. Everything is
a built-in expression; no Python.

Defined cases: a null text counts as empty, whose sketch is empty; two empty sketches resemble
each other by 1, an empty one and another by 0; equal texts have equal sketches; rows of equal
id are ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import words_of

#: Hashes in a sketch, and words in a shingle.
SIZE, WORDS = 128, 5
#: Rows in a range of ids, and ranges at most (the table of ranges is the only one in one task).
RANGE_ROWS, MAX_RANGES = 512, 65_536
#: Quantiles of the ids that the ranges are cut from.
QUANTILES = 64


def sketch_of(words: Column, *, size: int = SIZE, width: int = WORDS) -> Column:
    """The sketch of a column of words. ``words`` should be a plain column: it is read often."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, size))


def merged(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, size)


def merge_parts(parts: DataFrame, keys: list[str], *, sketch_col: str = "sketch", size: int = SIZE, salts: int = 64) -> DataFrame:
    """One sketch for each key out of the sketches of its parts.

    Each part adds at most ``size`` hashes; salted sub-groups keep their smallest first, so no
    task sees more than ``salts * size`` hashes of a hot key in the second step.
    """
    rows = parts.select(*keys, F.explode(sketch_col).alias("_h")).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    rows = rows.distinct()
    for by in ([*keys, "_salt"], keys):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= size).drop("_r")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that is in both."""
    both = merged(a, b, size=size)
    share = F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, *, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    filled = (F.element_at(a, size).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / filled)


def containment(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has too."""
    r = resemblance(a, b, size=size)
    shared = r / (1 + r) * (distinct_shingles(a, size=size) + distinct_shingles(b, size=size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size=size)))


def as_text(sketch: Column) -> Column:
    """A sketch written out."""
    return F.array_join(sketch.cast("array<string>"), " ")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``id_col, text`` (empty for null) and ``sketch`` of every whole text; no shuffle."""
    return _sketched(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), size)


def _sketched(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("_words", words_of(F.col("text"))).select(*rows.columns, sketch_of(F.col("_words"), size=size).alias("sketch"))


def id_ranges(docs: DataFrame, id_col: str) -> Column:
    """The number of the range that a row's id lies in; ranges ascend with the ids.

    Cut at quantiles of the ids and evenly between them: gaps or clusters of ids don't pile up.
    """
    at = [k / QUANTILES for k in range(QUANTILES + 1)]
    n, bounds = docs.agg(F.count(F.lit(1)), F.percentile_approx(id_col, at, 10_000)).first()
    bounds = sorted(set(bounds or [0]))
    parts = max(1, min(MAX_RANGES, n // RANGE_ROWS) // QUANTILES)
    known = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    key = F.coalesce(F.col(id_col), F.lit(bounds[0])).cast("bigint")
    i = F.greatest(F.size(F.filter(known, lambda b: b <= key)), F.lit(1))
    low, high = F.get(known, i - 1), F.coalesce(F.get(known, i), F.lit(bounds[-1] + 1).cast("bigint"))
    share = (key - low).cast("double") / F.greatest(high - low, F.lit(1))
    return (i * parts + F.least(F.floor(share * parts), F.lit(parts - 1))).cast("bigint")


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """fingerprint() with ``next_text, next_sketch`` of the next document by descending id; the
    first one comes after the last.

    The texts are shuffled once, by range of id. The first row of each range also goes, as a
    guest, to the end of the range before it in that order.
    """
    place = id_ranges(docs, id_col)
    own = fingerprint(docs, id_col=id_col, text_col=text_col, size=size).withColumn("_range", place)
    tops = docs.select(F.col(id_col), place.alias("_range")).groupBy("_range").agg(F.max(id_col).alias("_top"))
    along = Window.orderBy("_range")
    everywhere = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = tops.select("_top", F.coalesce(F.lead("_range").over(along), F.min("_range").over(everywhere)).alias("_host"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    guests = docs.select(F.col(id_col), text.alias("text")).join(F.broadcast(hosts), F.col(id_col).eqNullSafe(F.col("_top")))
    guests = guests.groupBy(F.col("_host").alias("_range")).agg(F.first("_top").alias(id_col), F.min("text").alias("text"))
    guests = _sketched(guests, size)
    rows = own.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_guest", F.desc_nulls_last(id_col), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where("_guest = 0").drop("_guest", "_range")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many first characters of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))
