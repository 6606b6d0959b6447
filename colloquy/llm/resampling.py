"""Operator 12, target-distribution importance resampling.

Texts are bags of hashed word n-grams. A table of gains, one for each bucket, says how much
likelier a feature is in the target than in the corpus; it is an array of fixed size, and a text's
weight is the sum of its features' gains. With Gumbel noise from the id, the highest scores are a
sample without replacement in proportion to the weights.

The k-th key is found by distributed radix selection: the composite key is (score from the highest,
id, number of features), and each pass counts the rows by the next 12 bits of it, as a grouped count
of at most 4,096 rows. Only rows up to that key are sorted, by ranges, and ranked by the ranges'
offsets, so neither all rows nor one task hold the draw.

Defined cases: a null text has no features, weight 0, and isn't eligible; a row without an id has no
noise, so its score and rank are null and it doesn't count among the eligible; repeated rows are
drawn one by one, and of rows with equal score and id that with fewer features first; an empty
target leaves gains that favour rare features; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bits of a pass of the selection: a pass collects 2 ** BITS counts at most.
BITS = 12
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets_of(text: bytes | None, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text, and the buckets of its runs of 1 to ``most`` consecutive words."""
    words = WORD.findall(text.lower()) if text else []
    found = [crc32(w) for w in words]
    for n in range(2, most + 1):
        found += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64) % buckets


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.large_binary()))


def histogram(texts: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: each task gives a row for a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                total += np.bincount(buckets_of(text, most, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    rows = texts.select(F.col(text_col).alias("t")).mapInArrow(count, "bucket bigint, n bigint")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, most: int) -> DataFrame:
    """``id, n_words, n_features, weight`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # an array of fixed size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                n, found = buckets_of(text, most, len(shared.value))
                rows.append((n, len(found), int(shared.value[found].sum())))
            columns = [np.array(x, np.int64) for x in zip(*rows)] if rows else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(weigh, "id bigint, n_words bigint, n_features bigint, weight bigint")


def with_score(rows: DataFrame, seed: int) -> DataFrame:
    """``score``: the weight plus a thousandth-step Gumbel number of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def _signed(u: int) -> int:
    """The long whose bits, the highest one flipped, are ``u``."""
    return u - (1 << 63)


def last_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...]:
    """The shortest tuple of values of the long columns ``keys`` up to which, in ascending order, the
    first ``k`` rows are. It holds more than ``k`` only where all keys are equal, and all rows if there are
    no more than ``k``: then it is empty."""
    rows = rows.select(*keys)
    if rows.count() <= k:
        return ()
    bound: tuple[int, ...] = ()
    for key in keys:
        low, high = (x + (1 << 63) for x in rows.agg(F.min(key), F.max(key)).first())
        left = (low ^ high).bit_length()
        known = high >> left  # the bits that all rows share
        while left:
            step = min(BITS, left)
            left -= step
            unsigned = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
            digit = F.shiftrightunsigned(unsigned, left).bitwiseAND(F.lit((1 << step) - 1))
            first, last = _signed(known << left + step), _signed(((known + 1) << left + step) - 1)
            counts = dict(rows.where(F.col(key).between(first, last)).groupBy(digit.alias("d")).count().collect())
            for d in sorted(counts):
                if counts[d] >= k:
                    break
                k -= counts[d]
            known = known << step | d
            held = counts[d]
        value = _signed(known)
        bound += (value,)
        rows = rows.where(F.col(key) == value)
        if low != high and held == k:
            return bound
    return bound


def up_to(keys: list[str], bound: tuple[int, ...]):
    """Whether the keys are at or before the bound, in the order of tuples."""
    if not bound:
        return F.lit(True)
    own, key = F.col(keys[0]), F.lit(bound[0])
    return (own <= key) if len(bound) == 1 else (own < key) | (own == key) & up_to(keys[1:], bound[1:])


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... in the order of the keys.

    Equal rows of a task are counted before they are sorted by ranges, and the task is part of the
    order: neither a range nor a row holds more of them than a task had.
    """
    columns = rows.columns
    counted = rows.withColumn("_task", F.spark_partition_id()).groupBy(*columns, "_task").agg(F.count(F.lit(1)).alias("_many"))
    counted = counted.repartitionByRange(*keys, "_task").sortWithinPartitions(*keys, "_task")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            many = batch.column(batch.num_columns - 1).to_numpy()
            ends = np.cumsum(many) + done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(many), part, np.int32)), pa.array(ends)], names=[*batch.schema.names, "_part", "_end"])
            done = int(ends[-1]) if len(ends) else done

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    placed = written(counted.mapInArrow(place, f"{schema}, _part int, _end bigint"))
    ends = placed.groupBy("_part").agg(F.max("_end").alias("_n"))  # a row for each range
    before = ends.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(before.select("_part", "_before"), "_part")
    last = F.col("_before") + F.col("_end")
    return placed.select(*columns, F.explode(F.sequence(last - F.col("_many") + 1, last)).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row of ``docs``; rank is null where the row
    isn't among the ``percent`` of those with ``least_words`` words that are drawn."""
    gain = gains(histogram(docs, text_col, most, buckets), histogram(target, text_col, most, buckets))
    rows = written(with_score(weighed(docs, gain, id_col, text_col, most), seed))
    rows = rows.withColumn("_from_top", -F.col("score"))
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    k = rows.where(eligible).count() * percent // 100
    keys = ["_from_top", "id", "n_features"]
    out = ["id", "n_features", "weight", "score"]
    if k:
        drawn = eligible & up_to(keys, last_key(rows.where(eligible), keys, k))
        first = ranked(rows.where(drawn).select(*out, "_from_top"), keys)
        rows = first.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank")).union(rows.where(~F.coalesce(drawn, F.lit(False))).select(*out, F.lit(None).cast("bigint")))
    else:
        rows = rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    return rows.withColumnRenamed("id", id_col)
