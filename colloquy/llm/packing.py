"""Operator 6, best-fit packing of documents into sequences, in bulk-synchronous rounds.

Lengths are whole numbers of at most ``capacity``, so documents and gaps sort into at most that
many classes. Ranges of (length, rank) stand for documents and ranges of (gap, sequence) for
gaps; the distributed part counts the classes and ranks documents inside them. A round takes the
longest class not yet placed, sweeps to the successor of its length among the gaps (the smallest
gap that holds it), lets documents take those gaps in the order of their rank, which settles
every conflict, puts the gaps back by what is left, and repeats; a class without a gap opens
sequences. What the rounds read is the histogram of lengths: at most ``capacity`` rows however
large the corpus. Documents get their places by one join with the rounds' ranges.

Defined cases: a null or empty text is a document of the end id alone; a document over the
capacity is cut, its remainder first; documents of equal length rank by id and piece; repeated
rows are packed each for itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .token_ids import as_bytes, encoding

#: Rows of one length that are ranked in one task, and the tasks for each length at least.
RANKED_ROWS, RANKED_BUCKETS = 200_000, 64
#: Ranges of the rounds that are broadcast; more would be joined by a shuffle.
BROADCAST_RANGES = 200_000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole capacities, the remainder first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, ids`` (binary; without with_ids left out)."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    end = as_bytes([end_id])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with encoding(vocabulary) as encoder:
            for batch in batches:
                rows = []
                for key, text in zip(batch["_id"], batch["_text"]):
                    ids = encoder.encode(text) + end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + n)]
                        rows.append((key, k, start, n, zlib.crc32(part), *([part] if with_ids else [])))
                columns = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(encode, schema)


def rounds(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The ranges that best fit decreasing makes of counts by length.

    A range (length, low, high, sequence, per, offset): document number ``low + x`` of its
    length goes to ``sequence + x // per`` at ``offset + x % per * length``.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first sequence, how many
    gaps: list[int] = []  # those of `free`, sorted
    ranges, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not free[gap]:
                insort(gaps, gap)
            free[gap].append((first, n))

    for length in sorted(histogram, reverse=True):
        low, total = 0, histogram[length]
        while low < total:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, there = free[gap].pop()
                if not free[gap]:
                    gaps.pop(k)
            else:
                gap, first = capacity, opened
                there = -(-(total - low) // (capacity // length))
                opened += there
            per = gap // length
            taken = min(total - low, per * there)
            ranges.append((length, low, low + taken, first, per, capacity - gap))
            full, rest = divmod(taken, per)
            put(gap - per * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            used = full + bool(rest)
            put(gap, first + used, there - used)
            low += taken
    return ranges


def pack(items: DataFrame, *, order: list[str], capacity: int = 2048) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, packed by their column ``length``.

    order: columns that tell rows of one length apart. items is read twice, so it should be a
    written table; only its own columns are shuffled, once.
    """
    spark = items.sparkSession
    n = items.count()
    buckets = min(4096, max(RANKED_BUCKETS, n // RANKED_ROWS))
    rows = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    found = rounds(histogram, capacity)
    # By Arrow: tuples would be unpickled by Python workers of their own, which then stay.
    names = ["length", "_low", "_high", "_first", "_per", "_offset"]
    columns = zip(*found) if found else [[]] * len(names)
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
    plan = F.broadcast(plan) if len(found) <= BROADCAST_RANGES else plan
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = rows.withColumn("_in", F.row_number().over(inside).cast("bigint") - 1)
    # Merged, not broadcast: the counts grow with the buckets, and the ranks are dealt and sorted by these keys.
    ranked = ranked.join(counts.select("length", "_bucket", "_before").hint("merge"), ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    at = plan.withColumnRenamed("length", "_length")
    placed = ranked.join(at, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    x = F.col("_rank") - F.col("_low")
    return placed.select(
        *items.columns,
        (F.col("_first") + F.floor(x / F.col("_per"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + x % F.col("_per") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = True, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents (see pieces()) with ``sequence_id`` and ``offset``."""
    cut_up = written(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids, vocabulary=vocabulary))
    return pack(cut_up, order=[id_col, "piece", "start"], capacity=capacity)
