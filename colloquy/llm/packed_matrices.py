"""Operator 10, token-id output: packed id matrices with segment lengths and position resets.

Each task packs the documents of its own input partition, a block of a bounded number of tokens
at a time, by best-fit decreasing: a segment tree over capacities finds the row with the least
room that still holds a piece. Overlong documents are split into consecutive pieces, nothing is
dropped, and every piece says where in its document it begins. Nothing is shuffled, and a task
that is run again packs the same block again.

Defined cases: a null or empty text is the end id alone; a text of more than a row's tokens
becomes several pieces, the remainder first; repeated rows are packed each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import cut
from .token_ids import as_bytes, token_ids

#: Tokens that a task gathers before it packs them: about 8 MB of ids.
BLOCK_TOKENS = 1 << 21
ROW = "input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, starts array<bigint>, n_tokens int"


class CapacityTree:
    """How many rows have each capacity, and the least capacity with a row that holds a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return the capacity and the row of the best fit, if any."""
        i = length + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The numbers of the pieces in each row."""
    rows: list[list[int]] = []
    tree = CapacityTree(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        left, row = tree.take(lengths[k]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(k)
        if left > lengths[k]:
            tree.put(left - lengths[k], row)
    return rows


def pack_block(documents: list[tuple[int, bytes]], capacity: int, pad_id: int) -> pd.DataFrame:
    """The rows of one block; ids are little-endian unsigned 32-bit, padded to the capacity."""
    parts = [(key, start, ids[4 * start : 4 * (start + n)]) for key, ids in documents for start, n in cut(len(ids) // 4, capacity)]
    out = []
    for row in best_fit_decreasing([len(p[2]) // 4 for p in parts], capacity):
        ids = b"".join(parts[k][2] for k in row)
        lengths = [len(parts[k][2]) // 4 for k in row]
        padded = ids + as_bytes([pad_id] * (capacity - len(ids) // 4))
        positions = np.concatenate([np.arange(n, dtype="<u4") for n in [*lengths, capacity - len(ids) // 4]])
        out.append((padded, [0, *np.cumsum(lengths).tolist()], positions.tobytes(), [parts[k][0] for k in row], [parts[k][1] for k in row], len(ids) // 4))
    return pd.DataFrame(out, columns=["input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts", "n_tokens"])


def matrices(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, block_tokens: int = BLOCK_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """A row of the packed matrix each: ``input_ids`` and ``position_ids`` (``capacity`` ids as
    binary), ``cu_seqlens``, and the ``doc_ids`` and ``starts`` of its segments."""
    end = as_bytes([end_id])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, held, size = token_ids(vocabulary).encode, [], 0
        for batch in batches:
            for key, text in zip(batch["_id"], batch["_text"]):
                held.append((key, encode(text) + end))
                size += len(held[-1][1]) // 4
                if size >= block_tokens:
                    yield pack_block(held, capacity, pad_id)
                    held, size = [], 0
        if held:
            yield pack_block(held, capacity, pad_id)

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(pack, ROW)


def unpacked(rows: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every segment: what was packed, without padding."""
    each = rows.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("k", "s"))
    low, high = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.substring("input_ids", 4 * low + 1, 4 * (high - low)).alias("ids"))


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet part files under ``path``, which all readers share."""
    rows.write.mode("errorifexists").parquet(path)
