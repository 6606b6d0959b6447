"""Operator 9, substring dedup, by compact windows.

A text is its sequence of word shingles. Under one hash function all subsequences of at least t
shingles that share a minimum form compact windows (l, c, r): the subsequences that begin in
[l, c] and end in [c, r] have the minimum of c. These are the nodes of the Cartesian tree over
the hashes whose subtree is t wide or more, about 2 n / t of them. Near-duplicate passages share
minima under most functions. Windows are joined on their minimum with the first window that has
it, and meet where the shingles on one side of the minimum agree too; where they don't, windows of
a minimum are joined with the first of those that do. All places and distances at which windows of
any function met are put together for each pair of texts, the pair is verified on the shingles
themselves, and passages are as wide as they are alike.

Windows are compared with first ones only, however many share a minimum. A window is left open if
its interval isn't inside the passages found (an interval join), and others share half a passage
on one side of its minimum. Open windows are joined once more by all their sequences of t
shingles, so exact repeats are found with certainty, whatever else is in the table, and by all their
runs of RUN shingles: so near repeats meet where the first text with their minimum is like neither.

Equal texts are one: a text that occurs before is a passage as a whole.

Defined cases: a null text, or a row without an id, has no passages, nor do texts of fewer than
``min_words`` words; a passage may repeat inside one text; equal rows of one id count once; rows of
one id with different texts are texts of their own (``text_hash`` tells them apart); of equal
passages that of the smallest id (then place) is the source, further texts of an id last; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, written
from .word_hashes import chunks, mix, words

#: Hash functions.
FUNCTIONS = 4
#: Shingles beside a minimum that must agree on one side for windows to meet.
SIDE = 8
#: Shingles in a row by which open windows are joined too, besides whole sequences.
RUN = 20
#: From so many anchors at one distance on, places that match around them are counted by running sums.
DENSE = 8
#: Block minima are kept up to 2 ** LEVELS shingles; longer reaches take several steps.
LEVELS = 10
#: Columns of windows().
WINDOW = ["key", "id", "c", "before", "after", "left", "right", "lead"]
#: Bits of a window's lead.
LEADS, LEADS_LEFT, LEADS_RIGHT = 1, 2, 4


def block_minima(h: np.ndarray, most: int = LEVELS) -> list[np.ndarray]:
    """Minima of all blocks of 1, 2, 4, ... elements, by where they begin."""
    levels = [h]
    for j in range(most):
        if len(levels[-1]) <= 1 << j:
            break
        levels.append(np.minimum(levels[-1][: -(1 << j)], levels[-1][1 << j :]))
    return levels


def _sliding(levels_op, x: np.ndarray, width: int) -> np.ndarray:
    """``levels_op`` (minimum or maximum) over each ``width`` elements, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = levels_op(x[:-done], x[done:]), 2 * done
    rest = width - done
    return levels_op(x[:-rest], x[rest:]) if rest else x


def compact_windows(h: np.ndarray, width: int, far: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive) of the compact windows at least ``width`` wide over positive hashes.

    Zeros part sequences and must be at both ends. Of equal minima the leftmost counts. far: l and
    r matter only up to that distance from c, and may be any beyond it where they are farther.
    """
    none = np.empty(0, dtype=np.int64)
    if len(h) < width:
        return none, none, none
    least = _sliding(np.minimum, h, width)
    around = np.concatenate([np.zeros(width - 1, h.dtype), least, np.zeros(width - 1, h.dtype)])
    c = np.flatnonzero((_sliding(np.maximum, around, width) == h) & (h > 0))
    levels, v = block_minima(h, LEVELS if far is None else far.bit_length() - 1), h[c]

    def reach(start: np.ndarray, step: int) -> np.ndarray:
        at, top, moved = start.copy(), len(levels) - 1, True
        while moved:
            moved = False
            for j in range(top, -1, -1):
                first = at if step > 0 else at - (1 << j) + 1
                inside = (first >= 0) & (first < len(levels[j]))
                low = levels[j][np.where(inside, first, 0)]
                go = inside & ((low >= v) if step > 0 else (low > v))
                at[go] += step * (1 << j)
                moved |= far is None and j == top and bool(go.any())
        return at

    r, left = reach(c + 1, 1) - 1, reach(c - 1, -1) + 1
    wide = r - left + 1 >= width
    return left[wide], c[wide], r[wide]


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y)


def doubled(h: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of all blocks of 1, 2, 4, ... elements, up to ``length`` of them, by where they begin."""
    blocks, size = [h], 1
    while 2 * size <= min(length, len(h)):
        blocks.append(_join(blocks[-1][:-size], blocks[-1][size:]))
        size *= 2
    return blocks


def hashes_at(blocks: list[np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the blocks of ``length`` elements that begin at ``start``, from those of doubled()."""
    total, at = None, start
    for j, block in enumerate(blocks):
        if length >> j & 1:
            total = block[at] if total is None else _join(total, block[at])
            at = at + (1 << j)
    return total


def block_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all blocks of ``length`` elements, by where they begin."""
    return hashes_at(doubled(h, length), np.arange(max(0, len(h) - length + 1)), length)


def repeated(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the rows that equal an earlier one in all columns."""
    order = np.lexsort(columns)
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in columns:
        x = x[order]
        same &= x[1:] == x[:-1]
    return order[1:][same]


def leads(text: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of each row: whether its text has no earlier row of its key, of its key and left, of its
    key and right."""
    lead = np.full(len(key), LEADS | LEADS_LEFT | LEADS_RIGHT, np.int8)
    again = repeated(text, key)
    if len(again):
        lead[again] &= ~LEADS
        some = np.flatnonzero(np.isin(key, key[again]))
        for bit, side in ((LEADS_LEFT, left), (LEADS_RIGHT, right)):
            lead[some[repeated(text[some], side[some], key[some])]] &= ~bit
    return lead


def windows(texts: DataFrame, width: int, min_tokens: int) -> DataFrame:
    """Of ``id, text``: ``key, id, c, before, after, left, right, lead`` of every compact window: hash and
    place of its minimum, how far sequences of ``min_tokens`` shingles with that minimum reach on both
    sides of it, hashes of SIDE shingles on both sides (0 where the text ends before), and leads()."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, some in chunks(batch.column(1).cast(pa.large_binary()).to_pylist()):
                h, first = words([t.lower() for t in some]).shingles(width)
                n = np.diff(first)
                own = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) + own + 1  # a zero before each text, and one at the end
                hashes = block_hashes(h, SIDE + 1) if len(h) > SIDE else h[:0]
                for f in range(FUNCTIONS):
                    padded = np.zeros(len(h) + len(n) + 1, dtype=np.uint64)
                    padded[place] = np.maximum(mix(h ^ np.uint64(0x5851F42D4C957F2D * (f + 1) % (1 << 64))), np.uint64(1))
                    left, c, right = compact_windows(padded, min_tokens, min_tokens - 1)
                    text = np.searchsorted(first[:-1] + np.arange(len(n)), c, "right") - 1
                    key, within, whole = padded[c], c - first[text] - text - 1, c - text - 1
                    reach = [np.minimum(x, min_tokens - 1).astype(np.int8) for x in (c - left, right - c)]
                    beside = []
                    for start, there in ((whole - SIDE, within >= SIDE), (whole, within + SIDE < n[text])):
                        found = np.zeros(len(c), np.int32)
                        found[there] = hashes[start[there]].astype(np.uint32).view(np.int32) | 1
                        beside.append(found)
                    arrays = [key.astype(np.int64), ids[at + text].astype(np.int64), within.astype(np.int32), *reach, *beside, leads(text, key, *beside)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=WINDOW)

    schema = "key bigint, id bigint, c int, before tinyint, after tinyint, left int, right int, lead tinyint"
    return texts.select("id", "text").mapInArrow(find, schema)


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the elements before each place, and of all."""
    total = np.zeros(len(x) + 1, np.int64)
    x.cumsum(out=total[1:])
    return total


def farthest(same: np.ndarray, price: int, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """The last end of a stretch from each place with at least ``price`` matches for each place
    without one, and which places lie in such stretches of ``at_least`` places."""
    total = running(np.where(same, -1, price))
    later = np.minimum.accumulate(total[:0:-1])[::-1]  # the least that is reached from each end on
    ends = later.searchsorted(total[:-1], "right") - 1
    reach = np.where(ends - np.arange(len(same)) + 1 >= at_least, ends, -1)
    return ends, np.maximum.accumulate(reach) >= np.arange(len(same))


def widest(ends: np.ndarray, at: int) -> tuple[int, int]:
    """The widest stretch around ``at``, by ``farthest``."""
    before = ends[: at + 1]
    low = int(np.where(before >= at, before - np.arange(at + 1), -1).argmax())
    return low, int(ends[low])


def trimmed(same: np.ndarray, low: int, high: int, at_least: int) -> tuple[int, int]:
    """The stretch without the places at its ends that don't match, as far as its length allows."""
    inside = same[low : high + 1]
    first, last = low + int(inside.argmax()), high - int(inside[::-1].argmax())
    low = min(first, high + 1 - at_least)
    return low, max(last, low + at_least - 1)


def exact_runs(same: np.ndarray, at_least: int) -> np.ndarray:
    """A place in each run of matches of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    return starts[ends - starts >= at_least]


def bordered(x: np.ndarray, most: int, border: int) -> np.ndarray:
    """For each place the elements up to ``most`` places around it; ``border``, which is no element, beyond the ends."""
    beyond = np.full(most, border, np.int64)
    row = np.concatenate([beyond, x.astype(np.int64), beyond])
    return np.ndarray((len(x), 2 * most + 1), np.int64, row, strides=row.strides * 2)


@lru_cache(16)
def costs(similarity: float) -> tuple[Fraction, int, int]:
    """The similarity, and what a place without a match costs: aligned, it counts in both sets."""
    share = Fraction(str(similarity))
    return share, math.ceil(2 * share / (1 - share)), math.ceil(share / (1 - share))


def similar_sets(x: np.ndarray, y: np.ndarray, share: Fraction) -> bool:
    """Whether the sets of the elements, some on both sides, have that Jaccard similarity or more."""
    distinct = lambda z: 1 + int(np.count_nonzero(z[1:] != z[:-1]))
    x, y = np.sort(x), np.sort(y)
    either = distinct(np.sort(np.concatenate([x, y])))
    return (distinct(x) + distinct(y) - either) * share.denominator >= share.numerator * either


def passages(a: np.ndarray, b: np.ndarray, anchors: np.ndarray | list[tuple[int, int]], min_tokens: int, similarity: float, same_text: bool, covered: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Verified near-duplicate stretches: first and last place in a, first and last in b.

    anchors: distances of places, and places in a where windows met at them. A passage is the
    widest stretch around an anchor whose sets of shingles have the Jaccard similarity. covered:
    places of a that are in passages already; passages must bring others, and are added.
    """
    share, shift_cost, gap_cost = costs(similarity)
    found: list[tuple[int, int, int, int]] = []
    covered = np.zeros(len(a), bool) if covered is None else covered
    shift, place = np.asarray(anchors, np.int64).reshape(-1, 2).T
    order = np.lexsort((place, shift))
    shift, place = shift[order], place[order]
    edges = np.flatnonzero(np.concatenate([[True], shift[1:] != shift[:-1], [True]]))
    # Distances bring nothing where all around their places is covered.
    bare = np.concatenate([[0], np.cumsum(~covered)])
    bare = bare[np.minimum(place[edges[1:] - 1] + min_tokens, len(a))] > bare[np.maximum(place[edges[:-1]] - min_tokens + 1, 0)]
    if not bare.any():
        return found
    sizes = np.diff(edges)
    keep = np.repeat(bare, sizes)
    shift, place, edges = shift[keep], place[keep], np.concatenate([[0], np.cumsum(sizes[bare])])

    def alike(same: np.ndarray, base: int, places: list[int], cost: int, there) -> None:
        """Passages around the places that bring matches not covered yet."""
        fresh = same & ~covered[base : base + len(same)]
        if not fresh.any():
            return
        reached = [farthest(same, cost, min_tokens)]
        done: list[tuple[int, int]] = []
        failed = set()
        for at in places:
            at -= base
            if not (0 <= at < len(same) and same[at] and reached[0][1][at]) or any(s <= at <= e for s, e in done):
                continue
            for step, price in enumerate((cost, 2 * cost, 4 * cost, len(a) + 1)):  # dearer where shingles repeat
                if step == len(reached):
                    reached.append(farthest(same, price, min_tokens))
                s, e = widest(reached[step][0], at)
                if e - s + 1 < min_tokens:
                    break
                s, e = trimmed(same, s, e, min_tokens)
                if (s, e) in failed:
                    continue
                if not fresh[s : e + 1].any():
                    break
                s2, e2 = there(base + s, base + e)
                if similar_sets(a[base + s : base + e + 1], b[s2 : e2 + 1], share):
                    found.append((base + s, base + e, s2, e2))
                    done.append((s, e))
                    covered[base + s : base + e + 1] = True
                    fresh[s : e + 1] = False
                    break
                failed.add((s, e))

    # How many of the aligned places around each anchor match.
    matches = np.empty(len(place), np.int64)
    few = np.repeat(np.diff(edges) < DENSE, np.diff(edges))
    if few.any():
        here, there = bordered(a, min_tokens - 1, 1 << 40), bordered(b, min_tokens - 1, 1 << 41)
        matches[few] = (here[place[few]] == there[(place - shift)[few]]).sum(1)

    def aligned(at: int) -> tuple[int, np.ndarray]:
        low, high = max(0, at), min(len(a), len(b) + at)
        return low, a[low:high] == b[low - at : high - at]

    def around_each(same: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = running(same)
        return total[np.minimum(places + min_tokens, len(same))] - total[np.maximum(places - min_tokens + 1, 0)]

    edges = edges.tolist()
    for first, last in pairwise(edges):
        if last - first >= DENSE:
            low, same = aligned(int(shift[first]))
            matches[first:last] = around_each(same, place[first:last] - low)
    strong = matches >= math.ceil(2 * min_tokens * share / (1 + share))
    most = np.add.reduceat(strong, edges[:-1], dtype=np.int64).tolist()
    by_shift = [edges[k : k + 2] for k in sorted(range(len(most)), key=lambda k: (-most[k], edges[k]))]
    for first, last in by_shift:
        places = place[first:last][strong[first:last]]
        if not len(places):
            break
        if covered[max(0, int(places[0]) - min_tokens + 1) : int(places[-1]) + min_tokens].all():
            continue
        at = int(shift[first])
        low, same = aligned(at)
        if not around_each(same & ~covered[low : low + len(same)], places - low).any():
            continue
        alike(same, low, [*(exact_runs(same, min_tokens) + low).tolist(), *places.tolist()], shift_cost, lambda s, e, at=at: (s - at, e - at))
    if same_text:
        return found
    if covered[place].all():
        return found
    width = len(b) + 1
    values, rank = np.unique(b, return_inverse=True)
    rank_a = np.minimum(np.searchsorted(values, a), len(values) - 1)
    members = values[rank_a] == a
    possible = farthest(members, gap_cost, min_tokens)[1]
    at_b = None
    for first, last in by_shift:  # words put in or left out: places at several distances
        places = [i for i in place[first:last].tolist() if possible[i] and not covered[i]]
        if not places:
            continue
        if at_b is None:
            at_b = np.sort(rank * width + np.arange(len(b)))
        at = int(shift[first])
        # Of equal shingles in b the one nearest to the distance.
        wanted = np.arange(len(a)) - at
        k = np.searchsorted(at_b, rank_a * width + np.clip(wanted, 0, len(b) - 1))
        before, after = at_b[np.maximum(k - 1, 0)], at_b[np.minimum(k, len(b) - 1)]
        far = lambda x: np.where(x // width == rank_a, np.abs(x % width - wanted), 1 << 40)  # noqa: B023, E731
        hit = np.where(far(before) <= far(after), before, after) % width
        drift = np.abs(hit - wanted)
        for reach in (min_tokens // 2, len(a) + len(b)):
            near = members & (drift <= reach)
            total = np.concatenate([[0], np.cumsum(near)])
            here = np.array([i for i in places if not covered[i]], np.int64)
            here = here[total[np.minimum(here + min_tokens, len(a))] - total[np.maximum(here - min_tokens + 1, 0)] >= math.ceil(min_tokens * share)]
            if not len(here):
                continue

            def places_in_b(s: int, e: int) -> tuple[int, int]:
                there = hit[s : e + 1][near[s : e + 1]]  # noqa: B023
                return int(there.min()), int(there.max())

            alike(near, 0, here.tolist(), gap_cost, places_in_b)
    return found


def sequences(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``id, h`` of the texts in pairs: their shingles in order, as 32 bits of their hashes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column(1).cast(pa.large_binary()).to_pylist()):
                h, first = words([t.lower() for t in some]).shingles(width)
                h = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), lists], names=["id", "h"])

    ids = pairs.select("id").union(pairs.select(F.col("source_id").alias("id"))).distinct()
    return texts.select("id", "text").join(ids, "id", "left_semi").mapInArrow(listed, "id bigint, h array<int>")


_FOUND = ["id", "first", "last", "source_id", "source_first", "source_last"]


def verified(pairs: DataFrame, lists: DataFrame, min_tokens: int, similarity: float) -> DataFrame:
    """``id, first, last, source_id, source_first, source_last`` (places of shingles) of the
    verified passages of pairs ``id, source_id, anchors``; ``lists`` are their sequences().

    A text's sources come in the order of their meeting places, most first; what one has
    explained another needn't. For that all pairs of a text are in one task, in this order: they are
    dealt by ``repartition``, which Spark neither splits nor reads locally, and either joined there
    with the text's one row of ``lists`` or, where Spark broadcasts them, in the task of that row.
    A text has no more sources than windows."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, covered = None, None
        for batch in batches:
            out = []
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (key, source) in enumerate(zip(ids, sources)):
                anchors, a, b = (batch.column(k)[row].values.to_numpy() for k in (2, 3, 4))
                if key != text:
                    text, covered = key, np.zeros(len(a), bool)
                places = np.stack([anchors >> 32, anchors & 0xFFFFFFFF], axis=1)
                out += [(key, s, e, source, s2, e2) for s, e, s2, e2 in passages(a, b, places, min_tokens, similarity, key == source, covered)]
            columns = zip(*out) if out else [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()) * 2)], names=_FOUND)

    both = pairs.join(lists.withColumnsRenamed({"id": "source_id", "h": "y"}), "source_id").repartition("id")
    both = both.join(lists.withColumnRenamed("h", "x"), "id").select("id", "source_id", "anchors", "x", "y")
    both = both.sortWithinPartitions("id", F.size("anchors").desc(), "source_id")
    return both.mapInArrow(verify, "id bigint, first int, last int, source_id bigint, source_first int, source_last int")


def leading(bit: int) -> Column:
    """Whether a window's lead has the bit."""
    return F.col("lead").bitwiseAND(F.lit(bit).cast("tinyint")) != 0


def with_first(rows: DataFrame, *more: str, lead: Column, wanted: str | None = None) -> DataFrame:
    """``rows`` (those that are ``wanted``) of keys that occur twice or more, with how often (many), and the
    id of the first (source_id), its place (s) and ``more`` of it (first_...).

    First is by id, then by place: lead is true for the first row of each key and id. Keys are
    aggregated, which combines before the shuffle, and written before the join: so the join reads plain
    rows on both sides, and Spark splits a frequent key. The side with a row for each key is hashed,
    which spares sorting the other.
    """
    of_first = [F.min_by(x, F.when(lead, F.col("id"))).alias(name) for x, name in (("c", "s"), *((x, f"first_{x}") for x in more))]
    keys = rows.groupBy("key").agg(F.min("id").alias("source_id"), F.count(F.lit(1)).alias("many"), *of_first, *([F.max(wanted).alias("_wanted")] if wanted else []))
    keys = written(keys.where("many > 1 AND _wanted").drop("_wanted") if wanted else keys.where("many > 1"))
    joined = written((rows.where(wanted) if wanted else rows).join(keys.hint("shuffle_hash"), "key"))
    discard(keys)
    return joined


def beside(rows: DataFrame, left: str, right: str) -> DataFrame:
    """The rows twice, their key made narrower by what is on the left, and on the right, of them; lead
    becomes that of the new key."""
    sides = [F.when(F.col(x) != 0, F.struct(F.xxhash64("key", F.lit(k), x).alias("key"), leading(bit).alias("lead"))) for k, x, bit in ((1, left, LEADS_LEFT), (2, right, LEADS_RIGHT))]
    rest = [x for x in rows.columns if x not in ("key", "lead")]
    return rows.select(*rest, F.explode(F.array(*sides)).alias("_side")).where("_side IS NOT NULL").select("_side.key", *rest, "_side.lead")


def anchored(met: DataFrame) -> DataFrame:
    """Pairs ``id, source_id, anchors``: distance * 2 ** 32 + place of all windows of two texts that
    met; a text has about 2 n / t windows for each function, which bounds the set of a pair."""
    place = F.shiftleft((F.col("c") - F.col("s")).cast("bigint"), 32) + F.col("c")
    return met.where("id <> source_id OR c <> s").groupBy("id", "source_id").agg(F.collect_set(place).alias("anchors"))


def unexplained(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of windows with a place that lies in none of the passages found in their text."""
    inside = spans(found).withColumnRenamed("id", "_id")
    return rows.join(inside, (F.col("id") == F.col("_id")) & (F.col("first") <= F.col("c") - F.col("before")) & (F.col("last") >= F.col("c") + F.col("after")), "left_anti")


def open_places(met: DataFrame, found: DataFrame) -> DataFrame:
    """``id, places``: the windows that may repeat a sequence nobody compared, and their partners.

    Of a sequence with the minimum at c, one half or more lies on one side of c, and of a run with c
    SIDE shingles or more. Where only two windows have a minimum, they have been compared.
    """
    rows = met.where("many > 2").select(WINDOW)
    left = written(unexplained(rows, found))
    partners = rows.join(left.select("key").distinct(), "key", "left_semi")
    halves = written(beside(partners, "left", "right").select("key", "id", "c", "before", "after"))
    keys = beside(left, "left", "right").select("key").distinct()
    twice = halves.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").join(keys, "key", "left_semi").select("key")
    both = halves.join(twice, "key", "left_semi").repartition("id").groupBy("id", "c").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    place = (F.col("c").cast("bigint") * 64 + F.col("before")) * 64 + F.col("after")
    places = written(both.groupBy("id").agg(F.collect_list(place).alias("places")))
    discard(left)
    discard(halves)
    return places


def whole_sequences(places: DataFrame, texts: DataFrame, found: DataFrame, width: int, min_tokens: int) -> DataFrame:
    """``key, id, c, lead, open`` of all sequences of ``min_tokens`` shingles that have one of the places
    in their middle, and of the runs of RUN in them: hash, where they begin, whether their text has the
    same no earlier, and whether they lie in none of the passages found in it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, some in chunks(batch.column(3).cast(pa.large_binary()).to_pylist()):
                h, first = words([t.lower() for t in some]).shingles(width)
                inside = batch.column(2).slice(at, len(some))
                ends = inside.flatten().to_numpy()
                ends = np.repeat(first[:-1], pc.fill_null(inside.value_lengths(), 0).to_numpy()) + np.stack([ends >> 32, ends & 0xFFFFFFFF])
                ends = ends[:, ends[0].argsort()]  # of passages that don't meet
                lists = batch.column(1).slice(at, len(some))
                packed = lists.flatten().to_numpy()
                begin = np.repeat(first[:-1], lists.value_lengths().to_numpy()) + (packed >> 12) - (packed >> 6 & 63)
                reach = (packed >> 6 & 63) + (packed & 63) + 1
                begin, reach = begin[reach >= min_tokens], reach[reach >= min_tokens]
                blocks = doubled(h, min_tokens)
                for length in {min_tokens, min(RUN, min_tokens)}:
                    edges = np.bincount(begin, minlength=len(h) + 1) - np.bincount(begin + reach - length + 1, minlength=len(h) + 1)
                    start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                    if not len(start):
                        continue
                    text = np.searchsorted(first, start, "right") - 1
                    key, lead, bare = hashes_at(blocks, start, length).astype(np.int64), np.ones(len(start), bool), np.ones(len(start), bool)
                    lead[repeated(text, key)] = False
                    if ends.size:
                        k = np.searchsorted(ends[0], start, "right") - 1
                        bare = (k < 0) | (ends[1][k] < start + length - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids[at + text], (start - first[text]).astype(np.int32), lead, bare)], names=["key", "id", "c", "lead", "open"])

    inside = spans(found).groupBy("id").agg(F.collect_list(F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("last")).alias("inside"))
    rows = places.join(inside, "id", "left").join(texts, "id").select("id", "places", "inside", "text")
    return rows.mapInArrow(part, "key bigint, id bigint, c int, lead boolean, open boolean")


def different_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, text`` of different texts; ``id, source_id`` of the others, which equal an earlier one;
    ``node, id, text_hash`` of the texts whose id has another text: the first is the id here."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    names = written(rows.select("id", "h", F.xxhash64(F.lit(7), "text").alias("g"), F.length("text").alias("n")).groupBy("id", "h", "g", "n").agg(F.count(F.lit(1)).alias("rows")))
    several = written(names.groupBy("id").agg(F.min("h").alias("_least"), F.max("h").alias("_most"), F.sum("rows").alias("_rows")).where("_rows > 1").select("id", "_least", (F.col("_least") != F.col("_most")).alias("_differ")))
    # Numbers of further texts of an id come after all usual ids, so they aren't sources of those.
    further = F.xxhash64("id", "h").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col("_differ") & (F.col("h") != F.col("_least")), further).otherwise(F.col("id"))
    if several.limit(1).count():
        rows = rows.join(several, "id", "left").select(node.alias("id"), "text", F.col("_least").isNotNull().alias("_again"))
        rows = rows.where("NOT _again").select("id", "text").union(rows.where("_again").select("id", "text").dropDuplicates(["id"]))
        numbered = names.join(several, "id", "left").withColumn("node", node)
        renamed = written(numbered.where("_differ").select("node", "id", F.col("h").alias("text_hash")))
    else:
        rows, numbered, renamed = rows.select("id", "text"), names.withColumn("node", F.col("id")), None
    classes = numbered.groupBy("h", "g", "n").agg(F.min("node").alias("source_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = written(numbered.join(classes, ["h", "g", "n"]).where("node <> source_id").select(F.col("node").alias("id"), "source_id"))
    discard(names)
    return rows, copies, renamed


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """``id, first, last, source_id, source_first, source_last, text_hash``: verified passages as
    places of words, ``last`` exclusive, each with an earlier passage that it repeats. text_hash:
    where the id has several texts, Spark's xxhash64 of this one."""
    min_tokens = min_words - width + 1
    every, copies, renamed = different_texts(docs, id_col, text_col)
    texts = every.join(copies.select("id"), "id", "left_anti")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        lists = written(sequences(texts, pairs, width))
        done = written(verified(pairs, lists, min_tokens, similarity).distinct())
        discard(pairs)
        discard(lists)
        return done

    rows = written(windows(texts, width, min_tokens))
    met = with_first(rows, "left", "right", lead=leading(LEADS))
    discard(rows)
    same = (F.col("left") == F.col("first_left")) & (F.col("left") != 0) | (F.col("right") == F.col("first_right")) & (F.col("right") != 0)
    apart = met.where((F.col("many") > 2) & ~same).select("key").distinct()
    others = with_first(beside(met.join(apart, "key", "left_semi").select("key", "id", "c", "left", "right", "lead"), "left", "right").select("key", "id", "c", "lead"), lead=F.col("lead"))
    found = check(anchored(met.where(same).select("id", "c", "source_id", "s").union(others.select("id", "c", "source_id", "s"))))
    discard(others)
    places = open_places(met, found)
    discard(met)
    rows = written(whole_sequences(places, texts, found, width, min_tokens))
    discard(places)
    met = with_first(rows, lead=F.col("lead"), wanted="open")
    discard(rows)
    more = check(anchored(met))
    discard(met)
    end = lambda name: (F.col(name) + width).alias(name)
    found = found.union(more).distinct().select("id", "first", end("last"), "source_id", "source_first", end("source_last"))
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    n = F.when(F.col("source_id").isNotNull(), n)  # else Spark counts the words of every text before it joins
    again = every.join(copies, "id").select("id", n.alias("last"), "source_id").where(F.col("last") >= min_words)
    found = found.union(again.select("id", F.lit(0), "last", "source_id", F.lit(0), "last"))
    if renamed is None:
        return found.withColumn("text_hash", F.lit(None).cast("bigint"))
    own = renamed.select(F.col("node").alias("id"), F.col("id").alias("_id"), "text_hash")
    source = renamed.select(F.col("node").alias("source_id"), F.col("id").alias("_source_id"))
    found = found.join(own, "id", "left").join(source, "source_id", "left")
    return found.select(F.coalesce("_id", "id").alias("id"), "first", "last", F.coalesce("_source_id", "source_id").alias("source_id"), "source_first", "source_last", "text_hash")


def spans(found: DataFrame, *by: str) -> DataFrame:
    """``id, first, last`` (and ``by``): the union of the repeated stretches of each text."""
    text = Window.partitionBy("id", *by).orderBy("first", "last")
    rows = found.select("id", *by, "first", "last").distinct()
    rows = rows.withColumn("_reach", F.max("last").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.sum((F.col("first") > F.coalesce("_reach", F.lit(-1))).cast("int")).over(text))
    return rows.groupBy("id", *by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def without_repeats(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated stretches of repeats() cut out of the text column; sources keep theirs.

    White space after a cut stretch goes with it. A text without repeats is returned as it is. Of
    rows with one id, each loses what was found in its own text.
    """
    cuts = spans(found, "text_hash").groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_cut"))
    hashed = cuts.where("text_hash IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("text_hash", "_cut"))).alias("_others"))
    cuts = cuts.where("text_hash IS NULL").select("id", "_cut").join(hashed, "id", "full").withColumnRenamed("id", "_id")

    @F.pandas_udf("string")
    def keep(text: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([uncut if (c is None or uncut is None) else cut_words(uncut, [(p["first"], p["last"]) for p in c]) for uncut, c in zip(text, cut)], dtype=object)

    joined = docs.join(cuts, F.col(id_col) == F.col("_id"), "left")
    joined = joined.withColumn("_cuts", F.when(F.col("_others").isNull(), F.col("_cut")).otherwise(F.try_element_at("_others", F.xxhash64(text_col))))
    once = keep.asNondeterministic()  # a filter on the result must not run it again, in a second worker of the same task
    new = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(once(F.col(text_col), F.col("_cuts")))
    return joined.withColumn(text_col, new).select(*docs.columns)


def cut_words(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words numbered first to last (exclusive) of each cut."""
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, before = [], 0
    for first, last in cuts:
        out.append(text[before : at[min(first, len(at) - 1)]])
        before = at[min(last, len(at) - 1)]
    return ("".join(out) + text[before:]) if cuts else text
