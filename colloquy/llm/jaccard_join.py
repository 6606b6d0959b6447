"""Operator 4, n-gram Jaccard join, by PartEnum signatures.

A document is the set of its distinct word shingles; two link when their Jaccard similarity
reaches ``num / den``. Sizes fall into bands; similar sets whose larger one is in a band differ in
at most k shingles. The hashed domain of shingles is partitioned in groups of three cells, and of
each group every two cells are a signature: their content, hashed. Of g groups, similar sets agree
on 2 g - k signatures or more, whatever their differences are.

A document whose signatures occur elsewhere fewer times than that links with nothing and goes.
Of the others, the rarest signatures are kept, as many as leave no link out (the most frequent
ones, one less than must agree, can't be all that a pair shares). Each signature's bucket is
compared with two of its members, the smallest and the one with the most frequent signatures.
Where a bucket still holds several components, a link that wasn't seen has a shingle in common
that the smallest member lacks: were all its common shingles in the smallest member, both ends
would link with that one. So the bucket is parted by the rarest of such shingles, and so on, until
none is open with more than SMALL members outside its largest component; those few are compared with
all of the bucket at once. Shingles of equal frequency, which come together where one passage varies, stand together in
the order of rarity and so part a bucket once. Before two sets are compared, bits that count their
shingles modulo 2 bound their difference from below. No link between components is lost, and no
larger bucket is paired with itself. Documents of equal sets are one candidate.

Defined cases: a null text, or one without words, has no set and links with nothing, so it is
its own component; fewer words than a shingle are one shingle; a repeated row gives a repeated
row; rows of one id with different texts are documents of their own that bear the same id; a row
without an id has the component of an equal set, or none; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import discard, written
from .word_hashes import chunks, mix, words

#: The largest size of a band is this many times its smallest.
BAND = 1.5
#: Sets with too few shingles for the cells of a band sign by other cells too, so many times.
SCHEMES = 4
#: Members of a bucket outside its largest component that are compared with the others at once.
SMALL = 16
#: Turns in which larger open buckets are parted. Each takes a member out of them; should some be left
#: (sets that hardly differ in what parts them), they are compared across components too.
TURNS = 6
#: Words of 64 bits that count shingles modulo 2.
PARITY = 4
#: Tables of signatures are dealt in so many parts, one after the other, by set and by signature: the
#: shuffle files of one part lie on disk at a time, beside what is read and written.
SET_PARTS, KEY_PARTS = 4, 2
_SUMMARY = -1


@dataclass(frozen=True)
class Band:
    """``low`` to ``high``: sizes; ``k``: differences of similar sets whose larger one is here."""

    number: int
    low: int
    high: int
    k: int
    groups: int


@lru_cache(100_000)
def band_of(size: int, num: int, den: int) -> Band:
    number, low = 0, 1
    while True:
        high = max(low, int(low * BAND))
        if size <= high:
            k = 2 * high * (den - num) // (den + num)
            return Band(number, low, high, k, _groups(k, max(1, low * num // den)))
        number, low = number + 1, high + 1


def _groups(k: int, least: int) -> int:
    """Groups of three cells, so that a set of ``least`` shingles rarely has as many signatures
    without a shingle as similar sets agree on, and some are left over that tell documents apart."""
    g = k // 2 + 1
    while g < 2 * k:
        empty = 3 * g * math.exp(-2 * least / (3 * g))
        if empty + math.sqrt(empty) + k / 20 <= 2 * g - k:
            break
        g += 1
    return g


def bands_in_reach(size: int, num: int, den: int) -> list[Band]:
    """The band of a size, and those above in which a similar set can lie."""
    found = [band_of(size, num, den)]
    while den * size >= num * (found[-1].high + 1):
        found.append(band_of(found[-1].high + 1, num, den))
    return [b for b in found if b.k]  # with no difference only equal sets are similar, which are one already


def _segments(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Of sets (sorted distinct hashes): number of the set, entry, need, signatures.

    An entry is a band and a scheme of cells. Two similar sets have an entry in common in which
    they share at least the need of either.
    """
    found = []
    todo = [(i, b, 0) for i, s in enumerate(sets) if len(s) for b in bands_in_reach(len(s), num, den)]
    while todo:
        later = []
        n = np.array([len(sets[i]) for i, _, _ in todo])
        groups = np.array([b.groups for _, b, _ in todo])
        entry = np.array([b.number * SCHEMES + scheme for _, b, scheme in todo], dtype=np.uint64)
        salt = mix(entry + np.uint64(0x243F6A8885A308D3))
        h = mix(np.concatenate([sets[i] for i, _, _ in todo]) ^ np.repeat(salt, n))
        first = _segments(3 * groups)
        cell = np.repeat(first[:-1], n) + (h % np.repeat(3 * groups, n).astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(first[-1], np.uint64), np.bincount(cell, minlength=first[-1])
        np.add.at(total, cell, mix(h))
        total, count = total.reshape(-1, 3), count.reshape(-1, 3)
        total, count = (total.sum(1, keepdims=True) - total).ravel(), (count.sum(1, keepdims=True) - count).ravel()
        place = np.arange(first[-1]) - np.repeat(first[:-1], 3 * groups)
        total = mix(mix(total + place.astype(np.uint64)) ^ np.repeat(salt, 3 * groups))
        for (i, band, scheme), a, b in zip(todo, first[:-1], first[1:]):
            told = count[a:b] > 0
            need = 2 * band.groups - band.k - int((~told).sum())
            signs = total[a:b][told]
            if need < 1 and scheme + 1 < SCHEMES:
                later.append((i, band, scheme + 1))
            elif need < 1:  # the sets of a band that no scheme parts have one signature in common
                signs = np.concatenate([signs, mix(np.array([band.number], np.uint64))])
            found.append((i, band.number * SCHEMES + scheme, max(need, 1), signs))
        todo = later
    return found


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased in A-Z."""
    h, first = words([t.lower() for t in texts]).shingles(width)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    flat, ends = np.concatenate([*sets, np.empty(0, np.uint64)]), _segments(np.array([len(s) for s in sets], np.int64))
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(c)), dtype=np.uint64)])[ends] for c in (1, 2)]
    return tuple((t[1:] - t[:-1]).astype(np.int64) for t in total)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def signed(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of ``id, text, text_hash``: a row for each entry of a text, and one of entry -1 for the text
    itself; n, h1, h2: the size of its set and a name for it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(_texts(batch.column(1))):
                sets = shingle_sets(some, width)
                h1, h2 = set_names(sets)
                rows = [(i, _SUMMARY, 0, np.empty(0, np.uint64)) for i in range(len(sets))] + signatures(sets, num, den)
                own = np.array([r[0] for r in rows])
                lists = pa.ListArray.from_arrays(pa.array(_segments(np.array([len(r[3]) for r in rows])), pa.int32()), pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)))
                n = np.array([len(s) for s in sets], np.int64)
                columns = [*(batch.column(k).take(pa.array(own + at)) for k in (0, 2)), *(pa.array(x[own]) for x in (n, h1, h2)), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n", "h1", "h2", "entry", "need", "sigs"])

    return texts.select("id", "text", "text_hash").mapInArrow(sign, "id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, entry int, need int, sigs array<bigint>")


def named_sets(summaries: DataFrame) -> DataFrame:
    """``n, h1, h2, rep, node`` of each different set: its smallest id, and a number of its own,
    which is that id unless another set of the same id has it."""
    sets = summaries.where("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    sets = sets.join(sets.groupBy("rep").agg(F.min("h1").alias("_first")), "rep")
    node = F.when(F.col("h1") == F.col("_first"), F.col("rep")).otherwise(F.xxhash64("rep", "n", "h1", "h2"))
    return sets.select("n", "h1", "h2", "rep", node.alias("node"))


def shared(rows: DataFrame, key: str) -> DataFrame:
    """``key, many``: the keys that occur twice or more, and how often. Rows that repeat a document
    count again, so that some keys of one document alone stay; that leaves more to compare only."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("many")).where("many > 1")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def candidate_rows(entries: DataFrame) -> DataFrame:
    """``key, node`` and how often the key occurs: the rarest signatures of entries that may link."""
    entry = Window.partitionBy("node", "entry")
    hits = entries.select("node", "entry", "need", F.explode("sigs").alias("key"))
    for turn in range(2):  # without the entries that go, fewer signatures are shared
        parts = []
        for part in range(1 if turn else KEY_PARTS):
            some = hits if turn else hits.where(F.pmod("key", F.lit(KEY_PARTS)) == part)
            often = written(shared(some, "key"))
            parts.append(written(some.drop("many", "found").join(often, "key")))
            discard(often)
        left = written(together(parts).withColumn("found", F.count(F.lit(1)).over(entry)).where("found >= need"))
        for part in parts:
            discard(part)
        if turn:
            discard(hits)
        hits = left
    place = F.row_number().over(entry.orderBy("many", "key"))
    rows = written(hits.withColumn("_place", place).where("_place <= found - need + 1").select("key", "node", "many").distinct())
    discard(hits)
    return rows


def bags(texts: DataFrame, live: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``node, n, z, p0, p1, ...`` of the sets ``live`` (columns of named_sets()): the shingles that
    another one has too, rarest first, and their parities(). Sets with too few of them to link are
    left out."""

    def list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(_texts(batch.column(1))):
                sets = shingle_sets(some, width)
                h1, h2 = set_names(sets)
                part = batch.slice(at, len(some))
                same = (part.column(2).to_numpy() == h1) & (part.column(3).to_numpy() == h2)
                part = part.filter(pa.array(same))
                kept = [s.astype(np.int64) for s, ok in zip(sets, same) if ok]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in kept], pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["node", "n", "s"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of node and z, to one row for each node; a node is cut by batches only."""
        node = n = z = np.empty(0, np.int64)
        for batch in _then_none(batches):
            if batch is not None:
                node, n, z = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((node, n, z)))
            if not len(node):
                continue
            last = len(node) if batch is None else int(np.searchsorted(node, node[-1]))
            once = np.flatnonzero(np.concatenate([[True], (np.diff(node[:last]) != 0) | (np.diff(z[:last]) != 0)])[:last])
            own, first, count = np.unique(node[once], return_index=True, return_counts=True)
            size = n[once][first]
            told = np.flatnonzero(den * count >= num * size)
            lists = [z[once][first[k] : first[k] + count[k]] for k in told]
            bits = parities(lists).T if lists else np.empty((PARITY, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[told]), pa.array(size[told]), pa.array(lists, pa.list_(pa.int64())), *map(pa.array, bits)], names=["node", "n", "z", *_BITS])
            node, n, z = node[last:], n[last:], z[last:]

    sets = texts.join(live.select(F.col("rep").alias("id"), "node", "h1", "h2"), "id").select("node", "text", "h1", "h2")
    sets = written(sets.mapInArrow(list_sets, "node bigint, n bigint, s array<bigint>"))
    each = sets.select("node", "n", F.explode("s").alias("z"))
    often = written(shared(each, "z"))
    # Fourteen bits of rarity, in steps of 0.3 %, before the rest of the hash: the order of numbers is that of rarity.
    ranked = F.shiftleft(F.floor(256 * F.log2("many")), 49).bitwiseOR(F.shiftrightunsigned("z", 15))
    rows = each.join(often, "z").select("node", "n", ranked.alias("z")).repartition("node").sortWithinPartitions("node", "z")
    rows = written(rows.mapInArrow(gather, "node bigint, n bigint, z array<bigint>, " + ", ".join(f"{p} bigint" for p in _BITS)))
    discard(sets)
    discard(often)
    return rows


_BITS = [f"p{w}" for w in range(PARITY)]


def parities(lists: list[np.ndarray]) -> np.ndarray:
    """Of lists, none empty, how many elements fall on each of 64 * PARITY bits, modulo 2. Two lists
    differ in as many elements at least as their bits differ."""
    flat, first = np.concatenate(lists), _segments(np.array([len(x) for x in lists]))[:-1]
    h = mix(flat.astype(np.uint64)) % np.uint64(64 * PARITY)
    bit = np.uint64(1) << (h & np.uint64(63))
    words_ = [np.bitwise_xor.reduceat(np.where(h >> np.uint64(6) == w, bit, np.uint64(0)), first) for w in range(PARITY)]
    return np.stack(words_, axis=1).view(np.int64)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, c, linked, rest`` of pairs ``node, c, smallest``: whether they link, and, of the
    shingles that c lacks, the rarest: those that a set must share one of with any set of
    ``smallest`` shingles or more, if one of the two doesn't link with c."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, rest = [], []
            least, n, m = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for x, y, a, b, low in zip(batch.column(5), batch.column(6), n, m, least):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                inside = np.isin(x, y)
                both = int(inside.sum())
                linked.append(den * both >= num * (a + b - both))
                if low is None:
                    rest.append(x[:0])
                    continue
                need = max(1, -(-num * (a + low) // (num + den)) - both)
                rest.append(x[~inside][: max(0, len(x) - both - need + 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))], names=["node", "c", "linked", "rest"])

    both = pairs.join(sets.select("node", "n", F.col("z").alias("_x")), "node")
    both = both.join(sets.select(F.col("node").alias("c"), F.col("n").alias("m"), F.col("z").alias("_y")), "c")
    return both.select("node", "c", "smallest", "n", "m", "_x", "_y").mapInArrow(compare, "node bigint, c bigint, linked boolean, rest array<bigint>")


def with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    rows = rows.join(labels.groupBy("node").agg(F.min("component").alias("_label")), "node", "left")
    return rows.withColumn("component", F.coalesce("_label", "node")).drop("_label")


def open_buckets(rows: DataFrame, key: str, *more) -> DataFrame:
    """The keys whose members are in several components, with ``more`` aggregates."""
    return rows.groupBy(key).agg(F.min("component").alias("_a"), F.max("component").alias("_b"), *more).where("_a < _b").drop("_a", "_b")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id, text_hash, first`` for every row: the smallest id
    reachable by links, the smallest id with the same set (null without one), Spark's xxhash64 of
    the text, and whether this is the one text of its component that stays if copies go."""
    every = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(signed(every.withColumn("text_hash", F.xxhash64("text")), width, num, den))
    summaries = written(rows.where(F.col("entry") == _SUMMARY).select("id", "text_hash", "n", "h1", "h2"))
    sets = written(named_sets(summaries))
    named = sets.withColumnRenamed("rep", "id")
    parts = []
    for part in range(SET_PARTS):
        some = [x.where(F.pmod("h1", F.lit(SET_PARTS)) == part) for x in (rows.where(F.col("entry") != _SUMMARY), named)]
        parts.append(written(some[0].join(some[1], ["id", "n", "h1", "h2"]).select("node", "entry", "need", "sigs")))
    discard(rows)
    found = candidate_rows(together(parts))
    for part in parts:
        discard(part)
    labels = linked_components(found, every, sets, width, num, den)
    least = summaries.where("n > 0").groupBy("n", "h1", "h2", "id").agg(F.min("text_hash").alias("_hash"))
    least = least.join(sets.select("n", "h1", "h2", F.col("rep").alias("id"), "rep", "node"), ["n", "h1", "h2", "id"]).drop("id")
    if labels is None:
        least = least.select("n", "h1", "h2", "rep", "_hash", F.col("rep").alias("_least"), F.col("node").alias("_first"), "node")
    else:
        linked = sets.select("node", "rep").join(labels, "node")
        linked = linked.join(linked.groupBy("component").agg(F.min("rep").alias("_least"), F.min_by("node", F.struct("rep", "node")).alias("_first")), "component")
        least = least.join(linked.select("node", "_least", "_first"), "node", "left")
    ids = summaries.join(least, ["n", "h1", "h2"], "left")
    first = F.col("node").isNull() | (F.col("node") == F.coalesce("_first", "node")) & (F.col("id") == F.col("rep")) & (F.col("text_hash") == F.col("_hash"))
    return ids.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_least", "rep", "id").alias("component_id"), F.col("rep").alias("set_id"), "text_hash", F.coalesce(first, F.lit(False)).alias("first"))


def linked_components(found: DataFrame, texts: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """``node, component`` of the sets that link, from ``key, node, many`` of candidate_rows()."""
    live = sets.join(found.select("node").distinct(), "node", "left_semi")
    alike = bags(texts, live, width, num, den)
    sizes = alike.select("node", "n", F.size("z").alias("q"), *_BITS)
    fame = found.groupBy("node").agg(F.sum("many").alias("fame"))
    members = written(sizes.join(fame, "node"))
    buckets = written(found.select("key", "node").join(alike.select("node"), "node", "left_semi"))
    discard(found)
    labels = None
    for turn in range(TURNS + 1):
        rows = written(with_component(buckets.join(members, "node"), labels))
        discard(buckets)
        each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct("n", "node")).alias("_s"), F.max(F.struct("fame", "node")).alias("_f"))
        whole = each.groupBy("key").agg(F.count(F.lit(1)).alias("_components"), F.sum("_m").alias("_n"), F.max(F.struct("_m", "component")).alias("_major"), F.min("_s").alias("_small"), F.max("_f").alias("_famous"))
        centers = written(whole.where("_components > 1").drop("_components"))
        at_once = F.col("_n") - F.col("_major._m") <= SMALL if turn < TURNS else F.lit(True)
        pairs = across(rows, centers.where(at_once).select("key", F.col("_major.component").alias("_major")), num, den).withColumn("smallest", F.lit(None).cast("bigint"))
        held = written(outermost(rows.select("key", "node", "n").join(centers.where(~at_once).drop("_major"), "key")))
        if held.limit(1).count():
            others = held.where("node <> _small.node")
            least = written(others.groupBy("_small.node").agg(F.min("n").alias("smallest")).withColumnRenamed("node", "c"))
            small = others.select("node", F.col("_small.node").alias("c")).join(least, "c").select("node", "c", "smallest")
            pairs = pairs.union(small)
            if turn == 0:
                pairs = pairs.union(held.where("node <> _famous.node").select("node", F.col("_famous.node").alias("c"), F.lit(None).cast("bigint")))
        done = written(compared(pairs.groupBy("node", "c").agg(F.min("smallest").alias("smallest")), alike, num, den))
        discard(rows)
        discard(centers)
        links = done.where("linked").select(F.col("node").alias("a"), F.col("c").alias("b"))
        if links.limit(1).count():
            before = labels
            links = links if before is None else links.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = components(links, steps=1 if turn else 2)
            if before is not None:
                discard(before)
        rest = held.select("key", "node", F.col("_small.node").alias("c")).join(done.where(F.size("rest") > 0).select("c", "node", "rest"), ["c", "node"])
        rest = written(with_component(rest, labels))
        discard(done)
        discard(held)
        parted = rest.join(written(open_buckets(rest, "key")), "key", "left_semi").select("key", "node", F.explode("rest").alias("z"))
        # In whatever order shingles part a bucket, the part is the same.
        buckets = written(parted.select(F.col("key").bitwiseXOR(F.xxhash64("z")).alias("key"), "node").distinct())
        discard(rest)
        if not buckets.limit(1).count():
            break
    discard(buckets)
    discard(alike)
    discard(members)
    if labels is not None:
        before = labels
        labels = components(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        discard(before)
    return labels


def outermost(rows: DataFrame) -> DataFrame:
    """``rows`` (a node in a bucket ``key`` of ``_n``) without the buckets that lie in another one.

    Each node names its largest bucket; where all of a bucket name the same other one, that holds
    whatever this one does, and is left or lies in a larger one itself.
    """
    home = written(rows.groupBy("node").agg(F.max(F.struct("_n", "key"))["key"].alias("_home")))
    inside = rows.select("node", "key").join(home, "node").groupBy("key").agg(F.min("_home").alias("_a"), F.max("_home").alias("_b"))
    return rows.join(written(inside.where("_a <> _b OR _a = key").select("key")), "key", "left_semi")


def across(rows: DataFrame, major: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``node, c`` of different components in the buckets of ``major`` (``key, _major``: the
    largest component) that may link by their sizes: the shingles that one has alone (all but q), and
    bits that differ, are differences. Members outside the largest component meet all others."""
    few = rows.join(major, "key").where("component <> _major")
    few = few.select("key", F.col("node").alias("c"), F.col("n").alias("m"), F.col("q").alias("r"), F.col("component").alias("_other"), *[F.col(p).alias(f"_{p}") for p in _BITS])
    both = rows.join(few, "key").where("component <> _other")
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"_{p}"))) for p in _BITS), F.col("n") - F.col("q") + F.col("m") - F.col("r"))
    size = F.col("n") + F.col("m")
    both = both.where(den * (size - apart) >= num * (size + apart))
    return both.select(F.greatest("node", "c").alias("node"), F.least("node", "c").alias("c")).distinct()
