"""Operator 11, centroid clustering, by ball-tree filtering.

Vectors become whole numbers, so that sums and distances are exact. Each task arranges its vectors,
a block at a time, in metric trees: a node is a ball with its radius, its count and the sum of
its vectors. The trees are written once, and every round walks them: a ball whose nearest centroid is
nearer than any other by more than its diameter belongs to that one as a whole, by its sum alone; else
the centroids that can't be the nearest of any of its vectors go, and its halves are asked. What is
left in leaves is compared exactly. A round returns a row for each centroid, whatever the input.

Defined cases: a vector that is null, has another number of components, or one that is null, not
finite or beyond ``LARGEST`` when turned into a whole number (its distances needn't fit a long) isn't
kept; a vector without an id is clustered, but never a first centroid; repeated rows are
vectors of their own, and of equal ids that with the smaller components comes first; with fewer
vectors than centroids each is one; sums of distances beyond a long are null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Vectors of a tree at most, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Whole numbers up to this give distances within a long at 64 components.
LARGEST = 1 << 27
#: Whole numbers up to this give exact distances in doubles at 64 components.
EXACT_DOUBLES = 1 << 22


@dataclass(frozen=True)
class Tree:
    """Vectors in the order of the leaves; nodes level by level, the halves of node i at 2 i + 1, 2 i + 2."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    radii: np.ndarray

    @property
    def centres(self) -> np.ndarray:
        return self.sums / (self.ends - self.starts)[:, None]


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A tree over at least one vector, and the order in which it has them."""
    order = np.arange(len(points))
    levels = [[(0, len(points))]]
    while max(b - a for a, b in levels[-1]) > leaf:
        halves = []
        for a, b in levels[-1]:
            own = points[order[a:b]]
            axis = int((own.max(0) - own.min(0)).argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
            halves += [(a, a + middle), (a + middle, b)]
        levels.append(halves)
    points = points[order]
    sums, radii = [], []
    for level in levels:
        starts, ends = np.array(level).T
        sums.append(np.add.reduceat(points, starts, axis=0))
        away = points - np.repeat(sums[-1] / (ends - starts)[:, None], ends - starts, axis=0)
        radii.append(np.sqrt(np.maximum.reduceat((away * away).sum(1), starts)))
    starts, ends = np.array([node for level in levels for node in level]).T
    return Tree(points, starts, ends, np.concatenate(sums), np.concatenate(radii)), order


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, as whole numbers."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_DOUBLES:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole balls and their centroids, then single vectors and theirs. Ties go to the smaller number."""
    centres, leaves = tree.centres, len(tree.starts) // 2
    nodes, allowed = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    balls, of_balls = [], []
    while len(nodes):
        d = np.sqrt(((centres[nodes][:, None, :] - centroids[None]) ** 2).sum(2))
        d[~allowed] = np.inf
        least = d.min(1)
        slack = 1e-6 + 1e-9 * (least + tree.radii[nodes])  # doubles are rounded: prune a little less
        allowed &= d - least[:, None] <= (2 * tree.radii[nodes] + slack)[:, None]
        whole = allowed.sum(1) == 1
        balls.append(nodes[whole])
        of_balls.append(allowed[whole].argmax(1))
        nodes, allowed = nodes[~whole], allowed[~whole]
        if not len(nodes) or nodes[0] >= leaves:
            break
        nodes, allowed = np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).ravel(), np.repeat(allowed, 2, axis=0)
    n = tree.ends[nodes] - tree.starts[nodes]
    single = np.concatenate([np.arange(a, b) for a, b in zip(tree.starts[nodes], tree.ends[nodes])] + [np.empty(0, np.int64)]).astype(np.int64)
    d = squared_distances(tree.points[single], centroids)
    d[~np.repeat(allowed, n, axis=0)] = np.iinfo(np.int64).max
    return np.concatenate(balls), np.concatenate(of_balls), single, d.argmin(1) if len(single) else np.empty(0, np.int64)


def sums_of(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the vectors of each centroid."""
    balls, of_balls, single, of_single = assign(tree, centroids)
    counts = np.bincount(of_single, minlength=len(centroids)).astype(np.int64)
    np.add.at(counts, of_balls, tree.ends[balls] - tree.starts[balls])
    sums = np.zeros((len(centroids), tree.points.shape[1]), np.int64)
    np.add.at(sums, of_balls, tree.sums[balls])
    np.add.at(sums, of_single, tree.points[single])
    return counts, sums


def labels_of(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and squared distance of each vector of the tree."""
    balls, of_balls, single, of_single = assign(tree, centroids)
    label = np.empty(len(tree.points), np.int64)
    label[single] = of_single
    for node, k in zip(balls.tolist(), of_balls.tolist()):
        label[tree.starts[node] : tree.ends[node]] = k
    away = tree.points - centroids[label]
    return label, (away * away).sum(1)


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """``id, v`` of the vectors that are kept, as floors of ``scale`` times their components."""
    given = F.col(vector_col).cast("array<double>")
    # Within the bound a component is neither null, NaN nor infinite.
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), given.alias("x"))
    kept = kept.where(F.coalesce((F.size("x") == dims) & F.forall("x", lambda c: F.coalesce(F.abs(c) * scale <= F.lit(float(LARGEST)), F.lit(False))), F.lit(False)))
    return kept.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def trees(kept: DataFrame, dims: int) -> DataFrame:
    """A row for each tree of a task: ids and vectors in the order of its leaves, and its nodes."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                tree, order = build(points)
                ids = part.column(0).take(pa.array(order))
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (tree.points.astype("<i4"), tree.starts.astype("<i4"), tree.ends.astype("<i4"), tree.sums.astype("<i8"), tree.radii.astype("<f8"))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "points", "starts", "ends", "sums", "radii"])

    return kept.mapInArrow(plant, "ids array<bigint>, points binary, starts binary, ends binary, sums binary, radii binary")


def read_trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    """The ids and the tree of each row of trees()."""
    for row in range(batch.num_rows):
        points, starts, ends, sums, radii = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in enumerate(("<i4", "<i4", "<i4", "<i8", "<f8"), 1))
        yield batch.column(0)[row].values, Tree(points.astype(np.int64).reshape(-1, dims), starts.astype(np.int64), ends.astype(np.int64), sums.reshape(-1, dims), radii)


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of ``salt:id``, in their order."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    found = kept.where("id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in found], np.int64)


def next_centroids(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; one without vectors stays."""
    dims = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in read_trees(batch, dims):
                n, s = sums_of(tree, centroids)
                counts, sums = counts + n, sums + s
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = forest.mapInArrow(add, "cluster bigint, n bigint, s array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    after = centroids.copy()
    for row in total.collect():  # a row for each centroid
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return after


def labelled(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in read_trees(batch, dims):
                k, d = labels_of(tree, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(k.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return forest.mapInArrow(label, "id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, clusters: int = 8, rounds: int = 10, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector
    after ``rounds`` rounds, and the centroids (at most ``clusters`` rows on the driver)."""
    kept = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    forest = written(trees(kept, dims))
    centroids = first_centroids(kept, clusters, salt).reshape(-1, dims)
    if len(centroids):
        for _ in range(rounds):
            after = next_centroids(forest, centroids)
            if (after == centroids).all():  # further rounds change nothing
                break
            centroids = after
    else:  # without ids there is nothing to begin with
        forest = forest.limit(0)
        centroids = np.zeros((1, dims), np.int64)
    rows = written(labelled(forest, centroids))
    sums = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    within = lambda x: x if x < 1 << 63 else None
    facts = [(k, within(sums.get(k, 0)), within(sum(sums.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    by_cluster = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # A row for each centroid.
    found = rows.join(F.broadcast(by_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return found, centroids
