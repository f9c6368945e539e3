"""K-means over integer vectors by ball-tree filtering, exact to the last unit.

Components become floor(scale * x). Each task packs its vectors into blocks and
builds a metric tree over each: a ball is split at the median of the line
through two vectors that are far apart, and keeps its radius, its count and the
integer sum of its vectors. The trees are written once to the checkpoint
folder. A round sends the centroids (k vectors, whatever the size of the
table) to the trees: by the triangle inequality a ball whose farthest vector
is nearer to one centroid than its nearest vector can be to any other goes to
that centroid whole, by its count and sum; the others are descended, and
vectors of leaves are compared exactly. Tasks send back count and sum of each
centroid, which Spark adds up; no vector is shuffled.

Bounds on distances carry the error of their arithmetic, so that a ball is
assigned whole only if every vector in it is strictly nearer; equal distances
are met at leaves alone, where integers are compared and the smaller number
wins. A centroid that equals one of a smaller number gets no vector.

Defined results: vectors that are null, of another length, or with a null, NaN
or infinite component are left out, as are those with a component of 2 ** 27
or more after scaling, whose squared distances a long can't hold; repeated rows count
each; of repeated ids among the first centroids the smaller vector comes
first; a null id is hashed as an empty text; with fewer vectors than centroids
there is a centroid a vector; without vectors, or from an empty table, the
result is empty. Extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import checkpointed, parallel, quoted

#: Vectors of a block (a tree), and of a leaf at most.
BLOCK, LEAF = 16384, 24
#: Components have to stay below this after scaling.
LIMIT = 1 << 27
#: Below this, products and sums of 64 components are exact in floating point.
_EXACT = 1 << 21


def kept(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors of the rows that count; columns of the batch are id and vector."""
    ids, vectors = batch.column(0), batch.column(1)
    whole = pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dims)
    ids, vectors = ids.filter(whole), vectors.filter(whole)
    x = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(scale * x)
        sound = (np.abs(y) < LIMIT).all(axis=1)  # false for NaN
    return ids.filter(pa.array(sound)), y[sound].astype(np.int32)


def cuts(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Where the balls of each level begin (and the end): halves of halves of n vectors."""
    out = [np.array([0, n])]
    while (size := np.diff(out[-1])).max() > max(leaf, 2):
        out.append(np.append(np.column_stack([out[-1][:-1], out[-1][:-1] + (size + 1) // 2]).ravel(), n))
    return out


def _farthest(points: np.ndarray, of: np.ndarray, own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of points from their ball's place in `of`, and each ball's farthest point."""
    away = ((points - of[own]) ** 2).sum(axis=1)
    at = np.flatnonzero(away == np.maximum.reduceat(away, begin)[own])
    return away, points[at[np.unique(own[at], return_index=True)[1]]]


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """An order of the points in which every ball is a slice, and each level's integer sums and radii."""
    order, sums, radii = np.arange(len(points)), [], []
    levels = cuts(len(points), leaf)
    for depth, edges in enumerate(levels):
        begin, size = edges[:-1], np.diff(edges)
        own, here = np.repeat(np.arange(len(begin)), size), points[order]
        sums.append(np.add.reduceat(here.astype(np.int64), begin, axis=0))
        real = here.astype(np.float64)
        away, first = _farthest(real, sums[-1] / size[:, None], own, begin)
        radii.append(np.sqrt(np.maximum.reduceat(away, begin)) * (1 + 1e-12))
        if depth + 1 < len(levels):
            second = _farthest(real, first, own, begin)[1]
            order = order[np.lexsort(((real * (second - first)[own]).sum(axis=1), own))]
    return order, sums, radii


class Tree:
    """A block's tree as the table of trees holds it."""

    def __init__(self, points: bytes, sums: bytes, radii: bytes, dims: int):
        self.points = np.frombuffer(points, np.int32).reshape(-1, dims)
        self.levels = cuts(len(self.points))
        ends = np.cumsum([len(x) - 1 for x in self.levels])[:-1]
        self.sums = np.split(np.frombuffer(sums, np.int64).reshape(-1, dims), ends)
        self.radii = np.split(np.frombuffer(radii, np.float64), ends)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each point's centroid, each centroid's count and sum, and how many points went with a whole ball."""
        k, dims = centroids.shape
        to, count, total = np.empty(len(self.points), np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        number = np.sort(np.unique(centroids, axis=0, return_index=True)[1])  # equal ones by their smallest number
        some = centroids[number]
        real = some.astype(np.float64)
        square = (real**2).sum(axis=1)
        open_balls, whole = np.zeros(1, np.int64), 0
        for depth, edges in enumerate(self.levels):
            size = np.diff(edges)[open_balls]
            sums = self.sums[depth][open_balls]
            centre = sums / size[:, None]
            own = (centre**2).sum(axis=1)[:, None]
            away = own - 2 * (centre @ real.T) + square
            error = 1e-13 * dims * (own + square)
            low, high = (np.sqrt(np.maximum(away + s * error, 0)) for s in (-1, 1))
            best, row = high.argmin(axis=1), np.arange(len(size))
            radius = self.radii[depth][open_balls]
            nearest = high[row, best] + radius
            low[row, best] = np.inf
            won = (low - radius[:, None]).min(axis=1) > nearest * (1 + 1e-12)
            np.add.at(count, number[best[won]], size[won])
            np.add.at(total, number[best[won]], sums[won])
            for a, b, c in zip(edges[open_balls[won]].tolist(), edges[open_balls[won] + 1].tolist(), number[best[won]].tolist(), strict=True):
                to[a:b] = c
            whole += int(size[won].sum())
            open_balls = open_balls[~won]
            if depth + 1 < len(self.levels):
                open_balls = np.column_stack([2 * open_balls, 2 * open_balls + 1]).ravel()
            if not len(open_balls):
                return to, count, total, whole
        begin, size = self.levels[-1][open_balls], np.diff(self.levels[-1])[open_balls]
        left = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        near = number[nearest_of(self.points[left], some)]
        to[left] = near
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        count[found] += np.diff(np.append(at, len(near)))
        total[found] += np.add.reduceat(self.points[left][order].astype(np.int64), at, axis=0)
        return to, count, total, whole


def nearest_of(points: np.ndarray, centroids: np.ndarray, rows: int = 8192) -> np.ndarray:
    """The nearest centroid of each point by exact squared distances; of equal ones the first."""
    small = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT and points.shape[1] <= 64
    kind = np.float64 if small else np.int64
    c = centroids.astype(kind)
    square = (c * c).sum(axis=1)
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(points), rows):
        out.append((square - 2 * (points[at : at + rows].astype(kind) @ c.T)).argmin(axis=1))
    return np.concatenate(out)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; a task sends its own k smallest."""
    schema = pa.schema([("hash", pa.string()), ("vector", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            ids, points = kept(batch, dims, scale)
            hashes = [sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            last = best[-1][0] if len(best) == k else "g"
            best = sorted(best + [(h, p.tolist()) for h, p in zip(hashes, points, strict=True) if h <= last])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in best], f.type) for i, f in enumerate(schema)], schema=schema)

    found = vectors.mapInArrow(run, "hash string, vector array<int>").orderBy("hash", "vector").limit(k).collect()
    return np.array([x.vector for x in found], np.int64).reshape(-1, dims)


def trees(vectors: DataFrame, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """ids, points, sums, radii: a row for each block's tree, in the checkpoint folder."""
    kind = vectors.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids, points = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            order, sums, radii = build(points)
            row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), *(pa.array([np.ascontiguousarray(x).tobytes()]) for x in (points[order], np.concatenate(sums), np.concatenate(radii)))]
            return pa.RecordBatch.from_arrays(row, ["ids", "points", "sums", "radii"])

        for batch in batches:
            ids, points = kept(batch, dims, scale)
            while len(points):
                room = block - sum(len(x[1]) for x in held)
                held.append((ids[:room], points[:room]))
                ids, points = ids[room:], points[room:]
                if sum(len(x[1]) for x in held) == block:
                    yield made()
        if held:
            yield made()

    return checkpointed(vectors.mapInArrow(run, f"ids array<{kind}>, points binary, sums binary, radii binary"))


def _opened(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, Tree(*(batch.column(c)[i].as_py() for c in (1, 2, 3)), dims)


def totals(held: DataFrame, centroids: np.ndarray) -> tuple[list[int], np.ndarray, int, int]:
    """Each centroid's count, sum and sum of squared distances, and how many points went with whole balls.

    A task sends at most a row for each number that it has.
    """
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 3), np.int64)
        for _, tree in _opened(batches, dims):
            to, count, total, whole = tree.assign(centroids)
            sums[:, 0] += count
            np.add.at(sums[:, 1], to, squared(tree.points, centroids, to))
            sums[0, 2] += whole
            sums[:, 3:] += total
        cluster, part = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(sums[cluster, part])], schema=schema)

    out = np.zeros((k, dims + 3), object)
    for x in held.mapInArrow(run, "cluster int, part int, value long").groupBy("cluster", "part").agg(F.sum("value").alias("value")).collect():
        out[x.cluster, x.part] = x.value
    return out[:, 0].tolist(), out[:, 3:], out[:, 1].tolist(), int(out[0, 2])


def squared(points: np.ndarray, centroids: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        apart = points[at : at + 4096] - centroids[to[at : at + 4096]]
        out[at : at + 4096] = np.einsum("ij,ij->i", apart, apart)
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", block: int = BLOCK) -> DataFrame:
    """The id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that counts.

    Each of the rounds assigns all vectors and moves every centroid that has
    some to the floor of their mean; then they are assigned once more.
    """
    rows = parallel(vectors.select(quoted(id_column), quoted(vector_column)))
    kind = rows.schema[0].dataType.simpleString()
    name = "`" + id_column.replace("`", "``") + "`"
    shape = f"{name} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, dims, scale, salt)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], shape)
    held = trees(rows, dims, scale, block)
    for _ in range(rounds):
        counts, sums, _, _ = totals(held, centroids)
        centroids = np.array([[int(s) // n for s in total] if n else old.tolist() for n, total, old in zip(counts, sums, centroids, strict=True)], np.int64)
    inertia = totals(held, centroids)[2]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _opened(batches, dims):
            to = tree.assign(centroids)[0]
            own = pa.array(to)
            columns = [ids, own.cast(pa.int32()), pa.array(squared(tree.points, centroids, to)), pa.array(inertia, pa.int64()).take(own), pa.array(np.full(len(to), sum(inertia))), pa.array(digests).take(own)]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return held.mapInArrow(run, shape)
