"""Centroid clustering of integer vectors, exact at every size.

Vectors become blocks of rows once. A round hands the centroids (a few rows) to a treeAggregate over the
blocks, which assigns every row and combines sums and counts; the driver sees those alone. Squared
distances are |x|^2 - 2 x.c + |c|^2 with one matrix product a block. In float64 that is exact while every
number on the way stays below 2^53; a block whose largest magnitude doesn't guarantee this is worked out in
integers, of 64 bits where they suffice and of any length beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import stored

#: Rows of a block, about 2 MB at 64 components.
BLOCK = 4096
#: Integers up to here are exact in float64, and in 64 bits.
EXACT, LONG = 1 << 53, (1 << 63) - 1
_BLOCK_TYPE = "ids array<bigint>, least bigint, most bigint, flat binary, wide array<string>"


@dataclass(frozen=True)
class Clusters:
    """Centroids after the last round, and for each of them its vectors and the sum of their squared distances."""

    centroids: tuple[tuple[int, ...], ...]
    sizes: tuple[int, ...]
    inertia: tuple[int, ...]

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[k])).encode()).hexdigest()


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), whatever the size of x."""
    a, b = float(x).as_integer_ratio()
    return a * scale // b


def sound(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def blocks(df: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The sound vectors of df as stored blocks: their ids, the range of their integers, and these row by row: as 64-bit numbers, or as text where one takes more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), dim)
                with np.errstate(over="ignore"):
                    y = np.floor(x * scale)
                wide = ~(np.abs(y) < EXACT).all(axis=1)  # integers that take more are few: each is made from its fraction
                for rows, big in ((np.flatnonzero(~wide), False), (np.flatnonzero(wide), True)):
                    if not len(rows):
                        continue
                    if big:
                        text = [str(scaled(v, scale)) for v in x[rows].ravel()]
                        made = [some.column(0).take(pa.array(rows))], [None], [None], [None], [text]
                    else:
                        whole = y[rows].astype("<i8")
                        made = [some.column(0).take(pa.array(rows))], [int(whole.min())], [int(whole.max())], [whole.tobytes()], [None]
                    ids, least, most, flat, text = made
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[0].to_pylist()], pa.list_(pa.int64())), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(flat, pa.binary()), pa.array(text, pa.list_(pa.string()))],
                        ["ids", "least", "most", "flat", "wide"],
                    )

    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound(F.col("v"), dim))
    return stored(rows.mapInArrow(run, _BLOCK_TYPE), "blocks", keep=True)


def matrix(block, dim: int) -> np.ndarray:
    """The integers of a block, as 64-bit numbers or as Python's."""
    if block["flat"] is not None:
        return np.frombuffer(block["flat"], "<i8").reshape(-1, dim)
    return np.array([int(v) for v in block["wide"]], object).reshape(-1, dim)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def distances(x: np.ndarray, centroids: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Squared distances of the rows of x (integers) to the centroids; exact, by whichever arithmetic the magnitudes allow."""
    dim = len(centroids[0])
    c = np.array(centroids, object)
    # no term and no partial sum of |x|^2, 2 x.c or |c|^2, nor of their combination, exceeds dim * (max|x| + max|c|)^2
    bound = dim * (_largest(x) + _largest(c)) ** 2
    if bound < EXACT:
        return _expanded(x.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if bound <= LONG:
        return _expanded(x.astype(np.int64), c.astype(np.int64))
    return _expanded(x.astype(object), c)


def _expanded(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def nearest(x: np.ndarray, centroids: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centroid, the smaller number among equally near ones, and the squared distance."""
    d = distances(x, centroids)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(k)), k]


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> list[list[int]]:
    """For each cluster the sum of its rows, as Python's integers."""
    exact = _largest(x) * len(x) <= LONG
    rows = x.astype(np.int64) if exact else x.astype(object)
    return [[int(v) for v in rows[cluster == i].sum(axis=0)] if (cluster == i).any() else [0] * x.shape[1] for i in range(k)]


def _round(table: DataFrame, centroids: tuple[tuple[int, ...], ...], sums: bool) -> tuple[list[int], list[list[int]]]:
    """Counts of the clusters and, with sums, the sums of their vectors, else those of the distances: dim + 1 numbers a cluster, whatever the data."""
    k, dim = len(centroids), len(centroids[0])
    width = dim if sums else 1

    def add(acc, block):
        x = matrix(block, dim)
        cluster, d = nearest(x, centroids)
        more = _sums(x, cluster, k) if sums else [[sum(map(int, d[cluster == i]))] for i in range(k)]
        return combine(acc, (np.bincount(cluster, minlength=k).tolist(), more))

    def combine(a, b):
        return [x + y for x, y in zip(a[0], b[0], strict=True)], [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a[1], b[1], strict=True)]

    parts = table.select("flat", "wide").rdd
    return parts.treeAggregate(([0] * k, [[0] * width for _ in range(k)]), add, combine)


def first_centroids(df: DataFrame, k: int, dim: int, scale: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[tuple[int, ...], ...]:
    """The k sound vectors whose ids, behind the seed, have the smallest SHA-256, in that order; rows without an id play no part, those of one id come in order of their components."""
    rows = df.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256).alias("h"), F.col(vector_col).cast("array<double>").alias("v"))
    top = rows.where(F.col("h").isNotNull() & sound(F.col("v"), dim)).orderBy("h", "v").limit(k).collect()  # k rows
    return tuple(tuple(scaled(x, scale) for x in r["v"]) for r in top)


def fit(table: DataFrame, start: tuple[tuple[int, ...], ...], rounds: int) -> Clusters:
    """Rounds over the blocks of table: assign every vector, then move each non-empty centroid to the floored mean of its vectors. Stops early only where no centroid moves, as further rounds would change nothing."""
    centroids = start
    for _ in range(rounds):
        counts, sums = _round(table, centroids, sums=True)
        moved = tuple(tuple(s // n for s in row) if n else old for n, row, old in zip(counts, sums, centroids, strict=True))
        if moved == centroids:
            break
        centroids = moved
    counts, inertia = _round(table, centroids, sums=False)
    return Clusters(centroids, tuple(counts), tuple(row[0] for row in inertia))


def _long(n: int) -> int | None:
    return n if n <= LONG else None


def assign(table: DataFrame, clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every vector of the blocks; numbers beyond 64 bits are null."""
    found = clusters.centroids
    dim = len(found[0])
    inertia, total, digest = [_long(n) for n in clusters.inertia], _long(sum(clusters.inertia)), [clusters.digest(k) for k in range(len(found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                k, d = nearest(matrix(block, dim), found)
                of = k.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["ids"], pa.int64()), pa.array(of, pa.int32()), pa.array([_long(int(v)) for v in d], pa.int64()),
                        pa.array([inertia[i] for i in of], pa.int64()), pa.array([total] * len(of), pa.int64()), pa.array([digest[i] for i in of], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return table.select("ids", "flat", "wide").mapInArrow(run, _RESULT)


_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """A row for each vector of dim components, none null or non-finite, repeated rows and null ids too: its cluster among k after the rounds, its squared distance, the sums of these, and a digest of its centroid.

    Components count as floor(scale * x). Other vectors are left out. With fewer than k vectors each of them starts a
    centroid; vectors without an id start none, and where only such are left, as in an empty table, there are no rows.
    """
    start = first_centroids(df, k, dim, scale, seed)
    if not start:
        return df.sparkSession.createDataFrame([], _RESULT)
    table = blocks(df, dim, scale)
    return assign(table, fit(table, start, rounds))
