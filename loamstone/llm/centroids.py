"""Centroid clustering of vectors in whole numbers, with candidates from an annulus of norms.

By the triangle inequality a centroid within distance u of a vector has a norm within u of the vector's norm. The centroids
are sorted by norm. Of each vector the centroid of the nearest norm gives an upper bound u; a binary search finds the centroids
with norms in the annulus around the vector's norm, its border included and widened by more than what floating point can be
wrong by, so that ties at the border are among them; these are compared exactly, in whole numbers, and the annulus shrinks
with what is found. Of equally near centroids the one of the smaller number is taken.

A round reads the vectors once, in parallel; a task sends on one row for each centroid and component (sum and count), which Spark
adds up. What the driver holds are the centroids, k times d numbers, whatever the number of vectors. No vector is shuffled, so a
vector that most rows have costs no more than any other.

Defined results: vectors of another number of components, or with one that is null, NaN or infinite, aren't kept and have no
row; null vectors neither. Components are floor(scale * x) in double precision; those whose square would leave 64 bits in a distance
(beyond 2^27 either way for 64 components) count as that bound. Rows are vectors: equal ids are assigned each by itself, a null
id too, but a null id never starts a centroid while others are there; equal ids start in order of their components. With fewer
vectors than centroids there are as many centroids as vectors. An empty table gives an empty table. An inertia that doesn't fit a long is
null. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map, materialize

#: Relative and absolute widening of the annulus.
_WIDER, _LEAST = 1e-9, 1e-6


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, within the bound for squared distances."""
    bound = math.isqrt((1 << 62) // (4 * max(1, vectors.shape[1])))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def _matrix(col: pa.Array, d: int, scale: int) -> np.ndarray:
    return integers(np.asarray(col.flatten()).reshape(len(col), d), scale)


class Annulus:
    """Exact nearest centroids of many vectors."""

    def __init__(self, centroids: np.ndarray):
        square = (centroids * centroids).sum(axis=1)
        self.number = np.argsort(square, kind="stable")
        self.centroids, self.square = centroids[self.number], square[self.number]
        self.norms = np.sqrt(self.square.astype(np.float64))

    def _distance(self, x: np.ndarray, xx: np.ndarray, exact: bool, rows: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """Squared distances of these rows to centroid ``j`` (one, or one a row)."""
        c = self.centroids[j]
        if isinstance(j, np.ndarray):
            return ((x[rows] - c) ** 2).sum(axis=1)
        inner = (x[rows].astype(np.float64) @ c.astype(np.float64)).astype(np.int64) if exact else x[rows] @ c
        return xx[rows] + self.square[j] - 2 * inner

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        n, k = len(x), len(self.norms)
        xx = (x * x).sum(axis=1)
        norm = np.sqrt(xx.astype(np.float64))
        exact = n > 0 and float(np.abs(x).max()) * float(np.abs(self.centroids).max()) * x.shape[1] < 2**53  # sums in double are whole
        above = np.minimum(np.searchsorted(self.norms, norm), k - 1)
        below = np.maximum(above - 1, 0)
        first = np.where(np.abs(self.norms[above] - norm) < np.abs(self.norms[below] - norm), above, below)
        best = self._distance(x, xx, exact, np.arange(n), first)
        chosen = self.number[first]
        reach = np.sqrt(best.astype(np.float64)) * (1 + _WIDER) + _LEAST + norm * _WIDER
        low = np.searchsorted(self.norms, norm - reach, side="left")
        high = np.searchsorted(self.norms, norm + reach, side="right")
        for j in range(int(low.min(initial=k)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= j) & (j < high) & (first != j))
            rows = rows[np.abs(self.norms[j] - norm[rows]) <= np.sqrt(best[rows].astype(np.float64)) * (1 + _WIDER) + _LEAST + norm[rows] * _WIDER]
            if len(rows) == 0:
                continue
            got = self._distance(x, xx, exact, rows, j)
            better = (got < best[rows]) | ((got == best[rows]) & (self.number[j] < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = got[better], self.number[j]
        return chosen, best


def kept(df: DataFrame, d: int, vector: str) -> DataFrame:
    """Rows whose vector has ``d`` components, all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size(vector) == d) & ~bad)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int, vector: str) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors their number and the sums of their components, exactly."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, count, total = Annulus(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(0), d, scale)
            chosen, _ = near.nearest(x)
            order = np.argsort(chosen, kind="stable")
            names, at, size = np.unique(chosen[order], return_index=True, return_counts=True)
            count[names] += size
            if len(names):
                total[names] += np.add.reduceat(x[order], at, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(np.repeat(count[used], d)), pa.array(total[used].ravel())], names=["c", "i", "n", "s"])

    parts = rows.select(vector).transform(arrow_map, run, "c long, i long, n long, s long")
    added = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # k times d rows at most
        out.setdefault(r["c"], (r["n"], [0] * d))[1][r["i"]] = int(r["s"])
    return out


def fitted(df: DataFrame, k: int, rounds: int, d: int = 64, scale: int = 64, seed: str = "1", key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The centroids after ``rounds`` rounds, k (or fewer) rows of d whole numbers."""
    rows = kept(df, d, vector)
    start = rows.select(key, vector).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).asc_nulls_last(), vector).limit(k).collect()
    centroids = integers(np.array([r[1] for r in start], dtype=np.float64).reshape(len(start), d), scale)
    for _ in range(rounds if len(start) else 0):
        for c, (n, sums) in _sums(rows, centroids, scale, vector).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assigned(df: DataFrame, centroids: np.ndarray, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared) of each kept vector."""
    d = centroids.shape[1]
    field = next(f for f in df.schema.fields if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for b in batches:
            chosen, distance = near.nearest(_matrix(b.column(1), d, scale))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen.astype(np.int32)), pa.array(distance)], names=[key, "cluster", "distance"])

    rows = kept(df, d, vector) if len(centroids) else df.limit(0)
    return rows.select(key, vector).transform(arrow_map, run, f"`{key}` {field.dataType.simpleString()}, cluster int, distance long")


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, d: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector after ``rounds`` rounds."""
    centroids = fitted(df, k, rounds, d, scale, key=key, vector=vector)
    rows = materialize(assigned(df, centroids, scale, key, vector), "clustered")
    spent = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(spent.values()))
    said = [(c, fits(n), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in spent.items()]
    facts = df.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
