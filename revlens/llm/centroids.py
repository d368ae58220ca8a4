"""Centroid clustering of integer vectors, with bounds loosened by total displacements.

A vector is kept if it has exactly ``size`` components, none null or non-finite; component x
becomes the whole number floor(64 * x). (Beyond 2^27 it is cut to +-2^27, so that squared
distances fit 64 bits.) The first centroids are the ``k`` kept vectors with the smallest
SHA-256 of ``1:<vec_id>``; vectors of equal or null ids are told apart by their components.
Every round assigns each vector to the nearest centroid (squared Euclidean distance, ties to
the smaller number) and moves every non-empty centroid to floor(sum / count) per component.

A vector remembers its distance to every centroid and the round in which it was computed. All
earlier centroids are kept. In a later round a remembered distance is a bound for the present
one, loose by the distance between the centroid then and now: one norm of the total
displacement, which is never more than the sum of the norms of each round's drift. Where the
bounds leave one centroid nearest beyond doubt, nothing is computed; otherwise the distance to
the own centroid is computed anew, then to those whose bounds still reach it. Bounds have a
margin for rounding and decide only what is strictly farther, so assignments are exact.

Vectors and bounds are written to the shared folder every round (the table before is removed
once the new one is complete); per round only counts and sums of each centroid's components
reach the driver. Fewer kept vectors than ``k`` give as many centroids; none give no rows.
Rows with equal ids stay rows of their own. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import removed, stored, tidy, to_batches

SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27
#: Relative margin of bounds: they are kept in single precision.
MARGIN = 1e-6
#: Below this, products of components and their sums are exact in double precision.
_EXACT = 1 << 20

STATE = "vec_id long, x array<int>, cluster int, far array<float>, since array<short>"
_STATE = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("far", pa.list_(pa.float32())), ("since", pa.list_(pa.int16()))])


def whole_numbers(vector: Column) -> Column:
    def scaled(v: Column) -> Column:
        x = F.floor(F.least(F.greatest(F.lit(SCALE) * v.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
        return x.cast("int")

    return F.transform(vector, scaled)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id, x of the vectors that are complete and finite."""
    column = F.col(vector_col)
    finite = F.forall(column, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.coalesce(F.size(column) == size, F.lit(False)) & F.coalesce(finite, F.lit(False))
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(column).alias("x"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    named = kept.withColumn("at", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy(F.col("at").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row, as 64-bit integers."""
    return ((x - c) ** 2).sum(axis=1)


def squared_to_all(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids): exact squared distances as 64-bit integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Bounds:
    """The assignment of a batch, with what is known of its distances."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, far: np.ndarray, since: np.ndarray):
        self.x, self.cluster, self.far, self.since = x, cluster, far, since
        self.computed = 0

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        d = squared_to_all(x, centroids)
        out = cls(x, d.argmin(axis=1).astype(np.int32), np.sqrt(d).astype(np.float32), np.zeros(d.shape, np.int16))
        out.computed = d.size
        return out

    def assign(self, history: list[np.ndarray]) -> None:
        """The nearest of the last centroids in ``history``."""
        now, centroids = len(history) - 1, history[-1]
        rows, k = self.far.shape
        moved = np.stack([np.sqrt(((centroids - then) ** 2).sum(axis=1).astype(float)) for then in history])  # (round, centroid)
        loose = moved[self.since, np.arange(k)] * (1 + MARGIN)
        far = self.far.astype(float)
        low = far * (1 - MARGIN) - loose
        at = np.arange(rows)
        low[at, self.cluster] = np.inf
        high = far[at, self.cluster] * (1 + MARGIN) + loose[at, self.cluster]
        doubt = np.flatnonzero(low.min(axis=1) <= high)
        if not len(doubt):
            return
        own = self.cluster[doubt]
        exact = np.full((len(doubt), k), np.iinfo(np.int64).max)
        here = np.arange(len(doubt))
        exact[here, own] = squared(self.x[doubt], centroids[own])
        reach = low[doubt] <= np.sqrt(exact[here, own].astype(float))[:, None] * (1 + MARGIN)
        i, j = np.nonzero(reach)
        exact[i, j] = squared(self.x[doubt[i]], centroids[j])
        self.computed += len(doubt) + len(i)
        known = exact < np.iinfo(np.int64).max
        i, j = np.nonzero(known)
        self.far[doubt[i], j] = np.sqrt(exact[i, j]).astype(np.float32)
        self.since[doubt[i], j] = now
        self.cluster[doubt] = exact.argmin(axis=1)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _assigned(history: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(_column(batch, "x"), np.int64)
            if len(history) == 1:
                b = Bounds.first(x, history[0])
            else:
                cluster = _column(batch, "cluster").to_numpy().copy()
                b = Bounds(x, cluster, _matrix(_column(batch, "far"), np.float32), _matrix(_column(batch, "since"), np.int16))
                b.assign(history)
            yield to_batches(_STATE, [_column(batch, "vec_id"), _lists(x.astype(np.int32)), b.cluster, _lists(b.far), _lists(b.since)])

    return run


def _summed(k: int):
    """(cluster, place, total) of a task's vectors; place -1 counts them."""
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster = _matrix(_column(batch, "x"), np.int64), _column(batch, "cluster").to_numpy()
            totals = np.zeros((k, x.shape[1] + 1), np.int64) if totals is None else totals
            np.add.at(totals, cluster, np.c_[np.ones(len(x), np.int64), x])
        if totals is not None:
            c, p = np.nonzero(totals[:, :1] + np.zeros_like(totals))
            yield to_batches(schema, [c, p - 1, totals[c, p]])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster; an empty one stays."""
    partial = state.select("x", "cluster").mapInArrow(_summed(len(centroids)), "cluster int, place int, total long")
    totals = np.zeros((len(centroids), centroids.shape[1] + 1), object)
    for cluster, place, total in partial.groupBy("cluster", "place").agg(F.sum("total")).collect():
        totals[cluster, place + 1] = total
    new = centroids.copy()
    for c, row in enumerate(totals):
        if row[0]:
            new[c] = [total // row[0] for total in row[1:]]
    return new


def _measured(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = _column(batch, "cluster").to_numpy()
            distance = squared(_matrix(_column(batch, "x"), np.int64), centroids[cluster]) if len(cluster) else []
            yield to_batches(schema, [_column(batch, "vec_id"), cluster, distance])

    return run


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Each kept vector with its cluster, distance and the clusters' sums; and the final centroids."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, size)
    first = first_centroids(kept, k)
    if not len(first):
        return spark.createDataFrame([], RESULT), first
    history, state = [first], kept
    for _ in range(rounds):
        new = stored(state.mapInArrow(tidy(_assigned(history)), STATE), "assigned")
        removed(state)
        state = new
        history.append(moved_centroids(state, history[-1]))
    last = stored(state.mapInArrow(tidy(_assigned(history)), STATE).select("vec_id", "x", "cluster").mapInArrow(_measured(history[-1]), "vec_id long, cluster int, distance long"), "measured")
    removed(state)
    sums = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    digests = {c: hashlib.sha256(",".join(map(str, history[-1][c].tolist())).encode()).hexdigest() for c, _ in sums}
    facts = spark.createDataFrame([(c, s, sum(s for _, s in sums), digests[c]) for c, s in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = last.join(F.broadcast(facts), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), history[-1]
