"""Operator 11: exact k-means over integer vectors by Shallot search.

Every vector keeps, from round to round, its centroid, the one that was second
nearest when it was last searched, a bound above its distance to the first and
a bound below its distance to all others.  In a round (``Centroids.assign``):

* the bounds are moved by how far the centroids went; where they still tell the
  nearest centroid, nothing is computed; then the distance to the own centroid
  is, which settles most of the rest;
* what is left starts from the closer one of its two remembered centroids and
  walks that one's neighbours, nearest first.  A neighbour beyond the sum of the
  distances to the start and to the second nearest so far can be neither, so
  the ball shrinks with each better one and the walk ends at its edge;
* the centroids met on the walk are compared by whole-number squared distances,
  ties by their number, so no rounding decides.

The bounds are doubles, widened by ``SLACK`` so that rounding errs on the side
of a search.  Each round is one pass of Arrow tasks over the written vectors of
the round before; tasks send one sum per centroid, which Spark adds up as
decimals; ``k * dims`` sums reach the driver, whatever the input.  No vector is
shuffled, so a centroid that holds a third of all vectors costs what others do.

Vectors of another length, and with a null or non-finite component, are left
out; a null array too.  A component x is floor(256 * x), held within 2**31 (x
within 8388608).  Distances and their sums that a long cannot hold count as the
largest long.  A null vec_id is hashed as ``null``; repeated rows are vectors of
their own; with fewer vectors than centroids there are as many centroids as
vectors; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import ship
from claimspark.plans.session import delete_path, save, scratch_path

DIMS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
SCALE, EDGE = 256, 1 << 31
SLACK = 1e-9
NARROW = 1 << 27  # components below it have squared distances that a long can hold
LONGEST = (1 << 63) - 1

STATE = "vec_id long, vector array<long>, cluster int, second int, upper double, lower double"


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number squared distances of rows; Python's integers (dtype object) where the rows are such."""
    diff = a - b
    return (diff * diff).sum(axis=1) if diff.dtype == object else np.einsum("ij,ij->i", diff, diff)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float))


@dataclass
class Centroids:
    """The centroids of a round, their neighbours by distance, and how far each came from the round before."""

    at: np.ndarray      # (k, dims), int64
    moved: np.ndarray   # (k,)

    def __post_init__(self):
        self.wide = len(self.at) > 0 and int(np.abs(self.at).max()) >= NARROW
        at = self.at.astype(object) if self.wide else self.at
        gap = np.array([_root(_squared(at, row)) for row in at]).reshape(len(at), len(at))
        self.order = np.argsort(gap, axis=1, kind="stable").astype(np.int32)
        # a centroid is its own first neighbour, also where another lies on the same point
        own = np.arange(len(at), dtype=np.int32)[:, None]
        self.order = np.hstack([own, self.order[self.order != own].reshape(len(at), -1)])
        self.gap = np.take_along_axis(gap, self.order.astype(np.int64), axis=1)
        self.half = self.gap[:, 1] / 2 if len(at) > 1 else np.full(len(at), np.inf)
        self.most = int(np.argmax(self.moved)) if len(at) else 0
        self.next_most = float(np.delete(self.moved, self.most).max()) if len(at) > 1 else 0.0

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, second, upper, lower, searched) after this round; ``searched`` counts the compared pairs."""
        wide = self.wide or (vectors.size and int(np.abs(vectors).max()) >= NARROW)
        x, at = (vectors.astype(object), self.at.astype(object)) if wide else (vectors, self.at)
        cluster, second = cluster.copy(), second.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = lower - np.where(cluster == self.most, self.next_most, self.moved[self.most]) * (1 + SLACK)
        if len(at) == 1:
            return cluster, second, upper, lower, 0
        lower = lower - np.abs(lower) * SLACK
        safe = np.maximum(lower, self.half[cluster] * (1 - SLACK))
        left = np.flatnonzero(~(upper < safe))
        own = _squared(x[left], at[cluster[left]])
        upper[left] = _root(own) * (1 + SLACK)
        open_ = ~(upper[left] < safe[left])
        searched = len(left) + int(open_.sum())
        left, own = left[open_], own[open_]
        if not len(left):
            return cluster, second, upper, lower, searched

        # the closer of the two remembered centroids is where the walk starts
        a, b = cluster[left], second[left]
        other = _squared(x[left], at[b])
        swap = (other < own) | ((other == own) & (b < a))
        best, near = np.where(swap, b, a), np.where(swap, other, own)
        next_, far = np.where(swap, a, b), np.where(swap, own, other)
        start, known, radius = best.copy(), next_.copy(), _root(near)
        walk = np.arange(len(left))
        for step in range(1, len(at)):
            inside = self.gap[start[walk], step] <= (radius[walk] + _root(far[walk])) * (1 + SLACK)
            walk = walk[inside]
            if not len(walk):
                break
            centre = self.order[start[walk], step]
            fresh = centre != known[walk]
            on, centre = walk[fresh], centre[fresh]
            d = _squared(x[left[on]], at[centre])
            searched += len(on)
            first = (d < near[on]) | ((d == near[on]) & (centre < best[on]))
            behind = ~first & (d < far[on])
            up = on[first]
            next_[up], far[up] = best[up], near[up]
            best[up], near[up] = centre[first], d[first]
            next_[on[behind]], far[on[behind]] = centre[behind], d[behind]
        cluster[left], second[left] = best, next_
        upper[left], lower[left] = _root(near) * (1 + SLACK), _root(far) * (1 - SLACK)
        return cluster, second, upper, lower, searched

    def distances(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to the own centroids, at most the largest long."""
        if self.wide or (vectors.size and int(np.abs(vectors).max()) >= NARROW):
            exact = _squared(vectors.astype(object), self.at[cluster].astype(object))
            return np.array([min(int(d), LONGEST) for d in exact], np.int64)
        return _squared(vectors, self.at[cluster])

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.at[c].tolist())).encode()).hexdigest()


def whole_vectors(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and vector (array of long): the rows whose array has ``dims`` finite components."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE - 1), x.cast("double") * SCALE))).cast("long")
    array = F.col("embedding")
    kept = embeddings.filter((F.size(array) == dims) & F.forall(array, finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(array, whole).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hash of seed and vec_id; equal hashes by the vectors themselves."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()  # k rows
    return np.array([r.vector for r in rows], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that have not been searched yet: bounds that tell nothing."""
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)),
             pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf))],
            ["vec_id", "vector", "cluster", "second", "upper", "lower"])


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                state = [batch.column(c).to_numpy() for c in range(2, 6)]
                *state, _ = shared.value.assign(_matrix(batch.column(1)), *state)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, state)], batch.schema.names)
    return run


def _sums(k: int, dims: int):
    """Each task's vectors of each centroid: how many, and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            if batch.num_rows:
                vectors, cluster = _matrix(batch.column(0)), batch.column(1).to_numpy()
                order = np.argsort(cluster, kind="stable")
                some, begin, size = np.unique(cluster[order], return_index=True, return_counts=True)
                # a batch's sum is below 2**31 * rows: no long overflows
                total[some] += np.add.reduceat(vectors[order], begin, axis=0).astype(object)
                n[some] += size
        has = np.flatnonzero(n)
        rows = [str(x) for c in has for x in total[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(has, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(has))),
             pa.array(np.repeat(n[has], dims)), pa.array(rows, pa.string())], ["cluster", "dim", "n", "total"])
    return run


def _next(state: DataFrame, now: Centroids) -> Centroids:
    """Every centroid that has vectors at the floor of their mean; the others stay."""
    k, dims = now.at.shape
    sums = (state.select("vector", "cluster").mapInArrow(_sums(k, dims), "cluster int, dim int, n long, total string")
            .groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    at = now.at.copy()
    for r in sums.collect():  # at most k * dims rows
        at[r.cluster, r.dim] = int(r.total) // r.n
    gone = _root(_squared(at.astype(object), now.at.astype(object)))
    return Centroids(at, gone)


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid: one row per kept vector."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = save(whole_vectors(embeddings, dims), "vectors")
    at = first_centroids(vectors, k, seed)
    if not len(at):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                              F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                              F.lit("").alias("centroid_sha256"), F.col("vector").alias("centroid"))
    now, state, written = Centroids(at, np.zeros(len(at))), vectors.mapInArrow(_start, STATE), None
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(now)  # k * (dims + 2 * k) numbers
        path = scratch_path(spark, "clusters")
        state.mapInArrow(_assigned(shared), STATE).write.parquet(path)
        if written is not None:
            delete_path(spark, written)  # the round before is not read any more
        written, state = path, spark.read.schema(STATE).parquet(path)
        if r < rounds:
            now = _next(state, now)

    shared = spark.sparkContext.broadcast(now)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = shared.value.distances(_matrix(batch.column(1)), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])
    out = save(state.select("vec_id", "vector", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long"), "distances")

    def held(total: Column) -> Column:
        return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    each = {r.cluster: r.total for r in each.collect()}  # at most k rows
    schema = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string, centroid array<long>"
    table = spark.createDataFrame([(c, t, sum(each.values()), now.digest(c), now.at[c].tolist()) for c, t in each.items()], schema)
    return out.join(F.broadcast(table), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", held(F.col("cluster_inertia")).alias("cluster_inertia"), held(F.col("inertia")).alias("inertia"),
        "centroid_sha256", "centroid")
