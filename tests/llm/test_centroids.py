"""Operator 11 against k-means in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import centroids as K
from claimspark.llm.queries import op11_centroid_clustering

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k, rounds, dims, seed=K.SEED):
    kept = [(i, [max(-K.EDGE, min(K.EDGE - 1, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = [(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept]
    centres = [list(v) for _, v in sorted(hashed)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found, total = assign(), Counter()
    for d, c in found:
        total[c] += d
    held = lambda x: min(x, K.LONGEST)
    return Counter((i, c, held(d), held(total[c]), held(sum(total.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, found))


def frame(spark, rows, parts=4):
    schema = "vec_id long, embedding array<float>, label int, cluster string, vector string, distance string"
    return spark.createDataFrame([(i, v, 0, "c", "v", "d") for i, v in rows], schema).repartition(parts)


def got(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("k", [1, 2, 7, 30])
def test_clusters_equal_plain_k_means(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=6) / 8 + rng.integers(0, 4) / 6).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25] * 6) for i in range(150)]                       # one point, many times
    rows += [rows[3], rows[3], (5, [0.5] * 6), (None, [0.1] * 6), (None, [0.1] * 6)]
    rows += [(2000 + i, [i % 2 / 256.0] * 6) for i in range(40)]                # ties between lattice points
    rows += [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 7), (6, [1.0] * 5 + [None]), (7, [1.0] * 5 + [float("nan")]),
             (8, [float("-inf")] + [1.0] * 5)]
    rows = floats(rows)
    assert got(K.cluster(frame(spark, rows), k=k, rounds=4, dims=6)) == plain(rows, k, 4, 6)


def test_far_vectors_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = floats([(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 39)).tolist()) for i in range(80)])
    assert got(K.cluster(frame(spark, rows), k=9, rounds=3, dims=3)) == plain(rows, 9, 3, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = floats([(3, [0.5, -0.5]), (1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert got(K.cluster(frame(spark, rows), k=40, rounds=2, dims=2)) == plain(rows, 40, 2, 2)
    for none in ([], [(1, None)]):
        out = K.cluster(frame(spark, none), k=4, rounds=2, dims=2)
        assert out.count() == 0 and out.columns == [*COLUMNS, "centroid"]


def test_query_equals_plain_k_means(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(op11_centroid_clustering(spark, folder)) == plain(rows, 40, 5, 64)


def test_search_skips_most_pairs():
    """Bounds and balls spare most of the distances once centroids move little, and never change the answer."""
    rng = np.random.default_rng(1)
    centres = (rng.normal(size=(40, 8)) * 900).astype(np.int64)
    x = (centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 8)) * 30).astype(np.int64)
    n = len(x)
    state = (np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf))
    now, gone = centres, np.zeros(40)
    for step in range(5):
        *state, searched = K.Centroids(now, gone).assign(x, *state)
        exact = ((x[:, None, :] - now[None]) ** 2).sum(axis=2)
        assert (exact.argmin(axis=1) == state[0]).all()
        second = np.sort(exact, axis=1)[:, 1]
        assert (np.sqrt(exact.min(axis=1)) <= state[2]).all() and (np.sqrt(second) >= state[3]).all()
        assert searched < n * 40 * (1 if step == 0 else 0.1)  # at first nothing is remembered
        moved = now + rng.integers(-9, 10, now.shape)
        now, gone = moved, np.sqrt(((moved - now) ** 2).sum(axis=1))


def test_state_is_bounded_and_unshuffled(spark):
    rows = floats([(i, [i / 100, 0.0]) for i in range(100)])
    plan = K.cluster(frame(spark, rows), k=5, rounds=2, dims=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
