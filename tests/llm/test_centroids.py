"""Centroid clustering against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from revlens.llm import centroids
from revlens.llm.common import stored


def by_hand(rows, k, rounds):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of (vec_id, components)."""
    x = [[math.floor(64 * float(v)) for v in e] for _, e in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i]))
    centres = [list(x[i]) for i in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for v in x]

    for _ in range(rounds):
        near = nearest()
        for j in range(len(centres)):
            mine = [x[i] for i, (_, c) in enumerate(near) if c == j]
            if mine:
                centres[j] = [sum(column) // len(mine) for column in zip(*mine)]
    near = nearest()
    sums = [sum(d for d, c in near if c == j) for j in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((rows[i][0], c, d, sums[c], sum(sums), names[c]) for i, (d, c) in enumerate(near)), key=str)


def clusters(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "7 as x", "8 as cluster", "9 as far")
    return sorted((tuple(r) for r in centroids.clustered(df, **more)[0].collect()), key=str)


def vectors(n, size, seed, around=6, spread=0.5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(around, size))
    return [(i, (centres[i % around] + spread * r.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,rounds,spread", [(16, 3, 0.5), (5, 12, 1.0), (16, 0, 0.3), (7, 6, 0.05)])
def test_clusters_equal_plain_rounds(spark, k, rounds, spread):
    rows = vectors(400, 64, k, spread=spread)
    assert clusters(spark, rows, k=k, rounds=rounds) == by_hand(rows, k, rounds)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    r = random.Random(2)
    rows = [(i, [float(r.choice((-1, 0, 1))) / 64, float(r.choice((-1, 0, 1))) / 64]) for i in range(150)]  # nine places, 16 centroids
    assert clusters(spark, rows, size=2) == by_hand(rows, 16, 3)


def test_large_components_are_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-(2.0**20), 2.0**20) for _ in range(64)]) for i in range(120)]
    assert clusters(spark, rows, "double") == by_hand(rows, 16, 3)


def test_only_complete_finite_vectors_are_kept(spark):
    good = vectors(30, 64, 1)
    e = good[0][1]
    bad = [(100, None), (101, []), (102, e[:-1]), (103, [*e, 1.0]), (104, [None, *e[1:]]), (105, [math.nan, *e[1:]]), (106, [math.inf, *e[1:]]), (107, [-math.inf, *e[1:]])]
    more = [(5, good[5][1]), (None, good[3][1]), (None, good[9][1])]
    assert clusters(spark, good + bad + more) == by_hand(good + more, 16, 3)


def test_few_and_no_vectors(spark):
    few = vectors(3, 64, 4)
    assert clusters(spark, few) == by_hand(few, 16, 3)
    assert clusters(spark, []) == clusters(spark, [(1, [1.0])]) == []


def test_bounds_spare_most_distances():
    rows = vectors(3000, 64, 9, around=16, spread=0.3)
    x = np.floor(64 * np.array([e for _, e in rows])).astype(np.int64)
    history = [x[np.random.default_rng(1).permutation(len(x))[:16]]]
    b = centroids.Bounds.first(x, history[0])
    for _ in range(8):
        new = history[-1].copy()
        for c in range(16):
            if (b.cluster == c).any():
                new[c] = x[b.cluster == c].sum(axis=0) // (b.cluster == c).sum()
        history.append(new)
        b.computed = 0
        b.assign(history)
        assert (b.cluster == centroids.squared_to_all(x, new).argmin(axis=1)).all()
    assert b.computed < len(x) * 4


def test_total_displacement_is_the_tighter_bound():
    """A centroid that goes out and comes back loosens no bound."""
    x = np.array([[0, 0], [100, 0]])
    there, away = np.array([[1, 0], [99, 0]]), np.array([[40, 0], [60, 0]])
    b = centroids.Bounds.first(x, there)
    b.computed = 0
    b.assign([there, away, there])
    assert b.computed == 0 and b.cluster.tolist() == [0, 1]


def test_superseded_tables_are_removed(spark, tmp_path):
    kept = stored(spark.range(3), "kept")
    centroids.removed(kept)
    centroids.removed(spark.range(3))
    with pytest.raises(Exception, match="(?i)path|exist"):
        kept.count()
