"""Centroid clustering against plain rounds over all distances, and awkward tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, scale, seed=3):
    """Every distance of every round, in Python integers."""
    points = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"{seed}:{p[0]}".encode()).hexdigest(), p[0], p[1]))
    cents = [p for _, p in order[:k]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, p in points:
            groups.setdefault(near(p)[1], []).append(p)
        cents = [tuple(sum(x) // len(groups[i]) for x in zip(*groups[i])) if i in groups else c for i, c in enumerate(cents)]
    found = [(i, near(p)) for i, p in points]
    sums = [sum(d for _, (d, c) in found if c == i) for i in range(len(cents))]
    return sorted((i, c, d, sums[c], sum(sums), list(cents[c])) for i, (d, c) in found)


def got(df, **options):
    return sorted((r.vec_id, r.cluster, r.distance, int(r.cluster_inertia), int(r.inertia), r.centroid) for r in centroids.cluster(df, **options).collect())


@pytest.mark.parametrize(("k", "dims", "scale", "bounds"), [(5, 3, 8, None), (12, 6, 64, 4), (12, 6, 64, 11), (9, 2, 4, 1)])
def test_against_plain_rounds(spark, k, dims, scale, bounds):
    """Small scales make many ties; loose groups make vectors change sides in late rounds."""
    rng = random.Random(k + dims)
    middles = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [m + rng.gauss(0, 1) for m in rng.choice(middles)]) for i in range(400)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    options = {"k": k, "rounds": 7, "dims": dims, "scale": scale}
    assert got(df, bounds=bounds, **options) == plain(rows, k, 7, scale)


def test_bounds_hold_in_every_round():
    """Bounds never pass the true distances, and fewer distances are taken than a full scan takes."""
    rng = np.random.default_rng(2)
    k, kept = 20, 6
    points = (rng.normal(size=(3000, 8)) * 300 + rng.integers(0, 6, 3000)[:, None] * 400).astype(np.int64)
    cents = points[:k].copy()
    state = centroids.scan(points, cents, kept)
    whole, taken = centroids.squares, 0

    def counted(a, b):
        nonlocal taken
        taken += len(a)
        return whole(a, b)

    rounds = 0
    centroids.squares = counted
    try:
        for _ in range(12):
            counts, sums = centroids.tally(points, state[0], k)
            after = centroids.moved(cents, counts.tolist(), sums.ravel().tolist())
            drift = np.sqrt(whole(after, cents)) * (1 + 1e-12)
            cents = after
            *state, _ = centroids.advance(points, *state, cents, drift)
            rounds += 1
            true = np.column_stack([whole(points, c) for c in cents])
            assert (state[0] == true.argmin(axis=1)).all()
            roots = np.sqrt(true)
            at = np.arange(len(points))
            assert (state[1] >= roots[at, state[0]]).all()
            assert (state[3] <= np.take_along_axis(roots, state[2], axis=1)).all()
            roots[at, state[0]] = np.inf
            np.put_along_axis(roots, state[2], np.inf, axis=1)
            assert (state[4] <= roots.min(axis=1)).all()
    finally:
        centroids.squares = whole
    assert taken < 0.5 * rounds * len(points) * k


def test_awkward_vectors(spark):
    """What takes no part, fewer vectors than clusters, null and repeated ids, clashing columns, empty tables, no rounds."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e300, 1.0]), (8, []), (1, [0.25, 0.0]), (1, [0.25, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("cluster", "distance", "point", "id", "inertia")})
    kept = [(i, v) for i, v in rows if i == 1]
    assert got(df, k=8, rounds=10, dims=2, scale=4) == plain(kept, 8, 10, 4)
    assert got(df, k=2, rounds=0, dims=2, scale=4) == plain(kept, 2, 0, 4)
    assert [r.vec_id for r in centroids.cluster(spark.createDataFrame([(None, [1.0, 2.0])], SCHEMA), dims=2).collect()] == [None]
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = sorted(con.execute(centroids.ORACLE).fetchall())
    out = centroids.op12_centroids(spark, sf_dir)
    assert sorted(tuple(r) for r in out.collect()) == expected
