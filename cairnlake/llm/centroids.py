"""Clustering by centroids with adaptive distance bounds (exact Lloyd rounds, few distances).

Vectors are scaled to integers, so that distances, sums and ties are exact. Each vector keeps an upper bound of the distance
to its own centroid, lower bounds of the distances to its several nearest other centroids, and one remainder bound for all
others. When centroids move, bounds move with them; a vector whose own bound stays under every other keeps its centroid
unseen. Otherwise its own distance is taken exactly, then as many of the stored centroids as the bounds leave open are measured
anew, and only if even the remainder bound is open are all centroids scanned. How many bounds are kept shrinks to
what the last round needed. Bounds are rounded away from the distance, so nothing is certified that is not so.

A round is one pass over the table of vectors and bounds: Arrow batches come in, the next round's table goes out to the shared
folder. One row a batch also carries the batch's sums, so a round's new centroids come from one narrow column; only
centroids (clusters times dimensions) reach the driver. The table of the round before is deleted when the next is
written. Rounds end early when no centroid has moved, since nothing would change from then on.

Defined results: vectors that are null, of another length, or hold a null, a non-finite component or one whose integer has more
digits than squared distances can hold (2**27 and more in size for 64 components) take no part; the first centroids are the vectors with the
smallest hash of seed and id (a null id counts as empty text; ties by id, then by vector); with fewer vectors than clusters each is a
centroid; ties go to the smaller cluster; an empty cluster keeps its centroid; repeated rows are separate vectors; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

#: Relative slack of bounds: far over the rounding of a square root and of a round's sums.
SLACK = 1e-12


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    apart = points - centroids
    return np.einsum("ij,ij->i", apart, apart)


def over(square: np.ndarray) -> np.ndarray:
    """At least the square root."""
    return np.sqrt(square.astype(float)) * (1 + SLACK)


def under(square: np.ndarray) -> np.ndarray:
    """At most the square root."""
    return np.sqrt(square.astype(float)) * (1 - SLACK)


def scan(points: np.ndarray, centroids: np.ndarray, kept: int) -> tuple:
    """Nearest centroid by all distances, with fresh bounds: cluster, upper, near, low, rest."""
    to_all = np.column_stack([squares(points, c) for c in centroids])
    order = np.argsort(to_all, axis=1, kind="stable")
    ranked = np.take_along_axis(to_all, order, axis=1)
    rest = under(ranked[:, kept + 1]) if kept + 1 < len(centroids) else np.full(len(points), np.inf)
    return order[:, 0], over(ranked[:, 0]), order[:, 1 : kept + 1], under(ranked[:, 1 : kept + 1]), rest


def advance(points, cluster, upper, near, low, rest, centroids, drift) -> tuple:
    """The state after centroids moved by ``drift`` at most to ``centroids``, and how many stored bounds were needed.

    Rows are changed in copies; what is certified is left, what is open is measured."""
    cluster, near = cluster.copy(), near.copy()
    kept = near.shape[1]
    upper = (upper + drift[cluster]) * (1 + SLACK)
    low = low - drift[near] - SLACK * (np.abs(low) + drift[near])
    rest = rest - drift.max() - SLACK * (np.where(np.isfinite(rest), rest, 0) + drift.max())
    # open_from[:, i]: the least bound of what is not among the first i stored centroids
    bounds = np.column_stack([low, rest])
    open_from = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    rows = np.flatnonzero(upper >= open_from[:, 0])
    own = squares(points[rows], centroids[cluster[rows]])
    upper[rows] = over(own)
    still = upper[rows] >= open_from[rows, 0]
    rows, own = rows[still], own[still]
    if not len(rows):
        return cluster, upper, near, low, rest, 0
    depth = 1 + (upper[rows, None] >= open_from[rows, 1:]).sum(axis=1)  # open_from grows with i, so this counts a prefix
    whole = rows[depth > kept]
    part, own, depth = rows[depth <= kept], own[depth <= kept], depth[depth <= kept]
    if len(part):
        # columns: own centroid, then the stored ones; those not measured lose every comparison
        names = np.column_stack([cluster[part], near[part]])
        found = np.full(names.shape, np.iinfo(np.int64).max)
        found[:, 0] = own
        for j in range(int(depth.max())):
            some = np.flatnonzero(depth > j)
            found[some, j + 1] = squares(points[part[some]], centroids[near[part[some], j]])
        limits = np.column_stack([np.zeros(len(part)), low[part]])
        measured = found < np.iinfo(np.int64).max
        limits[measured] = under(found[measured])
        best = np.lexsort((names, found), axis=1)[:, 0]
        at = np.arange(len(part))
        cluster[part], upper[part] = names[at, best], over(found[at, best])
        names[at, best], limits[at, best] = names[:, 0], limits[:, 0]
        order = np.argsort(limits[:, 1:], axis=1)
        near[part] = np.take_along_axis(names[:, 1:], order, axis=1)
        low[part] = np.take_along_axis(limits[:, 1:], order, axis=1)
    if len(whole):
        cluster[whole], upper[whole], near[whole], low[whole], rest[whole] = scan(points[whole], centroids, kept)
    return cluster, upper, near, low, rest, kept if len(whole) else int(depth.max())


def narrowed(near, low, rest, kept: int) -> tuple:
    """Only the first ``kept`` bounds; the others join the remainder."""
    if kept >= near.shape[1]:
        return near, low, rest
    return near[:, :kept], low[:, :kept], np.minimum(rest, low[:, kept:].min(axis=1))


def tally(points: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact component sums of each cluster's vectors."""
    total = np.zeros((k, points.shape[1]), np.int64)
    np.add.at(total, cluster, points)
    return np.bincount(cluster, minlength=k), total


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), -1 if len(column) else 0)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def once(n: int, value: list, kind: pa.DataType) -> pa.Array:
    """A column whose first row alone has a value."""
    return pa.array([value] + [None] * (n - 1), pa.list_(kind))


def round_of(centroids: np.ndarray, drift: np.ndarray | None, kept: int):
    """The pass of a round over batches (id, point[, cluster, upper, near, low, rest]); without ``drift`` the first one."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("point"))
            if drift is None:
                *state, needed = (*scan(points, centroids, kept), kept)
            else:
                numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest")]
                near, low = matrix(batch.column("near")), matrix(batch.column("low"), float)
                bounds = narrowed(near.reshape(len(points), -1), low.reshape(len(points), -1), numbers[2], kept)
                *state, needed = advance(points, numbers[0].astype(np.int64), numbers[1], *bounds, centroids, drift)
            cluster, upper, near, low, rest = state
            counts, sums = tally(points, cluster, k)
            n = len(points)
            columns = [batch.column("id"), batch.column("point"), pa.array(cluster, pa.int32()), pa.array(upper), lists(near, pa.int32()), lists(low, pa.float64()), pa.array(rest)]
            columns += [once(n, counts.tolist(), pa.int64()), once(n, sums.ravel().tolist(), pa.int64()), pa.array([needed] + [None] * (n - 1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "point", "cluster", "upper", "near", "low", "rest", "counts", "sums", "needed"])

    return run


def last_pass(centroids: np.ndarray, drift: np.ndarray, kept: int):
    """The last assignment, with exact distances and each batch's sums of them."""
    k = len(centroids)
    assign = round_of(centroids, drift, kept)

    def run(batches):
        for batch in assign(batches):
            cluster = batch.column("cluster").to_numpy().astype(np.int64)
            distance = squares(matrix(batch.column("point")), centroids[cluster])
            # a sum of long values may not fit into one: sums of halves of the bits always do
            parts = [[int(x) for half in (distance >> 31, distance & 0x7FFFFFFF) for x in np_sums(half, cluster, k)]]
            found = pa.array(parts + [None] * (len(distance) - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(distance), found], names=["id", "cluster", "distance", "inertias"])

    return run


def np_sums(values: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(k, np.int64)
    np.add.at(total, cluster, values)
    return total


def added(table: DataFrame, column: str) -> list[int]:
    """Position by position, the exact sums of the lists that a table's batches carry."""
    lists_of = table.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "n"))
    rows = lists_of.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return [int(r.n) for r in sorted(rows, key=lambda r: r.at)]


def moved(centroids: np.ndarray, counts: list[int], sums: list[int]) -> np.ndarray:
    """Floored means; empty clusters keep their centroid."""
    dims = centroids.shape[1]
    rows = [[s // n for s in sums[i * dims : (i + 1) * dims]] if n else centroids[i].tolist() for i, n in enumerate(counts)]
    return np.array(rows, np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3, bounds: int | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each vector that takes part; distances are squared, in scaled units.

    ``bounds``: stored lower bounds a vector at first (at least one, fewer than the other centroids; a quarter of k plus one by default)."""
    spark = vectors.sparkSession
    most = isqrt((1 << 62) // dims) // 2
    base = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).where(F.size("v") == dims)
    as_double = F.transform("v", lambda x: x.cast("double") * scale)
    fits = F.forall("scaled", lambda x: x.isNotNull() & (F.abs(x) < most))  # NaN is above every number
    points = base.select("id", as_double.alias("scaled")).where(F.coalesce(fits, F.lit(False))).select("id", F.transform("scaled", lambda x: F.floor(x).cast("int")).alias("point"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.orderBy(digest, "id", "point").limit(k).collect()
    fields = [vectors.schema[id_col], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    ends = [T.StructField(c, T.DecimalType(38, 0)) for c in ("cluster_inertia", "inertia")] + [T.StructField("centroid", T.ArrayType(T.LongType()))]
    if not first:
        return spark.createDataFrame([], T.StructType(fields + ends))

    centroids = np.array([r.point for r in first], np.int64)
    kept = min(len(first) - 1, max(1, bounds or len(first) // 4 + 1))
    id_type = points.schema["id"].dataType.simpleString()
    state_schema = f"id {id_type}, point array<int>, cluster int, upper double, near array<int>, low array<double>, rest double, counts array<bigint>, sums array<bigint>, needed int"
    state, drift = points, None
    for n in range(rounds):
        before, state = state, materialize(state.select(*state.columns[:7]).mapInArrow(round_of(centroids, drift, kept), state_schema), f"centroids-{n}")
        if n:
            release(before)
        after = moved(centroids, added(state, "counts"), added(state, "sums"))
        needed = state.agg(F.max("needed")).first()[0]
        kept = min(kept, max(1, needed))
        drift = over(squares(after, centroids))
        settled = np.array_equal(after, centroids)
        centroids = after
        if settled:
            break
    if drift is None:
        state = materialize(points.mapInArrow(round_of(centroids, None, kept), state_schema), "centroids")
        drift = np.zeros(len(centroids))
    end_schema = f"id {id_type}, cluster int, distance bigint, inertias array<bigint>"
    done = materialize(state.select(*state.columns[:7]).mapInArrow(last_pass(centroids, drift, kept), end_schema), "clusters")
    release(state)
    halves = added(done, "inertias")
    inertias = [(halves[i] << 31) + halves[len(first) + i] for i in range(len(first))]
    summary = spark.createDataFrame([(i, Decimal(s), Decimal(sum(inertias)), c) for i, (s, c) in enumerate(zip(inertias, centroids.tolist()))], T.StructType([fields[1], *ends]))
    return done.join(F.broadcast(summary), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Contract: 8 clusters, 10 rounds, seed 3, over every vector of 64 finite components."""
    out = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return out.select("vec_id", "cluster", "distance", F.expr("try_cast(cluster_inertia AS bigint)").alias("cluster_inertia"), F.expr("try_cast(inertia AS bigint)").alias("inertia"), F.sha2(text, 256).alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain rounds over all distances, one common table expression a step."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT rid, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM kept)",
        f"firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM kept QUALIFY cluster < {k})",
        f"c0 AS MATERIALIZED (SELECT cluster, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM firsts)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT rid, cluster, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS distance FROM p JOIN c{n} c USING (i) GROUP BY rid, cluster)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, cluster, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (rid) GROUP BY cluster, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{n} c LEFT JOIN m{n} m ON c.cluster = m.cluster AND c.i = m.i)")
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (rid) JOIN h USING (cluster)"


ORACLE = oracle()
