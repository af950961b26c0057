"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks. In a block every dimension has a list of the candidates sorted by that
component. A query walks all lists at once, from the top where its own component is positive and
from the bottom where it is negative, scores each candidate it meets for the first time in full, and stops
when the score that the components at the current depth would give (no unseen candidate can have
more) falls below its k-th best score. Equal bounds do not stop it, so ties to smaller ids stay exact. One
block is searched first: its k-th best scores are floors for all other blocks, below which nothing is scored,
kept or sent. The k best of all blocks are merged per query.

Components x become the integers floor(scale * x), within the range of a long; scores are exact integers, cut to that
range. Defined results: null vectors, vectors with null or non-finite components and rows with a null id take no part;
shorter vectors count as padded with zeros; a query has fewer rows if there are fewer candidates; rows that share an id
are separate candidates and separate queries, each with a list of its own (a query never meets rows with its own id, and
repeated queries get the same list each); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Candidates in a block and queries in a block: bounds the memory of a task, not the work done.
CANDIDATES, QUERIES = 8192, 2048
#: List entries that are read between two looks at the bound; doubles from look to look.
STEP = 16


#: Scores up to it are exact in float64.
EXACT = float(1 << 53)


def threshold_topk(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
    """For each query (ids, scores) of its k best rows of block, without rows below its floor. Components are integers;
    where their products could pass what float64 holds exactly, Python's integers count."""
    n, dims = block.shape
    top = lambda m: float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0
    kind = np.float64 if top(block) * top(queries) * max(dims, 1) < EXACT else object
    if n and dims:
        order = np.argsort(block, axis=0, kind="stable").astype(np.int32)
        lists = np.ascontiguousarray(order.T)
        values = np.ascontiguousarray(np.take_along_axis(block, order, axis=0).T).astype(kind)
    block = block.astype(kind)
    for nth, (own, q) in enumerate(zip(query_ids, queries.astype(kind))):
        floor = None if floors is None else floors[nth]
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0, kind)
            continue
        active = np.flatnonzero(q)
        up = q[active] > 0
        seen = ids == own
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
        depth, step = 0, STEP
        while depth < n:
            to = min(n, depth + step)
            if len(active):
                fresh = np.zeros(n, bool)
                fresh[lists[active[up], n - to : n - depth].ravel()] = True
                fresh[lists[active[~up], depth:to].ravel()] = True
                fresh &= ~seen
            else:
                to, fresh = n, ~seen
            at = np.flatnonzero(fresh)
            if len(at):
                seen[at] = True
                got = block[at] @ q
                if kind is object:
                    got = np.clip(got, -(1 << 63), (1 << 63) - 1)
                if floor is not None:
                    good = got >= floor
                    at, got = at[good], got[good]
                best_ids, best = np.concatenate([best_ids, ids[at]]), np.concatenate([best, got])
                if len(best) > 4 * k:
                    edge = np.partition(best, len(best) - k)[len(best) - k]
                    best_ids, best = best_ids[best >= edge], best[best >= edge]
                rank = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[rank], best[rank]
                if len(best) == k:
                    floor = best[-1] if floor is None else max(floor, best[-1])
            depth, step = to, step * 2
            if depth < n and floor is not None:
                edge = np.where(up, values[active, n - depth], values[active, depth - 1])
                if edge @ q[active] < floor:
                    break
        yield best_ids, best


def block_search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            ids, block = matrix(candidates)
            qids, qs = matrix(queries)
            dims = max(block.shape[1], qs.shape[1])
            block, qs = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (block, qs))
            floors = queries.column("floor").to_numpy() if queries.column("floor").null_count == 0 else None
            for own, which, (got, score) in zip(qids, queries.column("h").to_pylist(), threshold_topk(ids, block, qids, qs, k, floors)):
                out["query_id"].append(np.full(len(got), own))
                out["query_hash"].append(np.full(len(got), which, np.int64))
                out["vec_id"].append(got)
                out["score"].append(score.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors as rows of integers, padded with zeros."""
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy()
    dims = int(lengths.max()) if len(lengths) else 0
    if (lengths == dims).all():
        return ids, flat.reshape(len(ids), dims)
    out = np.zeros((len(ids), dims), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(x) for x in lengths])] = flat
    return ids, out


FOUND = "query_id long, query_hash long, vec_id long, score long"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 20, query_modulus: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose id is divisible by query_modulus, against all other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v")).where(F.col("id").isNotNull() & F.col("_v").isNotNull())
    rows = rows.where(F.forall("_v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    rows = rows.select("id", F.transform("_v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    # equal query rows are searched once and answered as often as they stand in the table
    asked = rows.where(F.col("id") % query_modulus == 0).groupBy("id", F.xxhash64("v").alias("h"), "v").agg(F.count("*").alias("times"))
    asked = asked.select(*[F.col(c).alias(c) for c in ("id", "h", "v", "times")])
    counts = vectors.agg(F.count("*").alias("n"), F.sum((F.col(id_col) % query_modulus == 0).cast("long")).alias("q")).first()
    c_blocks = max(1, -(-counts["n"] // CANDIDATES))
    q_blocks = max(1, -(-(counts["q"] or 0) // QUERIES))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int"))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id", "h"), F.lit(q_blocks)).cast("int"))

    def searched(first: int, last: int, floors: DataFrame | None) -> DataFrame:
        """Every block of queries meets the blocks of candidates from first to last."""
        cands = rows.where(F.col("c").between(first, last)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        floor = F.lit(None).cast("long").alias("floor")
        asks = asked.select("id", "h", "v", "q", floor)
        if floors is not None:
            known = floors.select(F.col("query_id").alias("id"), F.col("query_hash").alias("h"), F.col("score").alias("floor"))
            asks = asks.drop("floor").join(known, ["id", "h"], "left").withColumn("floor", F.coalesce("floor", F.lit(-(1 << 63))))
        asks = asks.withColumn("c", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return cands.groupBy("c", "q").cogroup(asks.groupBy("c", "q")).applyInArrow(block_search(k), FOUND)

    if c_blocks == 1:
        best = best_of(searched(0, 0, None), k)
    else:
        ahead = materialize(best_of(searched(0, 0, None), k), "first-block")
        best = best_of(ahead.drop("rank").unionByName(searched(1, c_blocks - 1, ahead.where(F.col("rank") == k))), k)
    times = asked.where("times > 1").select(F.col("id").alias("query_id"), F.col("h").alias("query_hash"), "times")
    best = best.join(times, ["query_id", "query_hash"], "left").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return best.select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Contract: 20 best by integer inner product of floor(64 * x), queries are ids divisible by 20."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.nth, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""
