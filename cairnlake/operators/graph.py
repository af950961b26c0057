"""Edges between records: co-recall, shared sources, degrees, adjacency, communities."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GRAPH, TOPICS
from ..sources.scratch import dropped, written


def co_recall(log: DataFrame, set_cols: list[str], id_col: str, step: float = GRAPH.corecall_step, most: float = GRAPH.most_weight) -> DataFrame:
    """Edges (from_id, to_id, weight), both directions, between ids that a set holds; ``step`` a set, ``most`` at most.

    Sets are one user's records of one day; the pairs of a set are the operator's result."""
    rows = log.select(*set_cols, F.col(id_col).alias("id")).distinct()
    pairs = rows.withColumnRenamed("id", "from_id").join(rows.withColumnRenamed("id", "to_id"), set_cols).where("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.least(F.lit(most), F.lit(step) * F.count("*")).alias("weight"))


def derived_from(sources: DataFrame, above: float) -> DataFrame:
    """Edges both ways between ids whose sets of source keys have a Jaccard similarity over ``above``. sources: id, key."""
    rows = sources.distinct()
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    # each pair once and without sizes while it is counted: rows of the aggregation are as few and as short as can be
    pairs = rows.select("key", F.col("id").alias("u")).join(rows.select("key", F.col("id").alias("v")), "key").where("u < v")
    got = pairs.groupBy("u", "v").agg(F.count("*").alias("both"))
    got = got.join(sizes.select(F.col("id").alias("u"), F.col("n").alias("a")), "u").join(sizes.select(F.col("id").alias("v"), F.col("n").alias("b")), "v")
    got = got.withColumn("weight", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).where(F.col("weight") > above)
    ends = F.explode(F.array(F.struct(F.col("u").alias("from_id"), F.col("v").alias("to_id")), F.struct(F.col("v").alias("from_id"), F.col("u").alias("to_id"))))
    return got.select(ends.alias("e"), "weight").select("e.from_id", "e.to_id", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): incident edges, in and out."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def decay_edges(edges: DataFrame, factor: float = GRAPH.monthly_decay, edge_type: str | None = None) -> DataFrame:
    mine = F.lit(True) if edge_type is None else F.col("edge_type") == edge_type
    return edges.withColumn("weight", F.when(mine, F.col("weight") * factor).otherwise(F.col("weight")))


def adjacency(edges: DataFrame, above: float = TOPICS.edge_above) -> DataFrame:
    """Undirected (u, v, weight), u < v: edges over the bound, summed over types (1 at most), larger direction."""
    kept = edges.where((F.col("from_id") != F.col("to_id")) & (F.col("weight") > above))
    one_way = kept.groupBy("from_id", "to_id").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))
    return one_way.groupBy(F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v")).agg(F.max("weight").alias("weight"))


def vector_adjacency(vectors: DataFrame, above: float = TOPICS.edge_above, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384) -> DataFrame:
    """Exact pairs (u, v, weight), u < v, with a cosine over the bound: blocks of rows against blocks of rows.

    Every row goes to the block pairs of its block, at least eight blocks if there are rows enough; a task holds two blocks and multiplies them as
    matrices, some rows at a time."""
    dealt = block_pairs(vectors, id_col, vector_col, block)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(near_in_blocks(pdf, above))
        if not found:
            return pd.DataFrame({"u": [], "v": [], "weight": []})
        return pd.DataFrame(dict(zip(("u", "v", "weight"), map(np.concatenate, zip(*found)))))

    return dealt.groupBy("x", "y").applyInPandas(pairs, "u long, v long, weight double")


def block_pairs(vectors: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(id, v, b, x, y): every row for each pair (x, y) of blocks that its block b is part of. Vectors of floats move as such."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v")).where("v is not null")
    n = vectors.count()
    blocks = max(1, -(-n // block), min(8, n // 1024))
    spread = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y")))
    return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("id", "v", "b", F.explode(spread).alias("p")).select("id", "v", "b", "p.x", "p.y")


def near_in_blocks(pdf: pd.DataFrame, above: float):
    """(u, v, weight), u < v, of the rows of one pair of blocks, some rows at a time."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    left, right = pdf[pdf["b"] == x], pdf[pdf["b"] == y]
    if left.empty or right.empty:
        return
    unit = lambda t: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack(t["v"].to_numpy()).astype(np.float64))
    first, second = unit(left), unit(right)
    mine, theirs = left["id"].to_numpy(), right["id"].to_numpy()
    for lo in range(0, len(first), 512):
        sims = first[lo : lo + 512] @ second.T
        i, j = np.nonzero(sims > above)
        a, b = mine[lo + i], theirs[j]
        keep = a < b if x == y else a != b
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep], np.minimum(1.0, sims[i, j][keep])


#: Directed edges that a task holds before it passes them on as lists, and vectors over which the density of the graph is guessed.
PACKED, GUESSED = 1 << 22, 2000


def vector_communities(vectors: DataFrame, above: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384, few: int = 8192, max_passes: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """``louvain`` over ``vector_adjacency``, with equal results.

    The edges grow with the square of the vectors, so beyond ``few`` vectors they are never a table: the tasks that find them pass them on as lists of
    neighbours (8 bytes an end), which move once and stay. As moves depend on no component but a node's own, all nodes move over the lists."""
    nodes = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"))
    size = nodes.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).first()
    n = size["n"]
    if not few < n <= STATE_NODES or size["ids"] < n:
        return louvain(vector_adjacency(vectors, above, id_col, vector_col, block), max_passes, tolerance)
    sc = vectors.sparkSession.sparkContext
    found = nodes.select("id", F.xxhash64("id").alias("hash")).toArrow()
    ids, hashes = found.column("id").to_numpy(), found.column("hash").to_numpy()
    order = np.argsort(ids)
    ids, hashes = ids[order], hashes[order]
    shared = sc.broadcast((ids, hashes))
    sample = [r[0] for r in vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>")).sample(min(1.0, 1.5 * GUESSED / n), 5).limit(GUESSED).collect()]
    m = np.array(sample)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    parts = max(2 * sc.defaultParallelism, int((m @ m.T > above).mean() * n * n / LISTED) + 1)

    def packed(pieces: list) -> pa.RecordBatch:
        u, v, weight = (np.concatenate(c) for c in zip(*pieces))
        u, v, pull = np.searchsorted(shared.value[0], u).astype(np.int32), np.searchsorted(shared.value[0], v).astype(np.int32), np.floor(weight * UNITS + 0.5).astype(np.int32)
        node = np.concatenate([u, v])
        order = np.argsort(node, kind="stable")
        node, near, pull = node[order], np.concatenate([v, u])[order], np.concatenate([pull, pull])[order]
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        offsets = pa.array(np.append(begin, len(node)), pa.int32())
        row = node[begin]
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(shared.value[1][row]), pa.ListArray.from_arrays(offsets, pa.array(near)), pa.ListArray.from_arrays(offsets, pa.array(pull))], names=["node", "hash", "near", "pull"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in near_in_blocks(pa.Table.from_batches(list(batches)).to_pandas(), above):
            held.append(piece)
            size += 2 * len(piece[0])
            if size > PACKED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    lists = block_pairs(vectors, id_col, vector_col, block).groupBy("x", "y").applyInArrow(run, "node int, hash long, near array<int>, pull array<int>")
    return moves_over_lists(lists.repartition(parts, "node"), ids, None, max_passes, tolerance)


def are_stars(edges: DataFrame) -> bool:
    """Whether in edges (u, v), u < v, no id is on both sides and every v has one u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("v")), F.struct(F.col("v").alias("id"), F.lit(1).alias("v")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.v").alias("tips"), F.min("e.v").alias("least")).where("tips > 1 or (tips = 1 and least = 0)").isEmpty()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least id, id) of the components of some edges: as many as they have nodes that are not the least."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    tip = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[tip]], ids[tip]


def task_stars(batches):
    """Edges of a task as stars, which connect the same ids; a task holds no more than its nodes and STARRED edges."""
    held, size, tips = [], 0, 0

    def shrunk() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate(c) for c in zip(*held)))

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size > STARRED + 2 * tips:
            held = [shrunk()]
            size = tips = len(held[0][0])
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in shrunk()], names=["u", "v"])


def connected(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, comp), comp the smallest id reachable over pairs (u, v); small results cut the lineage in every round.

    Rounds go on until every component is a star; with a limit, running out of it is an error."""
    edges = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if dict(edges.dtypes)["u"] == "bigint":
        edges = edges.mapInArrow(task_stars, "u long, v long")
    edges = written(edges.distinct())
    for done in count():
        if are_stars(edges):
            break
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(large.join(least, "a").select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v")).where("u < v").distinct())
    return edges.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct())


#: Edges that a task gathers before it turns them into stars.
STARRED = 1 << 20
#: Edges of a component whose nodes move over arrays in one task. Larger components move over lists of neighbours in many tasks, if they have up to
#: STATE_NODES nodes together (their communities, 12 bytes each, go to every task), else by joins. All give the same communities.
WALK_EDGES, STATE_NODES = 2_000_000, 1 << 20
#: Directed edges of a task of lists, and the neighbours in a row of them.
LISTED, NEIGHBOURS = 1 << 21, 1 << 15
#: Classes of nodes that move in turn, and the units of an edge of weight 1: weights are whole numbers, so sums do not depend on their order.
CLASSES, UNITS = 16, 1 << 24


def louvain(pairs: DataFrame, max_passes: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """Communities (id, community = smallest id of it) by one phase of modularity moves.

    In a pass the nodes move in CLASSES turns; a hash of the id, shifted by the pass, says in which. All nodes of a turn see the state
    before it and go to the neighbouring community that gains most (the one founded by the smallest id among equals), if it gains
    more than where they are. Few neighbours share a turn, and in the next pass they are dealt anew. (Turns by a colouring of the graph
    would be as many as the nodes of its largest clique.) Passes end when no node of a component moves.

    A move depends only on a node's neighbours, their communities and the total weight, so components are independent once the
    total is known: those of up to WALK_EDGES edges are one group each, larger ones move over lists of neighbours or by joins, with equal results.
    Pairs that hold a null, or a node twice, do not count; of pairs given twice the larger weight does."""
    pairs = pairs.where("u <> v and weight is not null").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("weight").alias("weight"))
    pairs = written(pairs.select("u", "v", F.round(F.col("weight") * UNITS).cast("long").alias("weight")))
    whole = 2.0 * float(pairs.agg(F.sum("weight")).first()[0] or 0)
    comps = written(connected(pairs))
    placed = pairs.join(comps.withColumnRenamed("id", "u"), "u")
    large = written(placed.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > WALK_EDGES).select("comp"))
    hashed = lambda df: df.withColumns({"u_hash": F.xxhash64("u"), "v_hash": F.xxhash64("v")})
    small = hashed(placed.join(large, "comp", "left_anti")).groupBy("comp").applyInArrow(array_moves(whole, max_passes, tolerance), "id long, community long")
    if large.isEmpty():
        return small
    rest, nodes = placed.join(large, "comp", "left_semi"), comps.join(large, "comp", "left_semi").select("id")
    if nodes.count() <= STATE_NODES:
        return small.unionByName(listed_moves(rest, nodes, whole, max_passes, tolerance))
    return small.unionByName(joined_moves(hashed(rest), whole, max_passes, tolerance))


def best_moves(source: np.ndarray, to: np.ndarray, pull: np.ndarray, nodes: np.ndarray, home: np.ndarray, degree: np.ndarray, load: np.ndarray, whole: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in nodes, goals) of the nodes that move in a turn. Edges: source (a place in nodes), to (a community), pull; nodes: home and degree of each."""
    n = len(load)
    keys = np.concatenate([source * n + to, np.arange(len(nodes)) * n + home])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(begin):
        return begin, begin
    sums = np.add.reduceat(np.concatenate([pull, np.zeros(len(nodes), np.int64)])[order], begin)
    node, goal = keys[begin] // n, keys[begin] % n
    stays = goal == home[node]
    rest = load[goal] - np.where(stays, degree[node], 0)
    gain = np.floor((sums.astype(float) - rest.astype(float) * degree[node].astype(float) / whole) / step + 0.5).astype(np.int64)
    rank = np.lexsort((goal, -gain, node))
    best = rank[np.r_[True, node[rank][1:] != node[rank][:-1]]]
    now = np.zeros(len(nodes), np.int64)
    now[node[stays]] = gain[stays]
    goes = best[gain[best] > np.maximum(now[node[best]], 0)]
    return node[goes], goal[goes]


def moved_loads(home: np.ndarray, load: np.ndarray, nodes: np.ndarray, goals: np.ndarray, degree: np.ndarray) -> None:
    """Moves nodes of these degrees to their goals."""
    np.subtract.at(load, home[nodes], degree)
    np.add.at(load, goals, degree)
    home[nodes] = goals


def array_moves(whole: float, passes: int, tolerance: float):
    """Moves of one component over arrays: a turn's edges are summed by (node, community) at once."""
    step = tolerance * UNITS

    def run(group: pa.Table) -> pa.Table:
        heads, tails, weight, first, second = (group.column(c).to_numpy() for c in ("u", "v", "weight", "u_hash", "v_hash"))
        ids, index, place = np.unique(np.concatenate([heads, tails]), return_index=True, return_inverse=True)
        n = len(ids)
        hashes = np.concatenate([first, second])[index]
        source, target = place, np.concatenate([place[len(heads) :], place[: len(heads)]])
        pull = np.concatenate([weight, weight])
        degree = np.zeros(n, np.int64)
        np.add.at(degree, source, pull)
        home, load, spot = np.arange(n), degree.copy(), np.zeros(n, np.int64)
        for turn in range(passes if whole > 0 else 0):
            moved = False
            classes = (hashes >> (2 * turn)) & (CLASSES - 1)
            order = np.argsort(classes[source], kind="stable")
            border = np.searchsorted(classes[source][order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                mine, near = np.flatnonzero(classes == c), order[border[c] : border[c + 1]]
                spot[mine] = np.arange(len(mine))
                goes, goals = best_moves(spot[source[near]], home[target[near]], pull[near], mine, home[mine], degree[mine], load, whole, step)
                if len(goes):
                    moved = True
                    moved_loads(home, load, mine[goes], goals, degree[mine[goes]])
            if not moved:
                break
        least = np.full(n, n)
        np.minimum.at(least, home, np.arange(n))
        return pa.table({"id": ids, "community": ids[least[home]]})

    return run


def neighbour_lists(pairs: DataFrame, ids: np.ndarray, hashes: np.ndarray) -> DataFrame:
    """(node, hash, near, pull): places in ids (sorted) of nodes and of their neighbours, and weights. All rows of a node are in one partition."""
    sc = pairs.sparkSession.sparkContext
    shared = sc.broadcast((ids, hashes))
    both = pairs.select(F.col("u").alias("id"), F.col("v").alias("near"), "weight").unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("near"), "weight"))
    size = both.count()
    parts = max(2 * sc.defaultParallelism, -(-size // LISTED))

    def numbered(batches):
        for batch in batches:
            at = [pa.array(np.searchsorted(shared.value[0], batch.column(c).to_numpy()), pa.int32()) for c in ("id", "near")]
            yield pa.RecordBatch.from_arrays([*at, batch.column("weight")], names=["node", "near", "weight"])

    def listed(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        node, near, weight = (table.column(c).to_numpy() for c in ("node", "near", "weight"))
        order = np.argsort(node, kind="stable")
        node, near, weight = node[order], near[order], weight[order]
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        length = np.diff(np.append(begin, len(node)))
        pieces = -(-length // NEIGHBOURS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        offsets = pa.array(np.append(np.repeat(begin, pieces) + nth * NEIGHBOURS, len(node)), pa.int32())
        row = node[offsets.to_numpy()[:-1]]
        whole = pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(shared.value[1][row]), pa.ListArray.from_arrays(offsets, pa.array(near, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight, pa.int64()))], names=["node", "hash", "near", "pull"])
        for lo in range(0, whole.num_rows, 256):
            yield whole.slice(lo, 256)

    flat = both.select("id", "near", "weight").mapInArrow(numbered, "node int, near int, weight long")
    return flat.repartition(parts, "node").mapInArrow(listed, "node int, hash long, near array<int>, pull array<long>")


def listed_moves(pairs: DataFrame, nodes: DataFrame, whole: float, passes: int, tolerance: float) -> DataFrame:
    """The same moves over lists of neighbours that stay in the executors: a turn is one job, which takes the state of the nodes (STATE_NODES at most) and returns moves."""
    found = nodes.select("id", F.xxhash64("id").alias("hash")).toArrow()  # STATE_NODES rows at most
    ids, hashes = found.column("id").to_numpy(), found.column("hash").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    return moves_over_lists(neighbour_lists(pairs, ids, hashes), ids, whole, passes, tolerance)


def moves_over_lists(lists: DataFrame, ids: np.ndarray, whole: float | None, passes: int, tolerance: float) -> DataFrame:
    """(id, community) of the nodes that have a neighbour. lists: node (a place in ids, sorted), hash, near, pull; all rows of a node are in one partition."""
    spark = lists.sparkSession
    sc, step, n = spark.sparkContext, tolerance * UNITS, len(ids)
    lists = lists.persist(StorageLevel.MEMORY_AND_DISK)
    degree, home = np.zeros(n, np.int64), np.arange(n)
    sums = lists.select("node", F.aggregate("pull", F.lit(0).cast("long"), lambda a, x: a + x).alias("degree")).groupBy("node").agg(F.sum("degree").alias("degree")).toArrow()
    degree[sums.column("node").to_numpy()] = sums.column("degree").to_numpy()
    load = degree.copy()
    whole = float(degree.sum()) if whole is None else whole
    linked = np.zeros(n, bool)
    linked[sums.column("node").to_numpy()] = True
    degrees = sc.broadcast(degree)
    for turn in range(passes if whole > 0 else 0):
        moved = False
        for c in range(CLASSES):
            state = sc.broadcast((home.astype(np.int32), load))

            def run(batches, state=state):
                homes, loads = state.value
                rows, near, pull = [], [], []
                for batch in batches:
                    rows.append(np.repeat(batch.column("node").to_numpy(), np.diff(batch.column("near").offsets.to_numpy())))
                    near.append(batch.column("near").flatten().to_numpy())
                    pull.append(batch.column("pull").flatten().to_numpy())
                if not rows:
                    return
                source, near, pull = (np.concatenate(x) for x in (rows, near, pull))
                mine, source = np.unique(source, return_inverse=True)
                goes, goals = best_moves(source.astype(np.int64), homes[near].astype(np.int64), pull, mine, homes[mine].astype(np.int64), degrees.value[mine], loads, whole, step)
                yield pa.RecordBatch.from_arrays([pa.array(mine[goes], pa.int32()), pa.array(goals, pa.int32())], names=["node", "goal"])

            mine = F.shiftright(F.col("hash"), 2 * turn).bitwiseAND(F.lit(CLASSES - 1)) == c
            moves = lists.where(mine).select("node", "near", "pull").mapInArrow(run, "node int, goal int").toArrow()
            state.destroy()
            if moves.num_rows:
                moved = True
                at = moves.column("node").to_numpy()
                moved_loads(home, load, at, moves.column("goal").to_numpy().astype(np.int64), degree[at])
        if not moved:
            break
    lists.unpersist()
    least = np.full(n, n)
    np.minimum.at(least, home, np.arange(n))
    return spark.createDataFrame(pa.table({"id": pa.array(ids[linked], pa.int64()), "community": pa.array(ids[least[home]][linked], pa.int64())}))


def joined_moves(pairs: DataFrame, whole: float, passes: int, tolerance: float) -> DataFrame:
    """The same moves by joins over (node, community) sums; a turn reads the edges of its nodes only, whose hashes stand beside them."""
    both = pairs.select("u", "v", "weight", "u_hash").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight", F.col("v_hash").alias("u_hash")))
    both = written(both.select(F.col("u").alias("id"), "v", "weight", F.col("u_hash").alias("hash")))
    state = written(both.groupBy("id", "hash").agg(F.sum("weight").alias("degree")).withColumns({"home": F.col("id"), "moved": F.lit(False)}))
    step = tolerance * UNITS
    for turn in range(passes if whole > 0 else 0):
        moved = False
        for c in range(CLASSES):
            mine = F.shiftright("hash", 2 * turn).bitwiseAND(F.lit(CLASSES - 1)) == c
            load = state.groupBy(F.col("home").alias("to")).agg(F.sum("degree").alias("load"))
            homes = state.select(F.col("id").alias("v"), F.col("home").alias("to"))
            toward = both.where(mine).join(homes, "v").select("id", "to", "weight").unionByName(state.where(mine).select("id", F.col("home").alias("to"), F.lit(0).cast("long").alias("weight")))
            toward = toward.groupBy("id", "to").agg(F.sum("weight").alias("pull")).join(load, "to").join(state.where(mine).select("id", "degree", "home"), "id")
            stays = F.col("to") == F.col("home")
            rest = F.col("load") - F.when(stays, F.col("degree")).otherwise(F.lit(0).cast("long"))
            gain = F.floor((F.col("pull").cast("double") - rest.cast("double") * F.col("degree").cast("double") / whole) / step + 0.5)
            best = toward.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("minus"))).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("now"))
            going = best.where(F.col("best.gain") > F.greatest(F.col("now"), F.lit(0).cast("long"))).select("id", (-F.col("best.minus")).alias("goal"))
            after = written(state.join(going, "id", "left").select("id", "hash", "degree", F.coalesce("goal", "home").alias("home"), F.col("goal").isNotNull().alias("moved")))
            moved = bool(after.where("moved").head(1)) or moved
            dropped(state)
            state = after
        if not moved:
            break
    dropped(both)
    least = written(state.groupBy("home").agg(F.min("id").alias("community")))
    return state.join(least, "home").select("id", "community")


def clusters(communities: DataFrame, least: int = TOPICS.min_cluster) -> DataFrame:
    """(cluster_id, members sorted, size) of communities of enough members."""
    return communities.groupBy(F.col("community").alias("cluster_id")).agg(F.array_sort(F.collect_list("id")).alias("members"), F.count("*").alias("size")).where(F.col("size") >= least)
