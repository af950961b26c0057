"""Packing queues into batches of bounded size and sum, also a queue that is far too long for one task.

A batch begins where the one before it ends, so packing is a fold; but where a batch ends depends on nothing but where it begins, and it has at most
``most_size`` rows. So rows are laid out in order over tasks, and each task folds the queues that it holds whole. The few queues
that cross a border are cut there into pieces, and a piece is summed up by a short table: for each of the first rows that a batch might begin
at, how many batches begin in the piece, and how far into what follows the next one begins. Chaining a queue's tables (one row a task)
tells each piece where its first batch begins and which number it has, and all pieces are numbered at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a task.
TASK_ROWS = 500_000


def next_starts(tokens: np.ndarray, following: np.ndarray, most_size: int, budget: int) -> np.ndarray:
    """For a batch that begins at each row of a piece: where the next one begins, counted from the piece's first row."""
    total = np.concatenate([[0], np.cumsum(np.concatenate([tokens, following]))])
    at = np.arange(len(tokens))
    by_sum = np.searchsorted(total, total[at] + budget, side="right") - 1
    return np.minimum(np.maximum(by_sum, at + 1), at + most_size)


def walk_table(tokens: np.ndarray, following: np.ndarray, most_size: int, budget: int) -> tuple[list[int], list[int]]:
    """For each first start up to ``most_size`` rows into a piece: how far into what follows the next batch begins, and the batches begun in the piece."""
    n = len(tokens)
    after = next_starts(tokens, following, most_size, budget).tolist()
    exits, begun = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = after[i]
        exits[i], begun[i] = (j - n, 1) if j >= n else (exits[j], begun[j] + 1)
    return exits[: most_size + 1] + list(range(max(0, most_size + 1 - n))), begun[: most_size + 1] + [0] * max(0, most_size + 1 - n)


def numbered(tokens: np.ndarray, following: np.ndarray, most_size: int, budget: int, entry: int, base: int) -> np.ndarray:
    """The batch of each row of a piece whose first batch begins at row ``entry`` and is the ``base``-th of its queue."""
    after = next_starts(tokens, following, most_size, budget)
    begins = np.zeros(len(tokens) + 1, np.int64)
    at = entry
    while at < len(tokens):
        begins[at] = 1
        at = int(after[at])
    return base - 1 + np.cumsum(begins[:-1])


def pack(entries: DataFrame, most_size: int, budget: int, group: str, order: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(group, order, batch) of entries with tokens: a new batch begins when the size or the token budget would be passed.

    Tokens are not negative; missing ones count as none. Rows of equal order go by their tokens."""
    rows = entries.select(F.col(group).alias("queue"), F.col(order).cast("long").alias("nth"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    kind = dict(rows.dtypes)["queue"]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // task_rows))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key = nothing = object()
        batch = size = used = place = 0
        for part in batches:
            numbers, places = [], []
            for queue, tokens in zip(part.column("queue").to_pylist(), part.column("tokens").to_pylist()):
                if key is nothing or queue != key:
                    key, batch, size, used, place = queue, 0, 0, 0, 0
                if size and (size >= most_size or used + tokens > budget):
                    batch, size, used = batch + 1, 0, 0
                size, used = size + 1, used + tokens
                numbers.append(batch)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*part.schema.names, "batch", "place"])

    laid = rows.repartitionByRange(tasks, "queue", "nth", "tokens").withColumn("task", F.spark_partition_id()).sortWithinPartitions("queue", "nth", "tokens")
    laid = written(laid.mapInArrow(fold, f"queue {kind}, nth long, tokens long, task int, batch long, place long"))
    # at most one queue a border
    cut = laid.groupBy("queue").agg(F.min("task").alias("first"), F.max("task").alias("last")).where("first < last").select(F.col("queue").alias("cut"))
    cut = written(cut)
    on = laid["queue"].eqNullSafe(cut["cut"])
    whole = laid.join(cut, on, "left_anti").select("queue", "nth", "batch")
    pieces = laid.join(cut, on, "left_semi")
    heads = pieces.where(F.col("place") < most_size).groupBy("queue", "task").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tokens"))), lambda r: r["tokens"]).alias("head"))
    later = Window.partitionBy("queue").orderBy("task").rowsBetween(1, most_size)
    heads = written(heads.select("queue", "task", F.slice(F.flatten(F.collect_list("head").over(later)), 1, most_size).alias("following")))
    shape = pieces.join(heads.withColumnRenamed("queue", "q").withColumnRenamed("task", "t"), pieces["queue"].eqNullSafe(F.col("q")) & (pieces["task"] == F.col("t"))).drop("q", "t")
    # a piece's rows need the following tokens once
    shape = shape.withColumn("following", F.when(F.col("place") == 0, F.col("following")))

    def opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.sort_by("place")
        return table, table.column("tokens").to_numpy(), np.array(table.column("following")[0].as_py() or [], np.int64)

    def summed(table: pa.Table) -> pa.Table:
        table, tokens, following = opened(table)
        exits, begun = walk_table(tokens, following, most_size, budget)
        return pa.table({"queue": table.column("queue").slice(0, 1), "task": table.column("task").slice(0, 1), "exits": pa.array([exits], pa.list_(pa.int64())), "begun": pa.array([begun], pa.list_(pa.int64()))})

    tables = shape.groupBy("queue", "task").applyInArrow(summed, f"queue {kind}, task int, exits array<long>, begun array<long>")

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        entry = base = 0
        entries_, bases = [], []
        for exits, begun in zip(frame["exits"], frame["begun"]):
            entries_.append(entry)
            bases.append(base)
            entry, base = int(exits[entry]), base + int(begun[entry])
        return pd.DataFrame({"queue": frame["queue"], "task": frame["task"], "entry": entries_, "base": bases})

    starts = written(tables.groupBy("queue").applyInPandas(chained, f"queue {kind}, task int, entry long, base long"))
    started = shape.join(starts.withColumnRenamed("queue", "q").withColumnRenamed("task", "t"), shape["queue"].eqNullSafe(F.col("q")) & (shape["task"] == F.col("t"))).drop("q", "t")

    def finished(table: pa.Table) -> pa.Table:
        table, tokens, following = opened(table)
        batch = numbered(tokens, following, most_size, budget, table.column("entry")[0].as_py(), table.column("base")[0].as_py())
        return pa.table({"queue": table.column("queue"), "nth": table.column("nth"), "batch": pa.array(batch)})

    out = whole.unionByName(started.groupBy("queue", "task").applyInArrow(finished, f"queue {kind}, nth long, batch long"))
    return out.select(F.col("queue").alias(group), F.col("nth").alias(order), F.col("batch").cast("int").alias("batch"))
