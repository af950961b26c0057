"""Packing against the plain fold: long queues over many tasks, short ones, borders everywhere."""

import random

import numpy as np
import pytest

from cairnlake.operators import packing

ROW = "conv_id string, turn long, tokens int"


def fold(tokens, most_size, budget):
    out, size, used, batch = [], 0, 0, 0
    for t in (t or 0 for t in tokens):
        if size and (size >= most_size or used + t > budget):
            batch, size, used = batch + 1, 0, 0
        out.append(batch)
        size, used = size + 1, used + t
    return out


@pytest.mark.parametrize(("most_size", "budget", "task_rows"), [(5, 100, 400), (50, 1000, 300), (7, 30, 20), (1, 10, 100)])
def test_as_the_fold(spark, most_size, budget, task_rows):
    """Pieces may be shorter than a batch; rows over the budget stand alone; rows without tokens fill up batches."""
    rng = random.Random(most_size)
    queues = {"long": [rng.choice([0, 0, 1, 5, 20, 60, 200]) for _ in range(3000)], None: [rng.randint(0, 30) for _ in range(700)]}
    queues |= {f"q{i}": [rng.randint(0, 60) for _ in range(rng.randint(1, 40))] for i in range(30)}
    rows = [(k, i, t) for k, ts in queues.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, ROW).repartition(6)
    got = {(r.conv_id, r.turn): r.batch for r in packing.pack(df, most_size, budget, "conv_id", "turn", task_rows).collect()}
    assert got == {(k, i): b for k, ts in queues.items() for i, b in enumerate(fold(ts, most_size, budget))}


def test_one_queue_of_a_million_rows(spark):
    """No task has more than its share of the only queue."""
    n = 1_000_000
    df = spark.range(n).selectExpr("'q' AS conv_id", "id AS turn", "CAST((id * 7919) % 61 AS int) AS tokens")
    out = packing.pack(df, 50, 1000, "conv_id", "turn", 50_000).toPandas().sort_values("turn")
    expected = fold([(i * 7919) % 61 for i in range(n)], 50, 1000)
    assert (out["batch"].to_numpy() == np.array(expected)).all()
    laid = df.repartitionByRange(20, "conv_id", "turn").rdd.glom().map(len).collect()
    assert max(laid) < 100_000


def test_tables_of_short_pieces():
    """Any cut of a queue into pieces chains to the same batches."""
    rng = random.Random(5)
    for _ in range(200):
        tokens = [rng.randint(0, 12) for _ in range(rng.randint(1, 40))]
        most_size, budget = rng.randint(1, 6), rng.randint(1, 30)
        cuts = sorted(rng.sample(range(1, len(tokens)), min(len(tokens) - 1, rng.randint(0, 6)))) if len(tokens) > 1 else []
        edges = [0, *cuts, len(tokens)]
        entry = base = 0
        found = []
        for a, b in zip(edges, edges[1:]):
            piece, following = np.array(tokens[a:b]), np.array(tokens[b : b + most_size], dtype=np.int64)
            exits, begun = packing.walk_table(piece, following, most_size, budget)
            found += packing.numbered(piece, following, most_size, budget, entry, base).tolist()
            entry, base = exits[entry], base + begun[entry]
        assert found == fold(tokens, most_size, budget)
