"""The set-similarity join over many blocks, and two sides of any size, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import simjoin


def texts(seed, n):
    """Texts in clusters of like ones, of very different lengths, with copies, frequent words and empty ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            base = list(r.choice(out))
            for _ in range(r.choice([0, 1, 3, 9])):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
            out.append(base + r.sample(words, r.choice([0, 0, 4])))
        else:
            out.append(r.choices(words[:5], k=3) + r.sample(words, r.choice([1, 5, 20, 120])))
    out[7] = []
    return [" ".join(t) for t in out]


def jaccard(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_blocks_give_all_pairs(spark, monkeypatch, threshold):
    for name, value in (("HEADS", 4000), ("SETS", 4000), ("FEW", 100), ("LOOKED_UP", 16), ("SAMPLED", 50)):
        monkeypatch.setattr(simjoin, name, value)
    rows = texts(3, 260)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    pairs, members = simjoin.self_join(df, F.filter(F.split("t", " "), lambda w: w != ""), threshold, "id")
    rep = {r.id: r.rep for r in members.collect()}
    got = pairs.collect()
    assert len({(r.a, r.b) for r in got}) == len(got) and all(r.a < r.b for r in got)
    firsts = sorted(set(rep.values()))
    want = {(a, b): jaccard(rows[a], rows[b]) for a in firsts for b in firsts if a < b and jaccard(rows[a], rows[b]) >= threshold}
    assert {(r.a, r.b): r.sim for r in got} == pytest.approx(want) and len(want) > 20
    assert all(set(rows[i].split()) == set(rows[k].split()) for i, k in rep.items()) and 7 not in rep


@pytest.mark.parametrize("share", [0, 1 << 30])
def test_a_large_cluster_is_many_tasks(spark, monkeypatch, share):
    """Pairs of one cluster of near copies do not meet in one task; tokens numbered or not, all are found."""
    for name, value in (("CLUSTER", 32), ("PAIRS", 2000), ("FEW", 100)):
        monkeypatch.setattr(simjoin, name, value)
    monkeypatch.setattr(simjoin, "NUMBERED", share)
    r = random.Random(9)
    rows = [" ".join([f"c{i}" for i in range(30)] + r.sample([f"x{i}" for i in range(90)], r.choice([2, 9, 20]))) for _ in range(240)] + texts(2, 60)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    pairs, members = simjoin.self_join(df, F.filter(F.split("t", " "), lambda w: w != ""), 0.6, "id")
    firsts = sorted({m.rep for m in members.collect()})
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    want = {(a, b): jaccard(rows[a], rows[b]) for a in firsts for b in firsts if a < b and jaccard(rows[a], rows[b]) >= 0.6}
    assert len(got) == len(want) and {(p.a, p.b): p.sim for p in got} == pytest.approx(want)
    tasks = [p.task for p in got if p.b < 240]
    assert max(tasks.count(t) for t in set(tasks)) < len(tasks) / 3


def test_candidates_are_few(spark):
    """Texts that share a third of their words, all frequent, are no candidates: they need no full sets."""
    r = random.Random(1)
    rows = [[f"c{i}" for i in range(60)] + [f"x{k}.{i}" for i in range(60)] + r.sample([f"m{i}" for i in range(300)], 60) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t array<string>").select("id", simjoin.token_set(F.col("t"), None).alias("toks"))
    assert simjoin.candidates(simjoin.heads(df, 0.5, ["id"]), 0.5).count() < 10


def sides(rows, threshold):
    """Blocks as a task holds them: rows in order of size, with the heads of their sets in one order of tokens, and the sets."""
    rows = sorted(rows, key=len)
    heads = [sorted(r)[: len(r) - int(np.ceil(threshold * len(r) - 1e-9)) + 1] for r in rows]
    return {"n": np.array([len(r) for r in rows], np.int32), "head": np.array([t for h in heads for t in h], np.uint32), "first": np.append(0, np.cumsum([len(h) for h in heads]))}, rows


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.5, 0.75, 0.9])
def test_blocks_meet_in_both_directions(monkeypatch, threshold):
    """Every pair at the threshold is found once, whichever row is the larger one, of two blocks and of one, in small pieces and large."""
    rng = np.random.default_rng(4)

    def drawn(n):
        out = [set(rng.integers(0, 300, 1))]
        while len(out) < n:
            base = out[rng.integers(len(out))] if rng.random() < 0.7 else set()
            out.append({t for t in base if rng.random() > 0.1} | set(rng.integers(0, 300, rng.choice([1, 3, 12, 60])) if rng.random() < 0.5 or not base else []) or {7})
        return [set(map(int, s)) for s in out]

    near = lambda x, y: len(x & y) / len(x | y) >= threshold
    everything = lambda h, g: np.ones(len(h), bool)
    all_rows = drawn(320)
    (one, first), (two, second) = sides(all_rows[::2], threshold), sides(all_rows[1::2], threshold)
    for size in (1 << 20, 40):
        for name in ("LOOKED_UP", "GATHERED", "TESTED"):
            monkeypatch.setattr(simjoin, name, size)
        got = [(int(h), int(g)) for hs, gs in simjoin.met(one, two, False, threshold, everything) for h, g in zip(hs, gs)]
        want = {(i, j) for i, x in enumerate(first) for j, y in enumerate(second) if near(x, y)}
        assert len(set(got)) == len(got) and want <= set(got) and len(want) > 10
        got = [(int(h), int(g)) for hs, gs in simjoin.met(one, one, True, threshold, everything) for h, g in zip(hs, gs)]
        want = {(i, j) for j, y in enumerate(first) for i, x in enumerate(first[:j]) if near(x, y)}
        assert len(set(got)) == len(got) and want <= set(got)


def test_rows_that_share_nothing_cost_nothing(monkeypatch):
    """Counting follows the tokens that meet, not the pairs of rows."""
    cells, count = [0], np.bincount

    def counted(*args, **kwargs):
        out = count(*args, **kwargs)
        cells[0] += len(out)
        return out

    monkeypatch.setattr(simjoin.np, "bincount", counted)
    block, _ = sides([{k % 40, *range(1000 + 20 * k, 1020 + 20 * k)} for k in range(2000)], 0.9)
    assert not sum(len(h) for h, _ in simjoin.met(block, block, True, 0.9, lambda h, g: np.ones(len(h), bool)))
    assert cells[0] < 500_000  # pairs of rows: 2 million


@pytest.mark.parametrize("small", [5000, 0])
def test_two_sides(spark, monkeypatch, small):
    monkeypatch.setattr(simjoin, "SMALL_ROWS", small)
    monkeypatch.setattr(simjoin, "FEW", 40)
    left, right = texts(5, 150), texts(5, 60) + texts(6, 40)
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, t string").select("id", simjoin.token_set(F.filter(F.split("t", " "), lambda w: w != ""), None).alias("toks"))
    got = {(r.a, r.b): r.sim for r in simjoin.between(df(left), df(right), 0.4).collect()}
    want = {(i, j): jaccard(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if jaccard(x, y) >= 0.4}
    assert got == pytest.approx(want) and len(want) > 100
    assert simjoin.between(df(left), df(right).limit(0), 0.4).count() == 0


def test_conflicts_move_marks_of_texts_not_texts(spark):
    """Pairs meet what a conflict needs of a text, so what is shuffled does not grow with the texts; counts need no pairs of copies."""
    from cairnlake.operators import curate

    head = "use the new cache for all build steps of this project"
    rows = [(1, f"always {head}"), (2, f"never {head}"), (3, f"{head} always"), (4, f"{head} with react 17 or"), (5, f"{head} with react 18 or"), (6, "something else entirely")]
    df = spark.createDataFrame([(i, t, "global") for i, t in rows], "id long, content string, scope string")
    texts = dict(rows)
    found = curate.conflicts(df, "id", 0.3, 0.95)
    got = {(r.a, r.b): r.reason for r in found.collect()}
    both = [(a, b, texts[a], texts[b]) for a in texts for b in texts if a < b < 6 and (a, b) != (1, 3)]
    said = spark.createDataFrame(both, "a long, b long, x string, y string").withColumn("r", curate.contradiction(F.col("x"), F.col("y")))
    assert got == {(r.a, r.b): r.r for r in said.collect() if r.r} and got[1, 2] == got[2, 3] == "opposing_pair" and got[4, 5] == "version_conflict"
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    _, met = curate.consolidation(df, "id", 0.95, 0.99, 0.3, 0.9)
    assert (1, 2, "contradiction") in {(r.a, r.b, r.kind) for r in met.collect()}
    assert "content" not in met._jdf.queryExecution().optimizedPlan().toString()
    pairs, members = simjoin.self_join(df, F.split("content", " "), 0.3, "id", "scope")
    assert simjoin.counted(pairs, members).agg(F.sum("n")).first()[0] == simjoin.expand(pairs, members).count() > pairs.count()


def test_anchor_mismatches_are_a_set_join(spark):
    """Anchors of one popular file do not all meet; blank anchors, other files and other letter cases do not match."""
    from cairnlake.operators import curate

    rng = random.Random(8)
    rows = [(i, "verified" if i % 2 else "stale", rng.choice(["f", "f", "g", ""]), " ".join(rng.sample("a b c d e A".split(), rng.randrange(5)))) for i in range(120)]
    found = curate.anchor_mismatches(spark.createDataFrame([*rows, (500, "stale", "f", None)], "id long, verified_status string, file_path string, anchor_text string"))
    near = lambda x, y: bool(x | y) and len(x & y) / len(x | y) >= 0.5
    want = {(min(i, j), max(i, j)) for i, s, f, x in rows for j, t, g, y in rows if s == "verified" and t == "stale" and f == g != "" and near(set(x.split()), set(y.split()))}
    assert {(r.a, r.b) for r in found.collect()} == want and want
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_derived_edges_count_each_pair_once(spark):
    from cairnlake.operators import graph

    rng = random.Random(2)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for i in range(40)}
    edges = graph.derived_from(spark.createDataFrame([(i, k) for i, s in sets.items() for k in s] * 2, "id long, key long"), 0.3)
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) / len(x | y) > 0.3}
    assert {(r.from_id, r.to_id): r.weight for r in edges.collect()} == pytest.approx(want)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "(u#" in plan and " < v#" in plan
