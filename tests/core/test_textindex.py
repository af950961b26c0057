"""A table of queries against an inverted index: the same as scanning every record for every query, with fewer rows read."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import search, textindex

NOW = datetime(2024, 2, 1)
ROW = "bullet_id string, content string, scope string, decay_weight double, created_at timestamp, related_tools array<string>, key_entities array<string>, tags array<string>"
WORDS = "git rebase rebasing branches branch docker networks network don't doesn't it's rock'n'roll x_1 abc123 running ran went going Straße naïve ſo K9 ıstanbul İstanbul 数据库 数据 库 据库连接 接 the of files file classes".split()


def at():
    return F.lit(NOW).cast("timestamp")


def records(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sep = lambda: rng.choice([" ", " ", ", ", "-", "\n", ""])
        content = "".join(rng.choice(WORDS) + sep() for _ in range(rng.randint(0, 12)))
        rows.append((
            f"r{i:03d}", content if i % 17 else None, rng.choice(["global", "project:x", "project:y", None]), rng.choice([1.0, 0.9, 0.5, 0.1, 0.01, 0.0, None]),
            NOW - timedelta(rng.choice([1, 6, 7, 8, 40, 90])) if i % 13 else None, rng.choice([["Git"], ["docker", "GitHub"], [], None]), rng.choice([["Entity_4"], ["api", None], None]), rng.choice([["SRC3", "b"], [], None]),
        ))
    return rows


QUERIES = [
    "git rebase", "How do I rebase the Git branches?", "don't go", "rock'n roll rock'n'roll", "x_1 ABC123", "it's networks; docker|entity", "SRC3 api", "数据库连接", "数据", "库 接", "so k9 istanbul STANBUL", "", "the of and", "running files classes files",
    None, "数据库 git 数据库", "strasse naïve na", "zzz",
]


def scanned(spark, rows, query, scope, k):
    df = spark.createDataFrame(rows, ROW)
    out = search.top(search.scored(df, query or "", at(), scope), k).where("raw > 0")
    return [(r.bullet_id, round(r.keyword_score, 9), round(r.raw, 9)) for r in out.collect()]


def searched(spark, queries, rows, path, scope, k):
    out = textindex.search_table(queries, spark.createDataFrame(rows, ROW), path, at(), scope, k)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.bullet_id, round(r.keyword_score, 9), round(r.raw, 9)))
    return got


@pytest.mark.parametrize(("scope", "k"), [(None, 3), ("project:x", 7)])
def test_as_scanning(spark, tmp_path, monkeypatch, scope, k):
    monkeypatch.setattr(textindex, "BLOCK", 3)
    monkeypatch.setattr(textindex, "FIRST", 1)
    rows = records(1, 120)
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame(rows, ROW), path)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = searched(spark, queries, rows, path, scope, k)
    for i, query in enumerate(QUERIES):
        assert got.get(i, []) == scanned(spark, rows, query, scope, k), query


def test_updates_and_fewer_rows(spark, tmp_path, monkeypatch):
    """Changed, new and deleted records; blocks below the k-th score are left out."""
    monkeypatch.setattr(textindex, "BLOCK", 4)
    rows = {r[0]: r for r in records(2, 200)}
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame(list(rows.values()), ROW), path)
    changed = [(r[0], "git rebase " + (r[1] or "")) + r[2:3] + (1.0,) + r[4:] for r in list(rows.values())[:10]] + [("new", "docker network", "global", 1.0, NOW, None, None, None)]
    textindex.update(spark, path, spark.createDataFrame(changed, ROW), spark.createDataFrame([(f"r{i:03d}",) for i in range(50, 90)], "bullet_id string"))
    rows |= {r[0]: r for r in changed}
    for i in range(50, 90):
        rows.pop(f"r{i:03d}")
    queries = spark.createDataFrame(list(enumerate(QUERIES[:3])), "query_id int, query string")
    got = searched(spark, queries, list(rows.values()), path, None, 5)
    for i in range(3):
        assert got.get(i, []) == scanned(spark, list(rows.values()), QUERIES[i], None, 5)
    wanted = textindex.query_terms(spark, path, queries)
    extra = textindex.long_runs(queries, spark.createDataFrame(list(rows.values()), ROW), path)
    every, chosen = textindex.chosen_blocks(wanted, extra, path, at(), None, 5)
    assert chosen.count() < 0.6 * every.count()


def test_nothing_to_find(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.build(spark.createDataFrame([], ROW), path)
    queries = spark.createDataFrame([(1, "git")], "query_id int, query string")
    assert textindex.search_table(queries, spark.createDataFrame([], ROW), path, at()).collect() == []
    textindex.build(spark.createDataFrame(records(1, 5), ROW), str(tmp_path / "other"))
    assert textindex.search_table(queries.limit(0), spark.createDataFrame(records(1, 5), ROW), str(tmp_path / "other"), at()).collect() == []


def test_hits_of_a_query_in_a_block_stay_together(spark, tmp_path, monkeypatch):
    """Tasks grow in number with the pairs of queries and blocks, not in size; adding up needs no other shuffle."""
    monkeypatch.setattr(textindex, "BLOCK", 3)
    monkeypatch.setattr(textindex, "PAIRS", 5)
    path = str(tmp_path / "index")
    df = spark.createDataFrame(records(1, 120), ROW)
    textindex.build(df, path)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    wanted, extra = textindex.query_terms(spark, path, queries), textindex.long_runs(queries, df, path)
    chosen = textindex.bounds(wanted, path, at(), None).select("query_id", "block")
    hits = textindex.dealt_hits(wanted, chosen, extra, path)
    pairs = hits.select("query_id", "block", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(pairs) == len({(r.query_id, r.block) for r in pairs})
    assert chosen.count() > 100 and max(sum(r.task == t for r in pairs) for t in {r.task for r in pairs}) <= 20
    plan = textindex.points(hits, ["query_id", "bullet_id", "block"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("Generate explode(ids")[1] and "Exchange" not in plan.split("Generate explode(ids")[0]
