"""Record tables: upserts by bucket, two writers at once, cursors, bytes in proportion to the change."""

import os
import threading
from datetime import datetime

from pyspark.sql import functions as F

from cairnlake.sources.records import RecordTable, pull

SCHEMA = "id string, n long, note string"


def rows_of(table, version=None):
    return {r.id: (r.n, r.note) for r in table.read(version).collect()}


def made(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_changes(spark, tmp_path):
    t = RecordTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    assert t.read().collect() == [] and t.versions() == []
    t.change(made(spark, *[(f"k{i}", i, "a") for i in range(20)]))
    t.change(made(spark, ("k1", 100, "b"), ("new", 7, "c")))
    assert rows_of(t) == {f"k{i}": (i, "a") for i in range(20)} | {"k1": (100, "b"), "new": (7, "c")}
    assert rows_of(t, 0) == {f"k{i}": (i, "a") for i in range(20)}  # a reader keeps its version
    t.remove(t.read().where("n < 18").select("id"))
    assert rows_of(t) == {"k1": (100, "b"), "k18": (18, "a"), "k19": (19, "a")}
    more = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"), F.max("note").alias("note"))
    t.change(made(spark, ("k1", 1, "b"), ("k2", 2, "z")), more)
    assert rows_of(t)["k1"] == (101, "b") and rows_of(t)["k2"] == (2, "z")
    t.replace(t.read().where("id <> 'k2'"))
    t.remove(t.read().select("id"))
    assert rows_of(t) == {}
    assert t.vacuum() > 0 and rows_of(t) == {} and len(t.versions()) == 1


def test_bytes_follow_the_change(spark, tmp_path):
    t = RecordTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 64)
    t.change(spark.range(40_000).selectExpr("'k' || id AS id", "id AS n", "sha2(CAST(id AS string), 256) AS note"))
    whole = size_of(tmp_path / "t" / "data")
    t.change(made(spark, ("k1", 0, "x")))
    assert 0 < size_of(tmp_path / "t" / "data") - whole < whole / 30
    assert t.read().count() == 40_000


def test_two_writers(spark, tmp_path):
    """A writer whose number was taken merges again; one whose buckets nobody touched only commits again. No change is lost."""
    t = RecordTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    t.change(made(spark, ("a", 1, ""), ("b", 1, "")))
    add = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"), F.max("note").alias("note"))
    merges = []

    def slow(old, new):
        merges.append(1)
        if len(merges) == 1:  # another writer commits while this one merges
            RecordTable(spark, str(tmp_path / "t"), SCHEMA, ["id"]).change(made(spark, ("a", 10, "")), add)
        return add(old, new)

    t.change(made(spark, ("a", 100, "")), slow)
    assert rows_of(t)["a"][0] == 111 and len(merges) == 2 and t.versions() == [0, 1, 2]

    def threads(n):
        mine = RecordTable(spark, str(tmp_path / "t"), SCHEMA, ["id"])
        mine.change(made(spark, ("b", n, ""), (f"t{n}", n, "")), add)

    running = [threading.Thread(target=threads, args=(n,)) for n in (10, 100, 1000)]
    for r in running:
        r.start()
    for r in running:
        r.join()
    assert rows_of(t)["b"][0] == 1111 and {k for k in rows_of(t)} == {"a", "b", "t10", "t100", "t1000"} and len(t.versions()) == 6


def test_pull_from_a_cursor(spark, tmp_path):
    schema = "id string, updated_at timestamp, content string"
    t = RecordTable(spark, str(tmp_path / "t"), schema, ["id"], 4)
    feed = lambda *rows: spark.createDataFrame([(k, datetime(2024, 1, d), c, s) for k, d, c, s in rows], schema + ", status string")
    first = [("a", 1, "one", "approved"), ("b", 1, "b", "approved"), ("a", 2, "two", "approved")]
    pull(t, feed(*first))
    assert {r.id: r.content for r in t.read().collect()} == {"a": "two", "b": "b"} and t.cursor().startswith("2024-01-02")
    version = pull(t, feed(*first))  # nothing after the cursor
    assert version == 0
    pull(t, feed(*first, ("b", 3, None, "tombstone"), ("c", 3, "c", "staging")))
    assert {r.id: r.content for r in t.read().collect()} == {"a": "two", "c": "c"} and t.cursor().startswith("2024-01-03")
