"""A watched folder: new, replaced, touched and deleted files; a look that fails before its commit."""

import os
import time

from cairnlake.operators import topics
from cairnlake.streaming import vault


def changes(spark, folder, table):
    return sorted((os.path.basename(r.file), r.change, r.header, r.body) for r in vault.look(spark, str(folder), str(table)).collect())


def test_looks(spark, tmp_path):
    folder, table = tmp_path / "vault", tmp_path / "table"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("---\ntitle: A\n---\nfirst")
    (folder / "sub" / "b.md").write_text("plain")
    (folder / "c.txt").write_text("no Markdown")
    assert changes(spark, folder, table) == [("a.md", "new", "title: A", "first"), ("b.md", "new", "", "plain")]
    assert changes(spark, folder, table) == []
    (folder / "a.md").write_text("---\ntitle: A\n---\nother")
    os.utime(folder / "a.md", (time.time() + 5, time.time() + 5))
    assert changes(spark, folder, table) == [("a.md", "replaced", "title: A", "other")]
    os.utime(folder / "a.md", (time.time() + 50, time.time() + 50))  # touched: noted, no change
    assert changes(spark, folder, table) == [] and changes(spark, folder, table) == []
    (folder / "sub" / "b.md").unlink()
    assert changes(spark, folder, table) == [("b.md", "deleted", None, None)]
    assert {r.status for r in vault.manifest(spark, str(table)).collect()} == {"live", "tombstone"}
    (folder / "sub" / "b.md").write_text("again")
    os.utime(folder / "sub" / "b.md", (1_600_000_000, 1_600_000_000))  # an old file moved in
    assert changes(spark, folder, table) == [("b.md", "new", "", "again")]
    same = os.stat(folder / "a.md")
    (folder / "a.md").write_text("---\ntitle: A\n---\nlonger text")
    os.utime(folder / "a.md", (same.st_atime, same.st_mtime))  # the same time, another length
    assert changes(spark, folder, table) == [("a.md", "replaced", "title: A", "longer text")]


def test_a_failed_look_is_made_again(spark, tmp_path):
    """Changes without a manifest are no commit: the next look finds them again."""
    folder, table = tmp_path / "vault", tmp_path / "table"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    assert changes(spark, folder, table) == [("a.md", "new", "", "one")]
    (table / "manifest" / "v=1" / "_SUCCESS").unlink()
    assert changes(spark, folder, table) == [("a.md", "new", "", "one")] and changes(spark, folder, table) == []


def test_watch(spark, tmp_path):
    folder, table = tmp_path / "vault", tmp_path / "table"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    notes = {}

    def handle(rows):
        for r in rows.collect():
            notes[os.path.basename(r.file)] = r.body

    q = vault.watch(spark, str(folder), str(table), str(tmp_path / "ck"), handle, "1 second")
    try:
        for step, (write, wanted) in enumerate([(None, {"a.md": "one"}), ("two", {"a.md": "two"})]):
            if write:
                (folder / "a.md").write_text(write)
                os.utime(folder / "a.md", (time.time() + 9, time.time() + 9))
            for _ in range(60):
                if notes == wanted:
                    break
                time.sleep(0.5)
            assert notes == wanted, step
    finally:
        q.stop()


def test_notes_upserted(spark):
    notes = spark.createDataFrame([("a", "", "1", None), ("b", "", "2", None)], "file string, header string, body string, modified timestamp")
    found = spark.createDataFrame([("a", "deleted", None, None, None), ("b", "replaced", "h", "3", None), ("c", "new", "", "4", None)], vault.CHANGE)
    assert sorted((r.file, r.body) for r in vault.upserted(notes, found).collect()) == [("b", "3"), ("c", "4")]


def test_slugs_are_unique(spark):
    pages = lambda rows: spark.createDataFrame(rows, "id string, title string")
    rows = [("aaaa00000001", "x y"), ("bbbb00000001", "x y"), ("cccc00000001", "x y"), ("dddd00000009", "x-y-00000001"), ("eeee", "Long " * 30), ("ffff", "Long " * 30), ("gggg", None), ("hhhh", "")]
    got = {r.id: r.slug for r in topics.unique_slugs(pages(rows)).collect()}
    assert len(set(got.values())) == len(rows) and all(len(s) <= 80 for s in got.values())
    assert got["aaaa00000001"] == "x-y" and got["dddd00000009"] == "x-y-00000001"  # titles come before suffixes
    taken = spark.createDataFrame([("x-y",), ("long",), (got["bbbb00000001"],)], "slug string")
    again = {r.id: r.slug for r in topics.unique_slugs(pages(rows), taken).collect()}
    assert len(set(again.values())) == len(rows) and not set(again.values()) & {"x-y", "long", got["bbbb00000001"]}
    many = pages([(f"{i:04d}00000001", "same title") for i in range(300)])
    assert topics.unique_slugs(many).select("slug").distinct().count() == 300
