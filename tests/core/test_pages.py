"""Markdown pages: one file a row, read back equal; a task that dies and runs again; names that clash."""

import os

import pytest

from cairnlake.sources import pages


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = [("a-b", "---\ntitle: A\n---\nText\n"), ("sub/dir", "x"), ("..hidden", "é 数\r\n"), ("", ""), ("with space", "last")]
    pages.write_pages(spark.createDataFrame(rows, "slug string, value string").repartition(3), folder, "slug")
    assert sorted(os.listdir(folder)) == ["a-b.md", "hidden.md", "sub-dir.md", "untitled.md", "with space.md"]
    assert {r.name: r.value for r in pages.read_pages(spark, folder).where("name <> 'untitled'").collect()} == {"a-b": rows[0][1], "sub-dir": "x", "hidden": rows[2][1], "with space": "last"}
    pages.write_pages(spark.createDataFrame([("a-b", "new")], "slug string, value string"), "file://" + folder, "slug")
    assert open(f"{folder}/a-b.md").read() == "new" and len(os.listdir(folder)) == 5
    with pytest.raises(ValueError):
        pages.write_pages(spark.createDataFrame([("a/b", "1"), ("a-b", "2")], "slug string, value string"), folder, "slug")
    with pytest.raises(ValueError):
        pages.local_path("hdfs://host/x")


def test_a_task_that_dies_leaves_no_half_page(tmp_path):
    """The writer's own steps: a failure in the middle, the task again, the commit."""
    folder = str(tmp_path)
    writer = pages.PageWriter(folder, False)
    rows = [{"name": f"p{i}", "value": "text " * 1000} for i in range(5)]

    def dying():
        yield from rows[:2]
        yield {"name": "p2", "value": 7}  # not a text: fails while its draft is open

    with pytest.raises(TypeError):
        writer.write(dying())
    names = os.listdir(folder)
    assert {n for n in names if n.endswith(".md")} == {"p0.md", "p1.md"} and any(n.startswith(pages.DRAFT) for n in names)
    done = writer.write(iter(rows))
    assert done.pages == 5
    writer.commit([done])
    assert sorted(os.listdir(folder)) == [f"p{i}.md" for i in range(5)] and all(open(f"{folder}/p{i}.md").read() == "text " * 1000 for i in range(5))
    other = pages.PageWriter(folder, False)
    with pytest.raises(TypeError):
        other.write(dying())
    other.abort([])
    assert not any(n.startswith(pages.DRAFT) for n in os.listdir(folder))
