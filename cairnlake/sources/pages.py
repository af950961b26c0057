"""Markdown pages as a data source: one file a row, and the pages of a folder as rows.

A task writes each page under a draft's name and renames it when it is whole, so a task that dies leaves drafts but no half page, and one
that runs again writes the same names. Drafts go when the job ends. Names are cleaned of what a path could not hold; two rows of one name are an
error of the job, found before anything is written. The folder must be a path that all executors mount.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .scratch import written

#: Drafts stand beside the pages, so that the rename stays within one file system.
DRAFT = ".draft-"


def local_path(path: str) -> str:
    """A mounted folder, with or without file: before it; other schemes are an error."""
    found = re.match(r"^([a-z][a-z0-9+.-]*):(?://)?(/.*)$", path)
    if found and found[1] != "file":
        raise ValueError(f"pages are written to a mounted folder, not to {found[1]}:")
    return found[2] if found else path


class Done(WriterCommitMessage):
    def __init__(self, job: str, pages: int) -> None:
        self.job, self.pages = job, pages


class PageWriter(DataSourceWriter):
    """Writes rows (name, value) as name.md."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        pages = 0
        for row in iterator:
            draft = f"{self.folder}/{DRAFT}{self.job}-{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8", newline="") as out:
                out.write(row["value"] or "")
            os.replace(draft, f"{self.folder}/{row['name']}.md")
            pages += 1
        return Done(self.job, pages)

    def _clear(self) -> None:
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.startswith(DRAFT + self.job):
                    os.remove(f"{self.folder}/{name}")

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_pages"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite):
        return PageWriter(local_path(self.options["path"]), overwrite)


def page_name(name):
    """A column of names without separators, control characters and dots in front; an empty name is untitled."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\\x00-\x1f]", "-"), r"^\.+", "")
    return F.when(clean == "", "untitled").otherwise(F.substring(clean, 1, 80))


def write_pages(df: DataFrame, path: str, name: str, value: str = "value") -> None:
    """Each row of df as a file <name>.md of the folder; pages of other names stay."""
    spark = df.sparkSession
    rows = written(df.select(page_name(F.col(name)).alias("name"), F.col(value).alias("value")))
    twice = rows.groupBy("name").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several pages are named {', '.join(r['name'] for r in twice)}")
    spark.dataSource.register(PageSource)
    rows.write.format(PageSource.name()).mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the folder's pages."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
    return raw.select(F.regexp_extract(F.url_decode("_metadata.file_name"), r"^(.*)\.md$", 1).alias("name"), "value")
