"""Record tables that are changed in place of being rewritten.

Rows are dealt over buckets by a hash of their key; a bucket is a folder of Parquet. A change rewrites only the buckets that hold its
keys, and then commits: a file of the log that names the folder of every bucket, under the next number, which can be made only once. A writer
that finds its number taken reads the new state and merges again, unless the other change left its buckets alone. Readers keep the
version they began with. A commit can carry a cursor (how far a feed has been read), so rows and cursor change together.

Commits rest on a rename that fails if its target is there (Hadoop's FileContext), as HDFS and most cluster file systems give.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from .scratch import dropped, written

BUCKETS = 32


class RecordTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
        """``buckets`` holds for a new table; an existing one keeps its own number."""
        self.spark, self.path, self.schema, self.keys, self.most = spark, path.rstrip("/"), schema, keys, buckets
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    # ---- the log

    def _path(self, name: str):
        return self.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("log")
        files = folder.getFileSystem(self.conf)
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """Of a version (the last one by default): version, buckets, files (folder by bucket), cursor."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": -1, "buckets": self.most, "files": {}, "cursor": None}
            version = known[-1]
        place = self._path(f"log/{version:012d}.json")
        stream = place.getFileSystem(self.conf).open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> bool:
        """Whether this state became the next version; the file is written under another name first."""
        draft, place = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{state['version']:012d}.json")
        out = draft.getFileSystem(self.conf).create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = getattr(self.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.fs.FileContext.getFileContext(place.toUri(), self.conf).rename(draft, place, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            draft.getFileSystem(self.conf).delete(draft, False)
            return False

    # ---- rows

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(self.state(version)["files"].values()))

    def cursor(self) -> str | None:
        return self.state()["cursor"]

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Rows in a new folder; its folders by bucket."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names, self.bucket(buckets).alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        place = self.fs.Path(folder)
        found = [f.getPath().getName() for f in place.getFileSystem(self.conf).listStatus(place)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("_bucket=")}

    def replace(self, rows: DataFrame, cursor: str | None = None) -> int:
        """All rows anew; the number of the version."""
        rows = written(rows)  # rows may be read from the table itself
        while True:
            old = self.state()
            state = {"version": old["version"] + 1, "buckets": self.most, "files": self._write(rows, self.most), "cursor": cursor if cursor is not None else old["cursor"]}
            if self._commit(state):
                dropped(rows)
                return state["version"]

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, cursor: str | None = None) -> int:
        """Rows merged into those of their buckets: ``merge`` gets the old rows of the touched buckets and the new ones and returns what
        the buckets hold then; by default a row replaces the one with its key. The number of the version."""
        merge = merge or self.replaced
        rows = written(rows)
        made: dict[str, str] | None = None
        before: dict = {}
        while True:
            old = self.state()
            n = old["buckets"]
            touched = [str(r["b"]) for r in rows.select(self.bucket(n).alias("b")).distinct().collect()]  # no more than there are buckets
            now = {b: old["files"].get(b) for b in touched}
            if made is None or now != before:
                mine = self._rows(sorted(f for f in now.values() if f))
                made, before = self._write(merge(mine, rows), n), now
            files = {b: f for b, f in old["files"].items() if b not in now} | made
            state = {"version": old["version"] + 1, "buckets": n, "files": files, "cursor": cursor if cursor is not None else old["cursor"]}
            if self._commit(state):
                dropped(rows)
                return state["version"]

    def replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)

    def remove(self, keys: DataFrame) -> int:
        """Without the rows of these keys."""
        return self.change(keys.select(*self.keys).distinct(), lambda old, gone: old.join(gone, self.keys, "left_anti"))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that the last ``keep`` versions do not use, and older log files; the number of folders deleted."""
        known = self.versions()
        used = {f.rsplit("/", 2)[-2] for v in known[-keep:] for f in self.state(v)["files"].values()}
        place = self._path("data")
        files = place.getFileSystem(self.conf)
        gone = [f.getPath() for f in files.listStatus(place) if f.getPath().getName() not in used] if files.exists(place) else []
        for path in gone:
            files.delete(path, True)
        for v in known[:-keep]:
            files.delete(self._path(f"log/{v:012d}.json"), False)
        return len(gone)


def pull(table: RecordTable, feed: DataFrame, at: str = "updated_at", status: str = "status") -> int:
    """Reads a feed of changes (the table's columns and a status) from the table's cursor on: of each key the last change counts, tombstones
    remove it. Rows and cursor are one commit, so a pull that fails is made again from where the last one ended. The number of the version.

    Changes that come late, with a time at the cursor or before it, are for a full pull (``since`` the beginning)."""
    since = table.cursor()
    fresh = feed.where(F.col(at) > F.lit(since).cast(feed.schema[at].dataType)) if since else feed
    fresh = written(fresh)
    newest = fresh.agg(F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    if newest is None:
        return table.state()["version"]
    names = table.spark.createDataFrame([], table.schema).columns
    rest = [c for c in names if c not in table.keys]
    last = fresh.groupBy(*table.keys).agg(F.max(F.struct(at, *[c for c in (*rest, status) if c != at])).alias("_last"))
    rows = last.select(*table.keys, *[F.col(f"_last.{c}").alias(c) for c in rest], F.col(f"_last.{status}").alias("_status"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*table.keys), table.keys, "left_anti").unionByName(new.where("_status <> 'tombstone'").drop("_status"))

    return table.change(rows, merge, newest)
