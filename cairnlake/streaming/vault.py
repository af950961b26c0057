"""A watched folder of Markdown files.

A manifest table holds what was last seen of each file (path, time, length, digest). A look lists the folder anew, joins the listing with the
manifest, and reads only files that are new or whose time or length differ. Files that are gone become tombstones. The listing carries no
contents; contents are read by Spark, and only their digests are kept.

A look first writes its changes, then the manifest, whose version is the commit: a look that fails between the two leaves the old
manifest, and the next one finds the same changes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.scratch import written
from .inbox import current_version

MANIFEST = "file string, modified timestamp, length bigint, digest string, status string"
CHANGE = "file string, change string, header string, body string, modified timestamp"


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """The last committed manifest; files that are gone have the status tombstone."""
    version = current_version(spark, f"{table}/manifest")
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{table}/manifest/v={version}")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the folder's Markdown files; Spark reads contents only if they are selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)


def differences(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """(file, modified, length, old_digest, kind): new (also after a tombstone), changed (by time or length), gone. listing: file, modified, length."""
    old = seen.where("status = 'live'").select("file", F.col("modified").alias("old_modified"), F.col("length").alias("old_length"), F.col("digest").alias("old_digest"))
    both = listing.join(old, "file", "full")
    same = (F.col("modified") == F.col("old_modified")) & (F.col("length") == F.col("old_length"))
    kind = F.when(F.col("old_length").isNull(), "new").when(F.col("length").isNull(), "gone").when(~same, "changed")
    return both.withColumn("kind", kind).where("kind is not null").select("file", "modified", "length", "old_digest", "kind")


def look(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One look at the folder: its changes (new, replaced, deleted), which are also kept in the table, and the new manifest.

    A touched file (another time, the same contents) is no change, but its new time is noted."""
    seen = manifest(spark, table)
    everything = files_of(spark, folder)
    listing = everything.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")
    found = written(differences(listing, seen))
    oldest = found.where("kind <> 'gone'").agg(F.min("modified").alias("m")).first()["m"]
    # the bound on the time reaches the source, which then skips older files unread
    recent = everything.where(F.col("modificationTime") >= F.lit(oldest)) if oldest is not None else everything.where("false")
    wanted = recent.join(found.where("kind <> 'gone'").select(F.col("file").alias("path"), "old_digest", "kind"), "path")
    read = written(wanted.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", "old_digest", "kind", F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("value")))
    part = store.front_matter(F.col("value"))
    fresh = read.where(~F.col("digest").eqNullSafe(F.col("old_digest")))
    changes = fresh.select("file", F.when(F.col("kind") == "new", "new").otherwise("replaced").alias("change"), part["header"].alias("header"), part["body"].alias("body"), "modified")
    gone = found.where("kind = 'gone'")
    none = F.lit(None).cast("string")
    changes = changes.unionByName(gone.select("file", F.lit("deleted").alias("change"), none.alias("header"), none.alias("body"), F.lit(None).cast("timestamp").alias("modified")))
    number = (current_version(spark, f"{table}/manifest") or 0) + 1
    if found.isEmpty():
        return spark.createDataFrame([], CHANGE)
    out = f"{table}/changes/v={number}"
    changes.write.mode("overwrite").parquet(out)
    kept = seen.join(found.select("file"), "file", "left_anti")
    noted = read.select("file", "modified", "length", "digest", F.lit("live").alias("status"))
    dead = seen.where("status = 'live'").join(gone.select("file"), "file", "left_semi").withColumn("status", F.lit("tombstone"))
    kept.unionByName(noted).unionByName(dead).write.mode("overwrite").parquet(f"{table}/manifest/v={number}")
    return spark.read.schema(CHANGE).parquet(out)


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, handle: Callable[[DataFrame], None] | None = None, every: str = "2 seconds"):
    """Starts a query that looks at the folder again and again and hands each look's changes on.

    The ticks of a rate source drive it; ``handle`` gets changes at least once, so it should upsert by file."""

    def tick(_: DataFrame, number: int) -> None:
        changes = look(spark, folder, table)
        if handle is not None and not changes.isEmpty():
            handle(changes)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upserted(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes (file, header, body, modified) after changes: replaced by file, deleted ones go."""
    rest = notes.join(changes.select("file"), "file", "left_anti")
    return rest.unionByName(changes.where("change <> 'deleted'").select("file", "header", "body", "modified").select(notes.columns))
