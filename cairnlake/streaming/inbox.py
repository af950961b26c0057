"""The inbox as a stream: queue states, batches by number or age, change feeds, recall counts, watched folders.

A checkpointed source gives what a queue's claim and crash recovery give: an entry is handled once, and entries of
a batch that failed are read again.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import MINING
from ..sources import store

#: Allowed moves of an entry.
MOVES = {"pending": ("in_progress", "skipped"), "in_progress": ("consumed", "pending"), "consumed": (), "skipped": ()}


def inbox_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of JSON lines in a folder; malformed lines go."""
    return spark.readStream.schema(store.INBOX).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def vault_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Markdown files of a folder: file, header, body. A file source reads a path once; ``vault.watch`` sees replaced and deleted files too."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    part = store.front_matter(F.col("value"))
    return raw.select(F.col("_metadata.file_path").alias("file"), part["header"].alias("header"), part["body"].alias("body"), F.col("_metadata.file_modification_time").alias("modified"))


def moved(df: DataFrame, ids: DataFrame, to: str, now) -> DataFrame:
    """Entries after a move of the given ids, where it is allowed."""
    able = [s for s, targets in MOVES.items() if to in targets]
    hit = df.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    ok = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*able)
    out = hit.withColumn("consumed_at", F.when(ok & F.lit(to == "consumed"), now).otherwise(F.col("consumed_at")))
    return out.withColumn("status", F.when(ok, to).otherwise(F.col("status"))).drop("_hit")


def claim(df: DataFrame, n: int) -> DataFrame:
    """The first n pending entries by time."""
    return df.where("status = 'pending'").orderBy("timestamp", "id").limit(n)


def recovered(df: DataFrame) -> DataFrame:
    """After a crash: entries in progress are pending again."""
    return df.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def pruned(df: DataFrame, now, days: float = 7.0) -> DataFrame:
    """Without consumed entries older than the retention."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("consumed_at")) / 86400
    return df.where((F.col("status") != "consumed") | F.col("consumed_at").isNull() | (age <= days))


_STATE = "ids array<string>, first_ms long, batches long"
_OUT = "conversation_id string, batch long, ids array<string>, reason string"


def batches(entries: DataFrame, least: int = MINING.batch_least, most: int = MINING.batch_size, hours: float = MINING.batch_hours) -> DataFrame:
    """Batches of each conversation's entries: when ``least`` are waiting (in pieces of ``most``), or when the oldest has waited ``hours``.

    The state of a conversation is the ids that wait; a processing-time timer sends them when their time is up. Timers
    need a query that keeps running (a processing-time trigger, not availableNow)."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        waiting, first, sent = state.get if state.exists else ([], None, 0)
        waiting, out = list(waiting), []
        if state.hasTimedOut:
            out.append((waiting, "age"))
            waiting = []
        else:
            for frame in frames:
                waiting += frame.sort_values(["timestamp", "id"])["id"].tolist()
            while len(waiting) >= least:
                out.append((waiting[:most], "count"))
                waiting = waiting[most:]
        if waiting:
            first = first if first is not None and not out else state.getCurrentProcessingTimeMs()
            state.update((waiting, first, sent + len(out)))
            state.setTimeoutDuration(max(1, int(first + hours * 3_600_000 - state.getCurrentProcessingTimeMs())))
        elif state.exists and not out:
            state.update(([], None, sent))
        else:
            state.update(([], None, sent + len(out)))
        yield pd.DataFrame([(key[0], sent + i, ids, why) for i, (ids, why) in enumerate(out)], columns=["conversation_id", "batch", "ids", "reason"])

    pending = entries.where("status = 'pending'").select("conversation_id", "id", "timestamp")
    return pending.groupBy("conversation_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def recall_counts(log: DataFrame, late: str = "1 day", span: str = "1 day") -> DataFrame:
    """Recalls of each record by day; rows later than the watermark are dropped. log: doc_id, ts."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", span), "doc_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "doc_id", "n")


def sync(changes: DataFrame, table: str, checkpoint: str, key: str = "id"):
    """Starts a query that applies a stream of rows (key, updated_at, status, ...) to a Parquet table, batch by batch.

    Every batch writes a new version folder; ``current_version`` finds the last whole one, so a batch that is run again
    after a failure overwrites its own folder."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = current_version(spark, table, below=number)
        fresh = store.upsert(batch.limit(0), batch, [key])
        old = spark.read.parquet(f"{table}/v={version}") if version is not None else batch.limit(0)
        merged = store.upsert(old, fresh, [key]).where("status <> 'tombstone'")
        merged.write.mode("overwrite").parquet(f"{table}/v={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table: str, below: int | None = None) -> int | None:
    """The largest version whose folder was written whole, by Hadoop's file system (any scheme)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(f.getPath().getName()[2:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    found = [v for v in found if below is None or v < below]
    return max(found, default=None)
