"""Counts, sweeps and reports over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECAY
from ..functions import score


def status(df: DataFrame) -> DataFrame:
    """Counts and mean decay weight by section, by type and over all, in one pass."""
    weight = F.round(F.avg(F.coalesce("decay_weight", F.lit(1.0))), 2)
    return df.groupingSets([["section"], ["knowledge_type"], []], "section", "knowledge_type").agg(F.count("*").alias("n"), weight.alias("mean_weight"))


def count_by(df: DataFrame, field: str, mean_of: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.round(F.avg(mean_of), 6).alias("mean")] if mean_of else [])
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias("value")).agg(*aggs)


def sweep(df: DataFrame, now: Column, cfg=DECAY) -> DataFrame:
    """df with new_weight and outcome: permanent, archived, updated (a change over the least one) or unchanged."""
    kind = score.decay_status(F.col("created_at"), F.col("recall_count"), now, cfg)
    weight = score.decay_weight(F.col("created_at"), F.col("recall_count"), now, cfg)
    changed = F.abs(weight - F.coalesce("current_weight", F.lit(1.0))) > cfg.least_change
    outcome = F.when(kind == "permanent", "permanent").when(kind == "archived", "archived").when(changed, "updated").otherwise("unchanged")
    return df.withColumn("outcome", outcome).withColumn("new_weight", F.when(changed, F.bround(weight, 6)).otherwise(F.coalesce("current_weight", F.lit(1.0))))


def backlog(df: DataFrame, now: Column, most: int, most_days: float) -> DataFrame:
    """Records in staging, the oldest one's age, and whether either is over its bound."""
    age = score.age_days(F.col("nominated_at"), now)
    got = df.where("status = 'staging'").agg(F.count("*").alias("n"), F.max(age).alias("age"))
    return got.select("n", F.round("age", 1).alias("oldest_days"), (F.col("n") > most).alias("many"), (F.col("age") > most_days).alias("old"))


def inbox_counts(df: DataFrame, now: Column) -> DataFrame:
    """Entries by state (consumed: within the last hour) and the age in seconds of the oldest pending one."""
    recent = (F.unix_timestamp(now) - F.unix_timestamp("consumed_at")) <= 3600
    is_ = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return df.agg(
        is_("pending").alias("pending"),
        is_("in_progress").alias("in_progress"),
        F.sum(F.when((F.col("status") == "consumed") & recent, 1).otherwise(0)).alias("consumed_last_hour"),
        (F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(F.col("status") == "pending", F.col("timestamp"))))).alias("oldest_pending_seconds"),
    )


def status_report(df: DataFrame, field: str = "verified_status") -> DataFrame:
    return df.groupBy(F.coalesce(field, F.lit("unverifiable")).alias(field)).agg(F.count("*").alias("n"))


def reinforce(df: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recall counts grow by the log's recalls; last_recall is the latest. The log is summed before it is joined."""
    hits = log.groupBy(key).agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    old = F.col("last_recall") if "last_recall" in df.columns else F.lit(None).cast("timestamp")
    return df.join(hits, key, "left").withColumn("recall_count", F.col("recall_count") + F.coalesce("_n", F.lit(0))).withColumn("last_recall", F.greatest(old, F.col("_last"))).drop("_n", "_last")


def cluster_weight(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(community, weight): edges inside each community. clusters: id, community; pairs: u, v, weight."""
    a = clusters.select(F.col("id").alias("u"), F.col("community").alias("cu"))
    b = clusters.select(F.col("id").alias("v"), F.col("community").alias("cv"))
    return pairs.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("weight"))
