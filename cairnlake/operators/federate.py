"""Search over several pools: boosts, conflicts between pools, shadow merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import simjoin, team


def supersede_conflicts(local: DataFrame, pool: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(local_id, team_id, kind): explicit references first; records without one meet what is alike but not equal.

    local: local_id, content, supersedes. pool: team_id, content. A side's copies are one row of the join."""
    named = local.join(pool.select(F.col("team_id").alias("supersedes")), "supersedes").select("local_id", F.col("supersedes").alias("team_id"), F.lit("explicit").alias("kind"))
    rest = local.join(named.select("local_id").distinct(), "local_id", "left_anti")
    pairs = alike(rest.select(F.col("local_id").alias("l"), "content"), pool.select(F.col("team_id").alias("t"), "content"), threshold)
    return named.unionByName(pairs.where("sim < 1").select(F.col("l").alias("local_id"), F.col("t").alias("team_id"), F.lit("implicit").alias("kind")))


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, t, sim) of word sets. left: l, content; right: t, content."""
    side = lambda df, k: df.select(F.col(k).cast("string").alias("id"), simjoin.token_set(text.word_set(F.coalesce("content", F.lit(""))), None).alias("toks"))
    return simjoin.between(side(left, "l"), side(right, "t"), threshold).select(F.col("a").alias("l"), F.col("b").alias("t"), "sim")


def proposals(local: DataFrame, pool: DataFrame, pairs: DataFrame, ignored: DataFrame, similarity: float = 0.8, difference: float = 0.2) -> DataFrame:
    """(local_id, team_id, similarity): alike by ``pairs`` (local_id, team_id, similarity; any measure), different by words, not ignored."""
    words = lambda df, k, n: df.select(k, text.word_set(F.col("content")).alias(n))
    near = pairs.where(F.col("similarity") >= similarity).join(ignored, ["local_id", "team_id"], "left_anti")
    both = near.join(words(local, "local_id", "wl"), "local_id").join(words(pool, "team_id", "wt"), "team_id")
    from ..functions import score

    return both.where(1.0 - score.jaccard(F.col("wl"), F.col("wt")) >= difference).select("local_id", "team_id", "similarity")


def notifications(local: DataFrame, changed: DataFrame, least: float = 0.5) -> DataFrame:
    """(team_id, local_id, similarity): local records that a changed team record may concern."""
    return alike(local.select(F.col("local_id").alias("l"), "content"), changed.select(F.col("team_id").alias("t"), "content"), least).select(F.col("t").alias("team_id"), F.col("l").alias("local_id"), F.col("sim").alias("similarity"))


def tag_conflicts(df: DataFrame) -> DataFrame:
    """(a, b): rows of which one has a tag that the other excludes. df: id, tags, incompatible_tags."""
    tags = df.select(F.col("id").alias("a"), F.explode("tags").alias("tag")).distinct()
    not_with = df.select(F.col("id").alias("b"), F.explode("incompatible_tags").alias("tag")).distinct()
    return tags.join(not_with, "tag").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shadow_merge(df: DataFrame, near: float = 0.95) -> DataFrame:
    """The rows that stay, best first: superseded team rows go, then rows that conflict with a better one that stays.

    Rows conflict by tags, or as near-duplicates if neither excludes tags. Mandatory rows stay and still
    suppress others. df: id, content, source, boosted, is_mandatory, tags, incompatible_tags, supersedes. df is the
    bounded result of the pools, so its order is taken in one window."""
    gone = df.where((F.col("source") == "local") & F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"))
    team_rows = df.where((F.col("source") != "local") & ~F.col("is_mandatory")).join(gone, "id", "left_semi").select("id")
    live = df.join(team_rows, "id", "left_anti")
    plain = live.where(F.size("incompatible_tags") == 0).where(F.coalesce("content", F.lit("")) != "")
    pairs, members = simjoin.self_join(plain, text.word_set(F.col("content")), near, "id")
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    every = simjoin.expand(pairs, members).select("a", "b").unionByName(copies).unionByName(_copy_pairs(members)).unionByName(tag_conflicts(live)).distinct()
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("boosted"), "id")
    ranked = live.withColumn("rank", F.row_number().over(order))
    kept = simjoin.suppress(ranked.select("id", "rank", F.col("is_mandatory").alias("forced")), every)
    return ranked.join(kept.where("kept").select("id"), "id", "left_semi").orderBy("rank")


def _copy_pairs(members: DataFrame) -> DataFrame:
    """Pairs of rows with equal sets. The rows are a bounded result list."""
    m = members.select("rep", F.col("id").alias("a")).join(members.select("rep", F.col("id").alias("b")), "rep")
    return m.where("a < b").select("a", "b")


def search(pools: dict[str, DataFrame], overrides: DataFrame | None, limit: int) -> DataFrame:
    """Pools (id, content, score, ...) joined, boosted, merged, and cut to the best ``limit``."""
    union = team.pool_union(pools, limit)
    return shadow_merge(team.boosted(union, overrides)).orderBy("rank").limit(limit)
