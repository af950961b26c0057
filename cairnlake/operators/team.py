"""Pools of several owners: nomination, boosts, overrides, merge, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TEAM
from ..functions import score


def nomination_candidates(df: DataFrame, done: DataFrame, cfg=TEAM) -> DataFrame:
    """Records recalled often enough with a score high enough that are not nominated, ignored or skipped yet."""
    return df.where((F.col("recall_count") >= cfg.nominate_recalls) & (F.col("instructivity_score") >= cfg.nominate_score)).join(done, "bullet_id", "left_anti")


def pending_nominations(candidates: DataFrame, nominated: DataFrame, skipped: DataFrame) -> DataFrame:
    """Candidates that wait for a decision: not nominated yet and not skipped in this session. All: bullet_id."""
    return candidates.join(nominated.select("bullet_id"), "bullet_id", "left_anti").join(skipped.select("bullet_id"), "bullet_id", "left_anti")


def nomination_summary(candidates: DataFrame, nominated: DataFrame, ignored: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row at a session's end: candidates, nominated, ignored and pending ids, each id counted once."""
    parts = {"total_candidates": candidates, "nominated_count": nominated, "ignored_count": ignored, "pending_count": pending_nominations(candidates, nominated, skipped)}
    tagged = [df.select("bullet_id", F.lit(name).alias("part")) for name, df in parts.items()]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3]).distinct()
    return rows.agg(*[F.count(F.when(F.col("part") == name, 1)).alias(name) for name in parts])


def keep_best(df: DataFrame, rows: int = TEAM.cache_rows) -> DataFrame:
    own = score.effective_score(F.col("instructivity_score"), F.col("upvotes"), F.col("downvotes"))
    return df.orderBy(own.desc(), "team_id").limit(rows)


def active_overrides(overrides: DataFrame, now: Column) -> DataFrame:
    """The last override of each id, if it has not run out. overrides: id, reason, expires, seq."""
    last = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return overrides.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").where(F.col("expires") > now)


def boosted(df: DataFrame, overrides: DataFrame | None, cfg=TEAM) -> DataFrame:
    """df (id, score, source, enforcement, provenance) with is_mandatory and boosted.

    Mandatory counts only for trusted provenance outside the local pool, and not while an override is active."""
    claim = (F.col("enforcement") == "mandatory") & (F.col("source") != "local") & F.col("provenance").isin("local_authored", "verified")
    if overrides is not None:
        df = df.join(overrides.select("id", F.lit(True).alias("_over")), "id", "left")
        claim = claim & F.col("_over").isNull()
    out = df.withColumn("is_mandatory", F.coalesce(claim, F.lit(False)))
    out = out.withColumn("boosted", F.when(F.col("is_mandatory"), cfg.mandatory_score).otherwise(F.col("score") * score.layer_boost(F.col("source"), cfg)))
    return out.drop("_over") if overrides is not None else out


def pool_union(pools: dict[str, DataFrame], limit: int) -> DataFrame:
    """Results of all pools, twice the limit of each, with their source."""
    out = None
    for name, df in sorted(pools.items()):
        part = df.orderBy(F.desc("score"), "id").limit(2 * limit).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def keyword_first(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Hits of both searches; of equal contents the keyword hit stays."""
    both = keyword.withColumn("_kw", F.lit(1)).unionByName(vector.withColumn("_kw", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("content").orderBy(F.desc("_kw"), F.desc("score"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_kw")


def normalise_tags(df: DataFrame, aliases: DataFrame, canonical: DataFrame, id_col: str, tags: str = "tags") -> DataFrame:
    """(id, tags): an exact alias's tag, else the canonical tag that is equal but for letter case, else the tag itself;
    repeats go, the order stays. The taxonomy's tables join; their size does not matter."""
    rows = df.select(id_col, F.posexplode_outer(tags).alias("_pos", "_tag"))
    low = canonical.select(F.lower("tag").alias("_low"), F.col("tag").alias("_canon")).dropDuplicates(["_low"])
    out = rows.join(aliases.select(F.col("alias").alias("_tag"), F.col("tag").alias("_alias")).dropDuplicates(["_tag"]), "_tag", "left").withColumn("_low", F.lower("_tag")).join(low, "_low", "left")
    out = out.withColumn("_new", F.coalesce("_alias", "_canon", "_tag"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_new").isNotNull(), F.struct("_pos", "_new"))))
    return out.groupBy(id_col).agg(F.array_distinct(F.transform(ordered, lambda x: x["_new"])).alias(tags))


#: Keys over which tags are dealt.
SALTS = 64


def vector_tags(df: DataFrame, canonical: DataFrame, least: float = 0.9) -> DataFrame:
    """(tag, best): the canonical tag with the largest cosine, if it is large enough. Both: tag, embedding.

    Tags and canonical tags are vocabularies; the pairs are tags times canonical tags, not rows of records. Tags are dealt over
    SALTS keys, to each of which all canonical tags of their length go, so no task meets all tags."""
    tags = df.select("tag", F.col("embedding").alias("a"), F.size("embedding").alias("n"), F.pmod(F.xxhash64("tag"), F.lit(SALTS)).cast("int").alias("salt"))
    every = canonical.select(F.col("tag").alias("best"), F.col("embedding").alias("b"), F.size("embedding").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = tags.join(every, ["n", "salt"])
    sim = pairs.withColumn("sim", score.cosine(F.col("a"), F.col("b"))).where(F.col("sim") >= least)
    return sim.groupBy("tag").agg(F.max_by("best", F.struct("sim", "best")).alias("best"))


def apply_changes(df: DataFrame, changes: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """df after a change feed: tombstones go, fetched rows replace or join. changes: id, updated_at, status."""
    w = Window.partitionBy(key).orderBy(F.col("updated_at").desc())
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    gone = last.where("status = 'tombstone'").select(key)
    fresh = fetched.join(last.where("status <> 'tombstone'").select(key), key, "left_semi")
    return df.join(gone, key, "left_anti").join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def needs_full_sync(last_sync: Column, now: Column, cfg=TEAM) -> Column:
    return last_sync.isNull() | (score.age_days(last_sync, now) > cfg.tombstone_days)


def live_tombstones(df: DataFrame, now: Column, cfg=TEAM) -> DataFrame:
    return df.where(score.age_days(F.col("deleted_at"), now) <= cfg.tombstone_days)


def orphans(local: DataFrame, server: DataFrame, key: str = "id") -> DataFrame:
    """Local ids that the server does not have."""
    return local.select(key).join(server.select(key), key, "left_anti")


def merge_taxonomy(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, tags): the sorted union of both taxonomies' tags."""
    return a.unionByName(b).groupBy("category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def votes(df: DataFrame, ballots: DataFrame) -> DataFrame:
    """Up and down votes added: 5 points up, 10 down. ballots: team_id, up."""
    n = ballots.groupBy("team_id").agg(F.sum(F.when(F.col("up"), 5).otherwise(0)).alias("_u"), F.sum(F.when(F.col("up"), 0).otherwise(10)).alias("_d"))
    return df.join(n, "team_id", "left").withColumn("upvotes", F.col("upvotes") + F.coalesce("_u", F.lit(0))).withColumn("downvotes", F.col("downvotes") + F.coalesce("_d", F.lit(0))).drop("_u", "_d")


def in_purpose(content_tokens: Column, keywords: list[list[str]], intent: list[str], threshold: float = 0.6) -> Column:
    """Whether a record is in a pool's purpose: all tokens of a keyword, else enough of the intent's tokens."""
    holds = lambda phrase: F.size(F.array_except(F.array(*[F.lit(t) for t in phrase]), content_tokens)) == 0
    out = F.lit(False)
    for k in keywords:
        out = out | holds(k)
    if intent:
        out = out | (F.size(F.array_intersect(F.array(*[F.lit(t) for t in sorted(set(intent))]), content_tokens)) / F.lit(float(len(set(intent)))) >= threshold)
    return F.when(F.size(content_tokens) == 0, False).otherwise(out)
