"""Ranked search: exact, fuzzy, metadata and semantic scores, blended and weighted, then trimmed.

The query is tokenised on the driver and enters the plan as literals, so scoring is one scan with a top-k at its end
and no shuffle of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL, TOPICS
from ..functions import score, text


def in_scope(df: DataFrame, scope: str | None) -> DataFrame:
    """Records of a scope and the global ones; all, if no scope is given."""
    return df.where(F.col("scope").isin(scope, "global")) if scope else df


def exact_score(content: Column, query: str, hit: float = RETRIEVAL.exact_hit) -> Column:
    """``hit`` for each distinct query term that is found."""
    words, runs = text.query_terms(query)
    found = [text.has_word(content, w).cast("int") for w in words] + [F.contains(content, F.lit(r)).cast("int") for r in runs]
    return sum(found, F.lit(0)) * F.lit(hit)


def fuzzy_score(content: Column, query: str, most: float = RETRIEVAL.fuzzy_most) -> Column:
    """``most`` times the share of the query's tokens (repeats count) that the content has."""
    tokens = text.literal_tokens(query)
    if not tokens:
        return F.lit(0.0)
    return F.least(text.token_hits(content, tokens) / F.lit(float(len(tokens))) * most, F.lit(most))


def metadata_tokens(query: str) -> list[str]:
    for ch in ",;:|/\\":
        query = query.replace(ch, " ")
    return query.lower().split()


def metadata_score(query: str, tools: Column, entities: Column, tags: Column, parts=(4.0, 3.0, 3.0)) -> Column:
    """Points if a tool or entity begins with a token, and if a tag equals one."""
    tokens = metadata_tokens(query)
    if not tokens:
        return F.lit(0.0)
    empty = F.array().cast("array<string>")
    heads = lambda arr: F.exists(F.coalesce(arr, empty), lambda x: _any([F.startswith(F.lower(x), F.lit(t)) for t in tokens]))
    points = [F.when(heads(tools), parts[0]).otherwise(0.0), F.when(heads(entities), parts[1]).otherwise(0.0)]
    points.append(F.when(F.exists(F.coalesce(tags, empty), lambda x: F.lower(x).isin(*tokens)), parts[2]).otherwise(0.0))
    return F.least(F.lit(10.0), points[0] + points[1] + points[2])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def scored(df: DataFrame, query: str, now: Column, scope: str | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """df with keyword_score, semantic_score, raw (ranks) and final_score (raw, clamped). semantic: bullet_id, similarity."""
    df = in_scope(df, scope)
    content = F.coalesce("content", F.lit(""))  # a missing text has no words, but may have tags
    keyword = exact_score(content, query) + fuzzy_score(content, query) + metadata_score(query, F.col("related_tools"), F.col("key_entities"), F.col("tags"))
    df = df.withColumn("keyword_score", keyword)
    if semantic is not None:
        df = df.join(semantic.select("bullet_id", F.col("similarity").alias("semantic_score")), "bullet_id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    else:
        df = df.withColumn("semantic_score", F.lit(0.0))
    raw = score.composite(F.col("keyword_score"), F.col("semantic_score"), F.col("decay_weight"), score.recency(F.col("created_at"), now), score.scope_boost(F.col("scope"), scope), semantic is not None)
    return df.withColumn("raw", raw).withColumn("final_score", score.clamp(F.col("raw")))


def top(df: DataFrame, k: int) -> DataFrame:
    """Best k by raw score; ties to the smaller id."""
    return df.orderBy(F.col("raw").desc(), "bullet_id").limit(k)


def trim(df: DataFrame, most: int = RETRIEVAL.max_results, budget: int = RETRIEVAL.token_budget) -> DataFrame:
    """The best rows while their tokens fit the budget; one row at least. df is a bounded top-k list.

    Token counts are not negative, so the running sum never falls and stopping at the first overflow equals a filter."""
    order = Window.orderBy(F.col("final_score").desc(), F.col("raw").desc(), "bullet_id")
    df = df.withColumn("tokens", text.estimate_tokens(F.col("content"))).withColumn("rank", F.row_number().over(order))
    df = df.withColumn("tokens_used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where((F.col("rank") <= most) & ((F.col("rank") == 1) | (F.col("tokens_used") <= budget)))


def search(df: DataFrame, query: str, now: Column, scope: str | None = None, semantic: DataFrame | None = None, limit: int = 20, max_results: int = RETRIEVAL.max_results, budget: int = RETRIEVAL.token_budget) -> DataFrame:
    return trim(top(scored(df, query, now, scope, semantic), limit), max_results, budget)


def vector_topk(df: DataFrame, query: list[float], k: int, floor: float = 0.3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Best k by cosine; only then those above the floor."""
    sim = score.cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return df.select(id_col, sim.alias("similarity")).orderBy(F.col("similarity").desc(), id_col).limit(k).where(F.col("similarity") > floor)


def team_keyword(df: DataFrame, query: str, limit: int) -> DataFrame:
    """Active team records: 1 for the query as it stands, else 0.7 of the share of its words, a tag 0.5, a summary 0.6."""
    q, words = query.lower(), sorted(set(query.lower().split()))
    low = F.lower(F.coalesce("content", F.lit("")))
    share = F.size(F.array_intersect(text.word_set(F.coalesce("content", F.lit(""))), F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words))) * 0.7
    tag = F.when(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))), 0.5).otherwise(0.0)
    summary = F.when(F.contains(F.lower(F.col("context_summary")), F.lit(q)), 0.6).otherwise(0.0) if "context_summary" in df.columns else F.lit(0.0)
    got = F.when(F.contains(low, F.lit(q)), 1.0).otherwise(F.greatest(share, tag, summary))
    own = score.effective_score(F.col("instructivity_score"), F.col("upvotes"), F.col("downvotes"))
    return df.where(F.col("status").isin("staging", "approved")).withColumn("score", got).withColumn("effective", own).where("score > 0").orderBy(F.desc("score"), F.desc("effective"), "team_id").limit(limit)


def playbook_keyword(df: DataFrame, query: str, limit: int) -> DataFrame:
    q = query.lower()
    tag = F.when(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))), 0.5).otherwise(0.0)
    return df.withColumn("score", F.when(F.contains(F.lower("content"), F.lit(q)), 1.0).otherwise(tag)).where("score > 0").orderBy(F.desc("score"), F.desc("instructivity_score"), "team_id").limit(limit)


def graph_search(base: DataFrame, bullets: DataFrame, edges: DataFrame, expand: int = 5, weight: float = 0.3, limit: int = 20) -> DataFrame:
    """Top-k results boosted by one hop over edges (from_id, to_id, weight), with at most ``expand`` new neighbours.

    base: bullet_id, final_score; it is small (a top-k), and so are its neighbours."""
    from .graph import degrees

    seeds = base.select(F.col("bullet_id").alias("from_id"), "final_score")
    out = edges.join(F.broadcast(seeds), "from_id").where("from_id <> to_id")
    near = degrees(edges).withColumnRenamed("id", "to_id").join(out, "to_id")
    gained = near.groupBy(F.col("to_id").alias("bullet_id")).agg(F.sum(F.col("final_score") * score.adamic_adar(F.col("weight"), F.col("degree"))).alias("graph_score")).where("graph_score > 0")
    old = base.select("bullet_id", "final_score").join(gained, "bullet_id", "left").select("bullet_id", (F.col("final_score") + weight * F.coalesce("graph_score", F.lit(0.0))).alias("score"), F.lit(False).alias("is_new"))
    fresh = gained.join(base.select("bullet_id"), "bullet_id", "left_anti").orderBy(F.desc("graph_score"), "bullet_id").limit(expand)
    fresh = fresh.join(bullets.select("bullet_id"), "bullet_id", "left_semi").select("bullet_id", (weight * F.col("graph_score")).alias("score"), F.lit(True).alias("is_new"))
    return old.unionByName(fresh).orderBy(F.desc("score"), "bullet_id").limit(limit)


def topic_score(title: Column, summary: Column, query: str) -> Column:
    """In [0, 1], from exact and fuzzy score of a page's title and summary."""
    both = F.concat_ws(" ", title, summary)
    return F.least(F.lit(1.0), (exact_score(both, query) + fuzzy_score(both, query)) / F.lit(70.0))


def topic_first(pages: DataFrame, bullets: DataFrame, query: str, now: Column, cfg=TOPICS, backing: int = 3) -> DataFrame | None:
    """The best page that matches well enough and its best backing records, or None if no page does.

    One row comes to the driver: the head page without its ids, which stay a table."""
    ids = pages.select("id", F.explode("bullet_ids").alias("bullet_id"))
    head = pages.drop("bullet_ids").withColumn("page_score", topic_score(F.col("title"), F.col("summary"), query)).where(F.col("page_score") >= cfg.match).orderBy(F.desc("page_score"), "id").limit(1).collect()
    if not head:
        return None
    page = head[0]
    mine = bullets.join(ids.where(F.col("id") == page["id"]).select("bullet_id"), "bullet_id", "left_semi")
    best = top(scored(mine, query, now), backing).select("bullet_id", (F.lit(cfg.page_share * page["page_score"]) + F.lit(cfg.backing_share) * F.col("final_score")).alias("score"))
    own = bullets.sparkSession.createDataFrame([(page["id"], float(page["page_score"]))], "bullet_id string, score double")
    return own.unionByName(best)


def provisional(df: DataFrame, inbox: DataFrame, query: str, share: float = 0.5) -> DataFrame:
    """Results joined by pending inbox turns that hit exactly. Both: bullet_id, content, final_score and raw."""
    hit = exact_score(F.col("content"), query) / F.lit(RETRIEVAL.most_keyword_score) * share
    more = inbox.where("status = 'pending'").withColumn("raw", hit).where("raw > 0").select(F.col("id").alias("bullet_id"), "content", score.clamp(F.col("raw")).alias("final_score"), "raw")
    return df.select("bullet_id", "content", "final_score", "raw").unionByName(more).orderBy(F.desc("final_score"), F.desc("raw"), "bullet_id")


def stale_policy(df: DataFrame, policy: str, trust: str = "trust_score") -> DataFrame:
    """flag: nothing changes; demote: scores are multiplied by trust; drop: stale rows go."""
    if policy == "drop":
        return df.where(F.col("verified_status").isNull() | (F.col("verified_status") != "stale"))
    if policy == "demote":
        return df.withColumn("final_score", F.col("final_score") * F.coalesce(F.col(trust), F.lit(1.0))).orderBy(F.desc("final_score"), "bullet_id")
    return df


def render(df: DataFrame, template: str = "markdown") -> DataFrame:
    """One row, one text: the results of a bounded list in order."""
    line = {
        "xml": F.format_string('<memory id="%s" score="%.2f">%s</memory>', "bullet_id", "final_score", "content"),
        "plain": F.col("content"),
    }.get(template, F.format_string("- %s (%.2f)", "content", "final_score"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("final_score")).alias("k"), F.col("bullet_id").alias("b"), line.alias("t"))))
    body = F.array_join(F.transform(rows, lambda r: r["t"]), "\n")
    return df.agg((F.concat(F.lit("<memories>\n"), body, F.lit("\n</memories>")) if template == "xml" else body).alias("context"))
