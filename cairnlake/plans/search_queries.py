"""Queries: scans, predicates, ranked search, aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import DECAY
from ..functions import score, text
from ..operators import graph, search, textindex
from ..sources import scratch
from . import sqltext, views
from .registry import query
from .views import BULLETS, EDGES, NOW, TEAM, bullets, now, table, team

Q, SCOPE = "anea ther", "project:fr"
_RAW = "([^A-Za-z0-9_]|^)"


def _exact_sql(words) -> str:
    return " + ".join(f"CAST(regexp_matches(content, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') AS INTEGER)" for w in words)


SCORED = f"""{BULLETS}, words AS (
  SELECT doc_id, list_filter({sqltext.english_words("content")}, lambda w: starts_with(w, 'an') OR starts_with(w, 'th')) AS near FROM bullets
), hits AS (
  SELECT doc_id, CAST(list_contains(stems, 'anea') AS INTEGER) + CAST(list_contains(stems, 'ther') AS INTEGER) AS n
  FROM (SELECT doc_id, list_transform(near, lambda w: {sqltext.stem("w")}) AS stems FROM words)
), keyed AS (
  SELECT b.*, 15.0::DOUBLE * ({_exact_sql(["anea", "ther"])}) + least(10.0::DOUBLE, h.n / 2.0::DOUBLE * 10.0::DOUBLE) AS keyword_score FROM bullets b JOIN hits h USING (doc_id)
), scored AS (
  SELECT *, least(keyword_score / 35.0::DOUBLE, 1.0) * greatest(0, least(1, decay_weight)) * CASE WHEN age <= 7 THEN 1.2 ELSE 1.0 END
    * CASE WHEN scope = '{SCOPE}' THEN 1.5 ELSE 1.0 END AS raw FROM keyed WHERE scope IN ('{SCOPE}', 'global')
)"""
_LAST = "least(1.0, greatest(0.0, raw))"


@query(
    "g5_hybrid_search",
    f"""WITH {SCORED}, best AS (SELECT * FROM scored ORDER BY raw DESC, bullet_id LIMIT 20),
seen AS (SELECT *, {_LAST} AS final_score, CAST(length(content) / 4.0::DOUBLE AS DOUBLE) AS t FROM best),
ran AS (SELECT *, row_number() OVER w AS rank, sum(CAST(floor(t) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM seen WINDOW w AS (ORDER BY final_score DESC, raw DESC, bullet_id))
SELECT bullet_id, keyword_score, round(final_score, 6) AS final_score, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS tokens_used FROM ran WHERE rank <= 5 AND (rank = 1 OR used <= 4096)""",
)
def hybrid_search(spark, d):
    """The flagship: hybrid keyword search with decay, recency and scope, top 20, trimmed to a token budget."""
    out = search.search(bullets(spark, d), Q, now(), SCOPE)
    return out.select("bullet_id", "keyword_score", F.round("final_score", 6).alias("final_score"), "rank", "tokens_used")


_QUERY_TABLE = f"""{BULLETS}, cw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+'))) AS w FROM bullets),
qw AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+(?:''[a-z]+)?'), lambda w: NOT list_contains({sqltext.flat_list(sorted(text.QUERY_STOPWORDS))}, w)))) AS w FROM benchmark),
exact AS (SELECT item_id, doc_id, count(*) AS n FROM qw JOIN cw USING (w) GROUP BY 1, 2),
cs AS (SELECT DISTINCT doc_id, {sqltext.stem("w")} AS s FROM (SELECT doc_id, unnest({sqltext.english_words("content")}) AS w FROM bullets)),
qt AS (SELECT item_id, {sqltext.stem("w")} AS s FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: NOT list_contains({sqltext.flat_list(sorted(text.TOKEN_STOPWORDS))}, w))) AS w FROM benchmark)),
qs AS (SELECT item_id, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS total FROM qt GROUP BY item_id, s),
fuzzy AS (SELECT item_id, doc_id, least(10.0::DOUBLE, sum(n) / CAST(any_value(total) AS DOUBLE) * 10.0::DOUBLE) AS f FROM qs JOIN cs USING (s) GROUP BY 1, 2),
qm AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(translate(text, ',;:|/\\', '      ')), '\\s+'), lambda w: w <> '')) AS t FROM benchmark),
tool AS (SELECT DISTINCT item_id, doc_id FROM qm JOIN bullets ON starts_with(lower(related_tools[1]), t)), entity AS (SELECT DISTINCT item_id, doc_id FROM qm JOIN bullets ON starts_with(lower(key_entities[1]), t)),
tag AS (SELECT DISTINCT item_id, doc_id FROM qm JOIN (SELECT doc_id, unnest(tags) AS tag FROM bullets) ON lower(tag) = t),
every AS (SELECT item_id, doc_id FROM exact UNION SELECT item_id, doc_id FROM fuzzy UNION SELECT * FROM tool UNION SELECT * FROM entity UNION SELECT * FROM tag),
kw AS (SELECT e.item_id, e.doc_id, coalesce(x.n, 0) * 15.0::DOUBLE + coalesce(f, 0.0::DOUBLE) + (CASE WHEN t.doc_id IS NULL THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END + CASE WHEN y.doc_id IS NULL THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END + CASE WHEN g.doc_id IS NULL THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END) AS keyword_score
 FROM every e LEFT JOIN exact x ON x.item_id = e.item_id AND x.doc_id = e.doc_id LEFT JOIN fuzzy z ON z.item_id = e.item_id AND z.doc_id = e.doc_id LEFT JOIN tool t ON t.item_id = e.item_id AND t.doc_id = e.doc_id
 LEFT JOIN entity y ON y.item_id = e.item_id AND y.doc_id = e.doc_id LEFT JOIN tag g ON g.item_id = e.item_id AND g.doc_id = e.doc_id),
raws AS (SELECT item_id, bullet_id, keyword_score, least(keyword_score / 35.0::DOUBLE, 1.0) * greatest(0, least(1, decay_weight)) * CASE WHEN age <= 7 THEN 1.2 ELSE 1.0 END AS raw FROM kw JOIN bullets USING (doc_id))"""


@query(
    "g5_query_table",
    f"WITH {_QUERY_TABLE} SELECT item_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, bullet_id, round(keyword_score, 6) AS keyword_score, round(raw, 6) AS raw FROM raws WHERE raws.raw > 0 WINDOW w AS (PARTITION BY item_id ORDER BY raws.raw DESC, bullet_id) QUALIFY row_number() OVER w <= 20",
)
def query_table(spark, d):
    """Every text of the benchmark as a query: one index of the records, one search of all queries."""
    path = f"{scratch.folder(spark)}/cairnlake/index-{uuid.uuid4().hex}"
    b = bullets(spark, d)
    textindex.build(b, path)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = textindex.search_table(queries, b, path, now())
    return out.select("query_id", "rank", "bullet_id", F.round("keyword_score", 6).alias("keyword_score"), F.round("raw", 6).alias("raw"))


@query("g1_exact_scores", f"WITH {BULLETS} SELECT bullet_id, 15.0::DOUBLE * ({_exact_sql(['anea', 'ther'])}) AS exact_score FROM bullets")
def exact_scores(spark, d):
    return bullets(spark, d).select("bullet_id", search.exact_score(F.col("content"), Q).alias("exact_score"))


@query("g2_fuzzy_scores", f"WITH {SCORED} SELECT CAST(doc_id AS VARCHAR) AS bullet_id, least(10.0::DOUBLE, n / 2.0::DOUBLE * 10.0::DOUBLE) AS fuzzy_score FROM hits")
def fuzzy_scores(spark, d):
    return bullets(spark, d).select("bullet_id", search.fuzzy_score(F.col("content"), Q).alias("fuzzy_score"))


@query(
    "g3_metadata_scores",
    f"""WITH {BULLETS} SELECT bullet_id, CASE WHEN related_tools[1] LIKE 'do%' OR related_tools[1] LIKE 'git%' THEN 4.0 ELSE 0.0 END
 + CASE WHEN key_entities[1] LIKE 'entity_4%' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN list_contains(list_transform(tags, lambda t: lower(t)), 'src3') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS metadata_score FROM bullets""".replace("4.0 ELSE 0.0 END", "4.0::DOUBLE ELSE 0.0::DOUBLE END").replace("'entity_4%'", "'entity@_4%' ESCAPE '@'"),
)
def metadata_scores(spark, d):
    s = search.metadata_score("do git; Entity_4 | SRC3", F.col("related_tools"), F.col("key_entities"), F.col("tags"))
    return bullets(spark, d).select("bullet_id", s.alias("metadata_score"))


@query("m12_blended_scores", f"WITH {SCORED} SELECT bullet_id, round(raw, 6) AS raw, round({_LAST}, 6) AS final_score FROM scored")
def blended(spark, d):
    return search.scored(bullets(spark, d), Q, now(), SCOPE).select("bullet_id", F.round("raw", 6).alias("raw"), F.round("final_score", 6).alias("final_score"))


_SEM = """sem AS (
  SELECT CAST(a.vec_id AS VARCHAR) AS bullet_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim
  FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query(
    "g4_semantic_blend",
    f"""WITH {SCORED}, {_SEM}, both_s AS (
  SELECT b.bullet_id, (least(keyword_score / 35.0::DOUBLE, 1.0) * 0.6 + greatest(0, least(1, coalesce(CASE WHEN sim IS NULL THEN 0 WHEN sim < 0 THEN greatest(0, (sim + 1) / 2) ELSE least(sim, 1) END, 0))) * 0.4)
    * decay_weight * CASE WHEN age <= 7 THEN 1.2 ELSE 1.0 END * CASE WHEN scope = '{SCOPE}' THEN 1.5 ELSE 1.0 END AS raw
  FROM keyed b LEFT JOIN sem USING (bullet_id) WHERE scope IN ('{SCOPE}', 'global'))
SELECT bullet_id, round(raw, 6) AS raw FROM both_s ORDER BY both_s.raw DESC, bullet_id LIMIT 20""",
)
def semantic_blend(spark, d):
    v = table(spark, d, "embeddings")
    q = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    sim = score.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q]))
    sem = v.select(F.col("vec_id").cast("string").alias("bullet_id"), score.vector_score(sim).alias("similarity"))
    return search.top(search.scored(bullets(spark, d), Q, now(), SCOPE, sem), 20).select("bullet_id", F.round("raw", 6).alias("raw"))


@query("f1_scope_union", f"WITH {BULLETS} SELECT bullet_id, scope FROM bullets WHERE scope IN ('{SCOPE}', 'global')")
def scope_union(spark, d):
    return search.in_scope(bullets(spark, d), SCOPE).select("bullet_id", "scope")


@query("f2_scope_and_type", f"WITH {BULLETS} SELECT bullet_id, scope, knowledge_type FROM bullets WHERE scope = '{SCOPE}' AND knowledge_type = 'trick'")
def scope_and_type(spark, d):
    return bullets(spark, d).where((F.col("scope") == SCOPE) & (F.col("knowledge_type") == "trick")).select("bullet_id", "scope", "knowledge_type")


@query("f4_active_team", f"WITH {TEAM} SELECT team_id, status FROM team WHERE status IN ('staging', 'approved')")
def active_team(spark, d):
    return team(spark, d).where(F.col("status").isin("staging", "approved")).select("team_id", "status")


@query("f6_tag_subscription", f"WITH {TEAM} SELECT team_id, list_has_any(list_transform(tags, lambda t: lower(t)), ['rust', 'sql']) AS subscribed FROM team")
def tag_subscription(spark, d):
    low = F.transform("tags", lambda t: F.lower(t))
    return team(spark, d).select("team_id", F.arrays_overlap(low, F.array(F.lit("rust"), F.lit("sql"))).alias("subscribed"))


@query("f7_stale_by_subscription", f"WITH {TEAM} SELECT team_id FROM team WHERE NOT list_has_any(list_transform(tags, lambda t: lower(t)), ['rust', 'sql'])")
def stale_by_subscription(spark, d):
    low = F.transform("tags", lambda t: F.lower(t))
    return team(spark, d).where(~F.arrays_overlap(low, F.array(F.lit("rust"), F.lit("sql")))).select("team_id")


@query("s1_store_scan", f"WITH {BULLETS} SELECT bullet_id, length(content) AS n FROM bullets WHERE list_contains(tags, 'src1')")
def store_scan(spark, d):
    return bullets(spark, d).where(F.array_contains("tags", "src1")).select("bullet_id", F.length("content").cast("long").alias("n"))


@query("s3_point_lookup", f"WITH {BULLETS} SELECT bullet_id, scope, section, recall_count FROM bullets WHERE bullet_id = '42'")
def point_lookup(spark, d):
    return bullets(spark, d).where("bullet_id = '42'").select("bullet_id", "scope", "section", "recall_count")


@query("s4_ordered_lookup", f"WITH {BULLETS}, ids AS (SELECT * FROM (VALUES (0, '17'), (1, 'none'), (2, '3'), (3, '17')) t(pos, bullet_id)) SELECT pos, ids.bullet_id, section FROM ids LEFT JOIN bullets b ON b.bullet_id = ids.bullet_id")
def ordered_lookup(spark, d):
    from ..sources import store

    return store.lookup(bullets(spark, d), ["17", "none", "3", "17"]).select("pos", "bullet_id", "section")


@query("s5_payload_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def payload_decode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("x9_token_estimates", "SELECT doc_id, CAST(floor(length(text) / 4.0::DOUBLE) AS INTEGER) AS tokens, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 4.0::DOUBLE) + 1 END AS INTEGER) AS prompt_tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.estimate_prompt_tokens(F.col("text")).alias("prompt_tokens"))


_DECAY = f"""WITH {BULLETS}, w AS (SELECT *, CASE WHEN recall_count >= 15 THEN 'permanent' WHEN age <= 7 THEN 'protected' WHEN decay_weight < 0.02 THEN 'archived' ELSE 'decayed' END AS status FROM bullets)"""


@query("m3_decay_weights", f"{_DECAY} SELECT bullet_id, round(decay_weight, 6) AS weight, status FROM w")
def decay_weights(spark, d):
    b = bullets(spark, d)
    return b.select("bullet_id", F.round("decay_weight", 6).alias("weight"), score.decay_status(F.col("created_at"), F.col("recall_count"), now()).alias("status"))


@query("a1_status", f"""WITH {BULLETS} SELECT section, knowledge_type, count(*) AS n, round(avg(decay_weight), 2) AS mean_weight FROM bullets GROUP BY GROUPING SETS ((section), (knowledge_type), ())""")
def status(spark, d):
    from ..operators import aggregates

    return aggregates.status(bullets(spark, d))


@query("a2_count_by_scope", f"WITH {BULLETS} SELECT coalesce(scope, 'unknown') AS value, count(*) AS n, round(avg(instructivity_score), 6) AS mean FROM bullets GROUP BY 1")
def count_by_scope(spark, d):
    from ..operators import aggregates

    return aggregates.count_by(bullets(spark, d), "scope", "instructivity_score")


@query(
    "a3_decay_sweep",
    f"""{_DECAY}, c AS (SELECT *, CASE WHEN status = 'permanent' THEN 'permanent' WHEN status = 'archived' THEN 'archived' WHEN abs(decay_weight - instructivity_score / 100) > 1e-4 THEN 'updated' ELSE 'unchanged' END AS outcome FROM w)
SELECT outcome, count(*) AS n FROM c GROUP BY 1""",
)
def decay_sweep(spark, d):
    from ..operators import aggregates

    b = bullets(spark, d).withColumn("current_weight", F.col("instructivity_score") / 100)
    return aggregates.sweep(b, now()).groupBy("outcome").agg(F.count("*").alias("n"))


@query("a6_index_report", f"""WITH {TEAM}, g AS (SELECT tags[1] AS tag, team_id, row_number() OVER (PARTITION BY tags[1] ORDER BY upvotes DESC, nominated_at, content, team_id) AS pos FROM team)
SELECT tag, string_agg(team_id, ',' ORDER BY pos) AS ids, count(*) AS n FROM g GROUP BY tag""")
def index_report(spark, d):
    t = team(spark, d).withColumn("tag", F.element_at("tags", 1))
    row = F.struct((-F.col("upvotes")).alias("a"), F.col("nominated_at").alias("b"), F.col("content").alias("c"), F.col("team_id").alias("id"))
    ordered = F.array_sort(F.collect_list(row))
    return t.groupBy("tag").agg(F.array_join(F.transform(ordered, lambda r: r["id"]), ",").alias("ids"), F.count("*").alias("n"))


@query("a7_backlog", f"""WITH {TEAM} SELECT count(*) AS n, round(max(epoch(TIMESTAMP '{NOW}') - epoch(nominated_at)) / 86400.0, 1) AS oldest_days, count(*) > 5 AS many, max(epoch(TIMESTAMP '{NOW}') - epoch(nominated_at)) / 86400.0 > 14 AS old FROM team WHERE status = 'staging'""")
def backlog(spark, d):
    from ..operators import aggregates

    return aggregates.backlog(team(spark, d), now(), 5, 14.0)


@query("m22_effective_scores", f"WITH {TEAM} SELECT team_id, least(100.0, greatest(0.0, instructivity_score + upvotes - downvotes)) AS effective FROM team")
def effective_scores(spark, d):
    return team(spark, d).select("team_id", score.effective_score(F.col("instructivity_score"), F.col("upvotes"), F.col("downvotes")).alias("effective"))


@query("m24_governance", f"WITH {TEAM} SELECT team_id, CASE WHEN list_has_any(list_transform(tags, lambda t: lower(t)), ['security', 'architecture', 'mandatory']) THEN 'curator_required' WHEN instructivity_score >= 90 THEN 'auto_approve' ELSE 'p2p_review' END AS tier FROM team")
def governance(spark, d):
    return team(spark, d).select("team_id", score.governance_tier(F.col("instructivity_score"), F.col("tags")).alias("tier"))


@query("f15_staging_timeout", f"WITH {TEAM} SELECT team_id, CASE WHEN status = 'staging' AND epoch(TIMESTAMP '{NOW}') - epoch(nominated_at) > 30 * 86400 THEN 'rejected' ELSE status END AS status FROM team")
def staging_timeout(spark, d):
    old = score.age_days(F.col("nominated_at"), now()) > 30
    return team(spark, d).select("team_id", F.when((F.col("status") == "staging") & old, "rejected").otherwise(F.col("status")).alias("status"))


@query("f11_nomination_candidates", f"WITH {BULLETS} SELECT bullet_id, recall_count, instructivity_score FROM bullets b WHERE recall_count >= 3 AND instructivity_score >= 70 AND NOT EXISTS (SELECT 1 FROM benchmark t WHERE t.item_id = b.doc_id)")
def nomination_candidates(spark, d):
    from ..operators import team as ops

    done = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("bullet_id"))
    return ops.nomination_candidates(bullets(spark, d), done).select("bullet_id", "recall_count", "instructivity_score")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("t6_vector_topk", f"SELECT vec_id, round(sim, 6) AS similarity FROM (SELECT a.vec_id, {_COS} AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY sim DESC, vec_id LIMIT 20) WHERE sim > 0.3")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return search.vector_topk(v, q, 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("t3_capacity_eviction", f"WITH {TEAM} SELECT team_id FROM team ORDER BY least(100.0, greatest(0.0, instructivity_score + upvotes - downvotes)) DESC, team_id LIMIT 25")
def capacity(spark, d):
    from ..operators import team as ops

    return ops.keep_best(team(spark, d), 25).select("team_id")


@query("t7_team_keyword", f"""WITH {TEAM}, s AS (SELECT team_id, CASE WHEN contains(lower(content), 'the that') THEN 1.0 ELSE greatest(
  len(list_intersect(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')), ['the', 'that'])) / 2.0::DOUBLE * 0.7::DOUBLE,
  0.0::DOUBLE) END AS score, least(100.0, greatest(0.0, instructivity_score + upvotes - downvotes)) AS eff FROM team WHERE status IN ('staging', 'approved'))
SELECT team_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, eff DESC, team_id LIMIT 15""")
def team_keyword(spark, d):
    return search.team_keyword(team(spark, d), "the that", 15).select("team_id", F.round("score", 6).alias("score"))


@query("t8_playbook_keyword", f"""WITH {TEAM}, s AS (SELECT *, CASE WHEN contains(lower(content), 'ther') THEN 1.0 ELSE 0.0 END AS score FROM team)
SELECT team_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, instructivity_score DESC, team_id LIMIT 15""")
def playbook_keyword(spark, d):
    return search.playbook_keyword(team(spark, d), "ther", 15).select("team_id", F.col("score").cast("double").alias("score"))


@query("j14_co_recall", f"WITH {EDGES} SELECT from_id, to_id, round(weight, 6) AS weight FROM edges")
def co_recall(spark, d):
    return views.co_recall_edges(spark, d).withColumn("weight", F.round("weight", 6))


@query("a8_degrees", f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id")
def degrees(spark, d):
    return graph.degrees(views.co_recall_edges(spark, d))


@query("a10_adjacency", f"WITH {EDGES} SELECT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v, round(max(weight), 6) AS weight FROM edges WHERE weight > 0.15 GROUP BY 1, 2")
def adjacency(spark, d):
    return graph.adjacency(views.co_recall_edges(spark, d), 0.15).withColumn("weight", F.round("weight", 6))


@query(
    "g7_graph_search",
    f"""WITH {SCORED}, {EDGES}, base AS (SELECT bullet_id, {_LAST} AS final_score FROM scored ORDER BY raw DESC, bullet_id LIMIT 20),
deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id),
gained AS (SELECT CAST(e.to_id AS VARCHAR) AS bullet_id, sum(b.final_score * e.weight / ln(d.degree + 2.0)) AS g FROM base b JOIN edges e ON CAST(e.from_id AS VARCHAR) = b.bullet_id JOIN deg d ON d.id = e.to_id GROUP BY 1 HAVING sum(b.final_score * e.weight / ln(d.degree + 2.0)) > 0),
old AS (SELECT b.bullet_id, b.final_score + 0.3 * coalesce(g, 0) AS score, false AS is_new FROM base b LEFT JOIN gained USING (bullet_id)),
fresh AS (SELECT bullet_id, 0.3 * g AS score, true AS is_new FROM gained WHERE bullet_id NOT IN (SELECT bullet_id FROM base) ORDER BY g DESC, bullet_id LIMIT 5)
SELECT bullet_id, round(score, 6) AS score, is_new FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) u ORDER BY u.score DESC, bullet_id LIMIT 20""",
)
def graph_search(spark, d):
    b = bullets(spark, d)
    base = search.top(search.scored(b, Q, now(), SCOPE), 20).select("bullet_id", "final_score")
    e = views.co_recall_edges(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "weight")
    return search.graph_search(base, b, e).withColumn("score", F.round("score", 6))


@query("c12_reinforcement", f"WITH {BULLETS}, {views.RECALLS} SELECT b.bullet_id, b.recall_count + coalesce(n, 0) AS recall_count FROM bullets b LEFT JOIN (SELECT doc_id, count(*) AS n FROM recalls GROUP BY 1) r USING (doc_id)")
def reinforcement(spark, d):
    from ..operators import aggregates

    return aggregates.reinforce(bullets(spark, d), views.recalls(spark, d)).select("bullet_id", "recall_count")


@query("j15_vector_adjacency", "SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3")
def vector_adjacency(spark, d):
    return graph.vector_adjacency(table(spark, d, "embeddings"), 0.3).select("u", "v")


@query("g9_louvain")
def louvain(spark, d):
    return graph.vector_communities(table(spark, d, "embeddings"), 0.3)


@query("g10_clusters")
def cluster(spark, d):
    return graph.clusters(graph.vector_communities(table(spark, d, "embeddings"), 0.3))
