"""Queries: the rest of the inventory: predicates, payloads, small functions, reports, queue states, lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import privacy, score, text, udfs
from ..operators import aggregates, curate, federate, graph, mine, search, simjoin, topics, verify
from ..operators import team as ops
from ..sources import scratch, store
from ..sources.records import RecordTable, pull
from ..streaming import inbox as queue
from . import sqltext, views
from .registry import query
from .search_queries import Q, SCOPE, SCORED
from .team_queries import _greedy, _pages, _pools, _sims, shadow_sql, verification
from .views import ANCHORS, BULLETS, EDGES, INTERACTIONS, NOW, TEAM, bullets, interactions, now, table, team

# ---- derived tables of this module -------------------------------------------------------------------------------


def inbox(spark, d):
    """Turns as queue entries, with states and times by arithmetic."""
    c, k = table(spark, d, "conversations"), F.col("conv_id") * 7 + F.col("turn")
    at = now() - F.make_dt_interval(mins=(k % 600).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "in_progress", "consumed", "skipped")]), (k % 4 + 1).cast("int"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("turn_offset"), "role", F.col("text").alias("content"),
        at.alias("timestamp"), status.alias("status"), F.when(k % 4 == 2, at + F.make_dt_interval(mins=F.lit(30))).alias("consumed_at"),
    )


INBOX = f"""inbox AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS conversation_id, turn AS turn_offset, role, text AS content,
  TIMESTAMP '{NOW}' - to_minutes(CAST((conv_id * 7 + turn) % 600 AS INTEGER)) AS timestamp, ['pending', 'in_progress', 'consumed', 'skipped'][CAST((conv_id * 7 + turn) % 4 + 1 AS INTEGER)] AS status,
  CASE WHEN (conv_id * 7 + turn) % 4 = 2 THEN TIMESTAMP '{NOW}' - to_minutes(CAST((conv_id * 7 + turn) % 600 - 30 AS INTEGER)) END AS consumed_at FROM conversations)"""


def records(spark, d):
    """Bullets with the columns of lineage and verification."""
    b, k = bullets(spark, d), F.col("doc_id")
    return b.withColumn("deleted_at", F.when(k % 9 == 0, now())).withColumn("verified_status", F.element_at(F.array(F.lit("verified"), F.lit("stale"), F.lit(None).cast("string"), F.lit("unverifiable")), (k % 4 + 1).cast("int")))


RECORDS = f"""{BULLETS}, records AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN TIMESTAMP '{NOW}' END AS deleted_at, ['verified', 'stale', NULL, 'unverifiable'][CAST(doc_id % 4 + 1 AS INTEGER)] AS verified_status FROM bullets)"""

# ---- predicates ---------------------------------------------------------------------------------------------------


@query("f3_live_rows", f"WITH {RECORDS} SELECT bullet_id FROM records WHERE deleted_at IS NULL")
def live_rows(spark, d):
    return store.purge(records(spark, d)).select("bullet_id")


@query("f5_active_nodes", f"WITH {RECORDS} SELECT bullet_id FROM records WHERE deleted_at IS NULL AND decay_weight > 0.1")
def active_nodes(spark, d):
    return records(spark, d).where("deleted_at is null and decay_weight > 0.1").select("bullet_id")


@query("f9_stale_only", f"WITH {RECORDS} SELECT bullet_id FROM records WHERE verified_status IS NULL OR verified_status = 'stale'")
def stale_only(spark, d):
    return records(spark, d).where("verified_status is null or verified_status = 'stale'").select("bullet_id")


@query("f14_routing", f"""WITH {INTERACTIONS} SELECT conv_id, turn_offset, CASE WHEN {sqltext.is_correction('user_message')} THEN 'realtime' ELSE 'inbox' END AS route FROM interactions""")
def routing(spark, d):
    return interactions(spark, d).select("conv_id", "turn_offset", F.when(mine.is_correction(F.col("user_message")), "realtime").otherwise("inbox").alias("route"))


@query("f16_purpose_gate", f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS ws FROM documents) SELECT doc_id, len(ws) > 0 AND (list_has_all(ws, ['that', 'with']) OR len(list_intersect(ws, ['queja', 'und', 'les', 'the', 'of'])) / 5.0::DOUBLE >= 0.4) AS nominated FROM t""")
def purpose_gate(spark, d):
    tokens = udfs.unicode_tokens(F.col("text"))
    gate = ops.in_purpose(F.col("tokens"), [["that", "with"]], udfs.literal_unicode_tokens("queja und les the of"), 0.4)
    return table(spark, d, "documents").select("doc_id", tokens.alias("tokens")).select("doc_id", gate.alias("nominated"))


@query("f17_active_overrides", f"WITH o AS (SELECT user_id AS id, arg_max(ts, (ts, event_id)) AS expires FROM events GROUP BY 1) SELECT id, expires FROM o WHERE expires > TIMESTAMP '2024-01-30 00:00:00'")
def active_overrides(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("reason"), F.col("ts").alias("expires"), F.struct("ts", "event_id").alias("seq"))
    return ops.active_overrides(e, F.to_timestamp(F.lit("2024-01-30 00:00:00"))).select("id", "expires")


# ---- payloads, projections, small functions ------------------------------------------------------------------------


@query("s6_payload_encode", f"WITH {BULLETS} SELECT bullet_id, CAST(to_json(tags) AS VARCHAR) AS tags, section, CAST(recall_count AS VARCHAR) AS recall_count FROM bullets")
def payload_encode(spark, d):
    p = store.to_payload(bullets(spark, d).select("bullet_id", "tags", "section", "recall_count"), ["tags", "section", "recall_count"])
    get = lambda k: F.col("metadata")[store.PREFIX + k].alias(k)
    return p.select("bullet_id", get("tags"), get("section"), get("recall_count"))


@query("s5_payload_round_trip", f"WITH {BULLETS} SELECT bullet_id, section, array_to_string(tags, ',') AS tags, recall_count FROM bullets")
def payload_round_trip(spark, d):
    p = store.to_payload(bullets(spark, d).select("bullet_id", "tags", "section", "recall_count"), ["tags", "section", "recall_count"])
    return store.from_payload(p).select("bullet_id", "section", F.array_join("tags", ",").alias("tags"), "recall_count")


@query("s7_search_projection", f"WITH {BULLETS} SELECT bullet_id, md5(content) AS content_md5, scope, round(decay_weight, 6) AS decay_weight, created_at FROM bullets")
def search_projection(spark, d):
    return bullets(spark, d).select("bullet_id", F.md5("content").alias("content_md5"), "scope", F.round("decay_weight", 6).alias("decay_weight"), "created_at")


@query("s17_index_markdown", f"""WITH {TEAM}, l AS (SELECT tags[1] AS tag, '- ' || regexp_replace(left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 120), '([\\\\*`\\[\\]_])', '\\\\\\1', 'g') AS line, row_number() OVER (PARTITION BY tags[1] ORDER BY upvotes DESC, nominated_at, content, team_id) AS pos FROM team)
SELECT tag, '## ' || tag || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS page FROM l GROUP BY tag""")
def index_markdown(spark, d):
    t = team(spark, d).withColumn("tag", F.element_at("tags", 1))
    row = F.struct((-F.col("upvotes")).alias("a"), F.col("nominated_at").alias("b"), F.col("content").alias("c"), F.col("team_id").alias("e"), F.concat(F.lit("- "), text.escape_markdown(F.col("content"))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"])
    return t.groupBy("tag").agg(F.concat(F.lit("## "), F.col("tag"), F.lit("\n"), F.array_join(lines, "\n")).alias("page"))


@query("s20_front_matter", f"""WITH {TEAM} SELECT team_id, 'team_id: "' || team_id || '"' || chr(10) || 'upvotes: ' || CAST(upvotes AS VARCHAR) AS header, content AS body FROM team""")
def front_matter(spark, d):
    v = store.with_front_matter(team(spark, d).select("team_id", "upvotes", "content"), ["team_id", "upvotes"])
    part = store.front_matter(F.col("value"))
    return v.select("team_id", part["header"].alias("header"), part["body"].alias("body"))


@query("x7_unicode_tokens", "SELECT item_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))) AS INTEGER) AS n FROM benchmark")
def unicode_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(udfs.unicode_tokens(F.col("text"))).alias("n"))


@query("x14_snippets", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS m FROM documents) SELECT doc_id, CASE WHEN length(m) <= 12 THEN left(m, 4) || '...' ELSE left(m, 8) || '...' || right(m, 4) END AS snippet FROM m")
def snippets(spark, d):
    pattern = dict((n, p) for n, p, _ in privacy.PATTERNS)["email"]
    return table(spark, d, "documents").select("doc_id", F.explode(privacy.audit(F.col("text"), pattern, "email")).alias("m")).select("doc_id", "m.snippet")


@query("x16_first_lines", "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, md5(CASE WHEN len(ls) <= 3 THEN text ELSE array_to_string(list_slice(ls, 1, 3), chr(10)) || chr(10) || '...' END) AS cut_md5 FROM l")
def first_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncate_lines(F.col("text"), 3)).alias("cut_md5"))


@query("x21_versions", """WITH m AS (SELECT doc_id, list_concat(list_concat(
  list_transform(regexp_extract_all(text, '([a-zA-Z][\\p{L}\\p{N}_.-]*)@(\\d+(?:\\.\\d+){0,2}(?:-[\\p{L}\\p{N}_.]+)?)', 1), lambda x: x),
  list_transform(regexp_extract_all(text, '([a-zA-Z][\\p{L}\\p{N}_.-]*)\\s+(v?\\d+(?:\\.\\d+){0,2}(?:-[\\p{L}\\p{N}_.]+)?(?:\\.x)?)', 1), lambda x: x)),
  regexp_extract_all(text, '([a-zA-Z][\\p{L}\\p{N}_.-]*)\\s+v(\\d+(?:\\.\\d+){0,2}(?:-[\\p{L}\\p{N}_.]+)?)', 1)) AS ts FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(ts, lambda t: regexp_replace(lower(t), '\\.+$', '')), lambda t: length(t) >= 2 AND NOT list_contains(""" + sqltext.flat_list(text.VERSION_STOPWORDS) + """, t)))) AS INTEGER) AS n_tools FROM m""")
def versions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.versions(F.col("text"))).alias("n_tools"))


@query("x26_merged_sources", """WITH s AS (SELECT user_id, event_id % 40 AS turn_offset, ts, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY event_id) AS rn FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, turn_offset) AS a, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE rn = 1)
SELECT user_id, CAST(count(*) AS INTEGER) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM o WHERE n <= 10 OR a <= 5 OR a > n - 5 GROUP BY user_id""")
def merged_sources(spark, d):
    e = table(spark, d, "events")
    src = F.struct(F.col("event_id").alias("pos"), F.col("user_id").alias("conversation_id"), (F.col("event_id") % 40).alias("turn_offset"), F.col("ts").alias("timestamp"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(src)).alias("s"))
    merged = curate.merge_sources(F.col("s"), F.array().cast("array<struct<pos:bigint,conversation_id:bigint,turn_offset:bigint,timestamp:timestamp>>"), 10)
    return rows.withColumn("m", merged).select("user_id", F.size("m").alias("n"), F.element_at("m", 1)["timestamp"].alias("first_ts"), F.element_at("m", -1)["timestamp"].alias("last_ts"))


@query("x28_titles", """WITH h AS (SELECT doc_id, regexp_extract(string_split(text, chr(10))[1], '^(.+?)(?:[。！？]|[.!?] |$)', 1) AS head FROM documents), t AS (SELECT doc_id, trim(head) AS head, array_to_string(list_slice(regexp_extract_all(head, '[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_-]*'), 1, 8), ' ') AS title FROM h) SELECT doc_id, coalesce(nullif(title, ''), nullif(head, ''), 'Untitled Topic') AS title FROM t""")
def titles(spark, d):
    return table(spark, d, "documents").select("doc_id", topics.title_of(F.col("text")).alias("title"))


@query("x33_rendered", f"""WITH {TEAM}, b AS (SELECT team_id, content, instructivity_score / 100 AS s FROM team ORDER BY s DESC, team_id LIMIT 5) SELECT '<memories>' || chr(10) || string_agg('<memory id="' || team_id || '" score="' || printf('%.2f', s) || '">' || content || '</memory>', chr(10) ORDER BY s DESC, team_id) || chr(10) || '</memories>' AS context FROM b""")
def rendered(spark, d):
    t = team(spark, d).select(F.col("team_id").alias("bullet_id"), "content", (F.col("instructivity_score") / 100).alias("final_score"))
    return search.render(t.orderBy(F.desc("final_score"), "bullet_id").limit(5), "xml")


@query("x34_model_replies", "SELECT event_id, greatest(0, least(100, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 50.0))) AS score, coalesce(json_extract_string(props, '$.section'), 'general') AS section FROM events")
def model_replies(spark, d):
    """Model replies as fenced JSON, parsed with defaults."""
    from ..operators import llmio

    e = table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("reply"))
    return llmio.parsed(e, "reply", "k double, section string").select("event_id", score.clamp(F.coalesce("k", F.lit(50.0)), 0.0, 100.0).alias("score"), F.coalesce("section", F.lit("general")).alias("section"))


_COSQ = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("x35_vector_scores", f"SELECT a.vec_id, round(CASE WHEN {_COSQ} < 0 THEN greatest(0, ({_COSQ} + 1) / 2) ELSE least(1, {_COSQ}) END, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def vector_scores(spark, d):
    v = table(spark, d, "embeddings")
    q = [float(x) for x in v.where("vec_id = 1").first()["embedding"]]
    return v.select("vec_id", F.round(score.vector_score(score.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q]))), 6).alias("score"))


@query("x31_vector_tags", """WITH t AS (SELECT 'tag' || CAST(label AS VARCHAR) || '_' || CAST(vec_id AS VARCHAR) AS tag, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT 'canon' || CAST(label AS VARCHAR) AS best, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT tag, arg_max(best, (list_cosine_similarity(t.e, c.e), best)) AS best FROM t, c WHERE list_cosine_similarity(t.e, c.e) >= 0.3 GROUP BY tag""")
def vector_tags(spark, d):
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    canon = v.join(first, ["label", "vec_id"]).select(F.concat(F.lit("canon"), F.col("label").cast("string")).alias("tag"), "embedding")
    tags = v.select(F.concat(F.lit("tag"), F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string")).alias("tag"), "embedding")
    return ops.vector_tags(tags, canon, 0.3)


# ---- scores ---------------------------------------------------------------------------------------------------------


@query("m2_boosted_weights", f"WITH {BULLETS} SELECT bullet_id, round(least(1.0, greatest(0.0, pow(2.0, -age / 30.0) * (1 + 0.1 * recall_count))), 6) AS weight FROM bullets")
def boosted_weights(spark, d):
    age = score.age_days(F.col("created_at"), now())
    return bullets(spark, d).select("bullet_id", F.round(score.boosted(score.exponential_decay(age, 30.0), F.col("recall_count"), 0.1), 6).alias("weight"))


@query("m14_recency", f"WITH {BULLETS} SELECT bullet_id, CASE WHEN age <= 7 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS recency, CASE WHEN scope = '{SCOPE}' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS scope_boost FROM bullets")
def recency(spark, d):
    return bullets(spark, d).select("bullet_id", score.recency(F.col("created_at"), now()).alias("recency"), score.scope_boost(F.col("scope"), SCOPE).alias("scope_boost"))


@query("m16_instructivity", f"""WITH w AS (SELECT item_id, text, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS n FROM benchmark) SELECT item_id, round(60.0 * least(1.0, n / 20.0) + CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in score.ACTIONABLE)} THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '[./\\\\]') THEN 5 ELSE 0 END, 6) AS points FROM w""")
def instructivity(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(score.instructivity(F.col("text"), F.lit(0.6)), 6).alias("points"))


@query("m19_purpose_scores", """WITH t AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS ws FROM documents) SELECT doc_id, round(CASE WHEN list_contains(ws, 'und') THEN 0.3::DOUBLE WHEN list_has_all(ws, ['that', 'with']) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * 50, 6) AS points FROM t""")
def purpose_scores(spark, d):
    t = table(spark, d, "documents").select("doc_id", udfs.unicode_tokens(F.col("text")).alias("tokens"))
    return t.select("doc_id", F.round(score.purpose_adjusted(F.lit(50.0), F.col("tokens"), [["und"]], [["that", "with"]]), 6).alias("points"))


@query("m20_refined_scores", f"WITH {BULLETS} SELECT bullet_id, (instructivity_score + CAST((doc_id * 11) % 101 AS DOUBLE)) / 2 AS refined FROM bullets")
def refined_scores(spark, d):
    from ..operators import llmio

    b = bullets(spark, d)
    model = b.select("bullet_id", ((F.col("doc_id") * 11) % 101).cast("double").alias("model_score"))
    return llmio.refined(b, model, "bullet_id").select("bullet_id", "refined")


@query("m23_halved_scores", f"WITH {TEAM} SELECT team_id, instructivity_score - floor(instructivity_score / 2) AS halved FROM team")
def halved(spark, d):
    return team(spark, d).select("team_id", (F.col("instructivity_score") - F.floor(F.col("instructivity_score") / 2)).alias("halved"))


@query("m26_trust_scores", f"WITH {RECORDS} SELECT bullet_id, CASE verified_status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'stale' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS trust FROM records")
def trust(spark, d):
    return records(spark, d).select("bullet_id", score.trust_score(F.col("verified_status")).alias("trust"))


# ---- joins, merges, reports -----------------------------------------------------------------------------------------


@query("j2_edge_expansion", f"""WITH {SCORED}, {EDGES}, base AS (SELECT bullet_id, least(1.0, raw) AS s FROM scored ORDER BY raw DESC, bullet_id LIMIT 20), deg AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id)
SELECT e.to_id AS id, round(sum(b.s * e.weight / ln(n + 2.0)), 6) AS graph_score FROM base b JOIN edges e ON CAST(e.from_id AS VARCHAR) = b.bullet_id JOIN deg ON deg.id = e.to_id GROUP BY 1""")
def edge_expansion(spark, d):
    base = search.top(search.scored(bullets(spark, d), Q, now(), SCOPE), 20).select(F.col("bullet_id").cast("long").alias("from_id"), "final_score")
    e = views.co_recall_edges(spark, d)
    near = e.join(F.broadcast(base), "from_id").join(graph.degrees(e).withColumnRenamed("id", "to_id"), "to_id")
    return near.groupBy(F.col("to_id").alias("id")).agg(F.round(F.sum(F.col("final_score") * score.adamic_adar(F.col("weight"), F.col("degree"))), 6).alias("graph_score"))


@query("j4_topic_backing", f"WITH {BULLETS}, t AS (SELECT section AS id, unnest(list_slice(list_sort(list(bullet_id)), 1, 3)) AS bullet_id FROM bullets GROUP BY section) SELECT t.id, t.bullet_id, b.scope FROM t JOIN bullets b USING (bullet_id)")
def topic_backing(spark, d):
    b = bullets(spark, d)
    t = b.groupBy(F.col("section").alias("id")).agg(F.slice(F.array_sort(F.collect_list("bullet_id")), 1, 3).alias("ids"))
    return t.select("id", F.explode("ids").alias("bullet_id")).join(b.select("bullet_id", "scope"), "bullet_id")


@query("j12_shadow_merge", f"{shadow_sql(400)} SELECT id, source, CAST(rk AS INTEGER) AS rank FROM stays")
def shadow_merge(spark, d):
    t = ops.boosted(ops.pool_union(_pools(spark, d), 200), None)
    return federate.shadow_merge(t).select("id", "source", "rank")


@query("j17_override_hints", f"""WITH {TEAM}, o AS (SELECT 't' || CAST(user_id AS VARCHAR) AS team_id, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY 1) SELECT t.team_id, o.reason FROM team t LEFT JOIN o USING (team_id)""")
def override_hints(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("reason"), F.lit("2099-01-01").cast("timestamp").alias("expires"), F.struct("ts", "event_id").alias("seq"))
    o = ops.active_overrides(e, now()).select(F.col("id").alias("team_id"), "reason")
    return team(spark, d).select("team_id").join(o, "team_id", "left")


@query("a5_inbox_counts", f"""WITH {INBOX} SELECT CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending, count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
 count(*) FILTER (WHERE status = 'consumed' AND epoch(TIMESTAMP '{NOW}') - epoch(consumed_at) <= 3600) AS consumed_last_hour, CAST(epoch(TIMESTAMP '{NOW}') - epoch(min(timestamp) FILTER (WHERE status = 'pending')) AS BIGINT) AS oldest_pending_seconds FROM inbox""")
def inbox_counts(spark, d):
    return aggregates.inbox_counts(inbox(spark, d), now())


@query("a13_execution_report", f"""WITH {BULLETS}, {_sims('bullets', 'doc_id', 'content', 'scope')}, k AS (SELECT round(sim, 6) AS c FROM sims WHERE sim >= 0.5 AND sim < 1) SELECT CASE WHEN c >= 0.85 THEN 'supersede' ELSE 'review' END AS action, count(*) AS n FROM k GROUP BY 1""")
def execution_report(spark, d):
    pairs, members = simjoin.self_join(bullets(spark, d), text.word_set(F.col("content")), 0.5, "doc_id", "scope")
    out = curate.triaged(simjoin.counted(pairs.where("sim < 1"), members).withColumn("kind", F.lit("negation")))
    return out.groupBy("action").agg(F.sum("n").alias("n"))


@query("a14_erased_users", f"WITH {BULLETS} SELECT tags[2] AS owner, count(*) AS erased, (SELECT count(*) FROM bullets) - count(*) AS rest FROM bullets GROUP BY 1")
def erased_users(spark, d):
    b = bullets(spark, d)
    total = b.agg(F.count("*").alias("total"))
    return b.groupBy(F.element_at("tags", 2).alias("owner")).agg(F.count("*").alias("erased")).crossJoin(F.broadcast(total)).select("owner", "erased", (F.col("total") - F.col("erased")).alias("rest"))


@query("a16_pairs_compared", f"""WITH RECURSIVE {_sims('documents', 'doc_id', 'text')}, conf AS (SELECT a, b FROM sims WHERE sim >= 0.9), {_greedy()}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM sets),
lead AS (SELECT c.b AS id, min(c.a) AS seed FROM conf c JOIN kept k ON k.id = c.a WHERE c.b NOT IN (SELECT id FROM kept) GROUP BY c.b), s AS (SELECT r.id, r.pos, l.seed, p.pos AS seed_pos FROM r LEFT JOIN lead l ON l.id = r.id LEFT JOIN r p ON p.id = l.seed)
SELECT CAST(sum((SELECT count(*) FROM s j WHERE j.pos > i.pos AND (j.seed IS NULL OR j.seed_pos >= i.pos))) AS BIGINT) AS pairs_compared FROM s i WHERE i.seed IS NULL""")
def pairs_compared(spark, d):
    """How many pairs the ordered walk compares, in closed form from positions and seeds."""
    b = bullets(spark, d)
    roles = curate.consolidate(b, "doc_id")
    return curate.pairs_compared(b.select(F.col("doc_id").alias("id")), roles)


@query("w2_history_sizes", f"WITH {INTERACTIONS} SELECT conv_id, turn_offset, CAST(least(20, row_number() OVER (PARTITION BY conv_id ORDER BY turn_offset) - 1) AS INTEGER) AS n FROM interactions")
def history_sizes(spark, d):
    return mine.with_history(interactions(spark, d)).select("conv_id", "turn_offset", F.size("history").alias("n"))


@query("w8_unique_slugs", """WITH s AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, lower(regexp_extract(text, '[A-Za-z]+')) AS w FROM documents), t AS (SELECT id, CASE WHEN w = '' THEN 'untitled' ELSE left(w, 60) END AS t FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS rn FROM t) SELECT id, CASE WHEN rn = 1 THEN t ELSE t || '-' || id END AS slug FROM r""")
def unique_slugs(spark, d):
    """Documents under their first word as the title."""
    b = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("title"))
    return topics.unique_slugs(b).select("id", "slug")


@query("s11_edge_store", f"WITH {views.EDGES} SELECT from_id, to_id, round(weight, 6) AS weight FROM edges")
def edge_store(spark, d):
    """Co-recall edges kept in a record table: the recalls of each half of the log are one change, which adds to the weights of its edges."""
    log = views.recalls(spark, d)
    edges = RecordTable(spark, _place(spark, "edges"), "from_id bigint, to_id bigint, weight double", ["from_id", "to_id"])
    day = F.dayofmonth("day")
    add = lambda old, new: old.unionByName(new).groupBy("from_id", "to_id").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))
    for half in (day <= 15, day > 15):
        edges.change(graph.co_recall(log.where(half), ["user_id", "day"], "doc_id").select("from_id", "to_id", "weight"), add)
    return edges.read().withColumn("weight", F.round("weight", 6))


@query("e5_incremental_pull", """WITH f AS (SELECT user_id AS id, ts AS updated_at, event_type, CASE WHEN event_id % 11 = 0 THEN 'tombstone' ELSE 'approved' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, (event_id % 11 = 0) DESC) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT id, updated_at, event_type FROM f WHERE rn = 1 AND status <> 'tombstone'""")
def incremental_pull(spark, d):
    """A feed of changes by user, read in two pulls: the first ends in the middle of the month, the second begins at its cursor."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    feed = e.select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), "event_type", F.when(F.col("event_id") % 11 == 0, "tombstone").otherwise("approved").alias("status"))
    users = RecordTable(spark, _place(spark, "users"), f"id bigint, updated_at {dict(feed.dtypes)['updated_at']}, event_type string", ["id"])
    pull(users, feed.where(F.dayofmonth("updated_at") <= 15))
    pull(users, feed)
    return users.read()


def _place(spark, name: str) -> str:
    return f"{scratch.folder(spark)}/cairnlake/{name}-{uuid.uuid4().hex}"


@query("t1_topk", f"WITH {SCORED} SELECT bullet_id, round(raw, 6) AS raw FROM scored ORDER BY scored.raw DESC, bullet_id LIMIT 80")
def topk(spark, d):
    return search.top(search.scored(bullets(spark, d), Q, now(), SCOPE), 80).select("bullet_id", F.round("raw", 6).alias("raw"))


@query("t5_claimed", f"WITH {INBOX} SELECT id, timestamp FROM inbox WHERE status = 'pending' ORDER BY timestamp, id LIMIT 10")
def claimed(spark, d):
    return queue.claim(inbox(spark, d), 10).select("id", "timestamp")


@query("t10_provisional_hits", f"""WITH {INBOX}, h AS (SELECT id, (CAST(regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])anea($|[^A-Za-z0-9_])') AS INTEGER) + CAST(regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS INTEGER) * 0) * 15 / 35.0 * 0.5 AS raw FROM inbox WHERE status = 'pending') SELECT id AS bullet_id, round(raw, 6) AS raw FROM h WHERE raw > 0""")
def provisional_hits(spark, d):
    none = bullets(spark, d).where("false").select("bullet_id", "content", F.lit(0.0).alias("final_score"), F.lit(0.0).alias("raw"))
    return search.provisional(none, inbox(spark, d), "anea").select("bullet_id", F.round("raw", 6).alias("raw"))


@query("u3_tag_difference", f"WITH {BULLETS}, {TEAM}, a AS (SELECT DISTINCT unnest(tags) AS tag FROM bullets), b AS (SELECT DISTINCT unnest(tags) AS tag FROM team) SELECT tag, tag IN (SELECT tag FROM b) AS shared FROM a")
def tag_difference(spark, d):
    a = bullets(spark, d).select(F.explode("tags").alias("tag")).distinct()
    b = team(spark, d).select(F.explode("tags").alias("tag")).distinct().withColumn("in_b", F.lit(True))
    return a.join(b, "tag", "left").select("tag", F.coalesce("in_b", F.lit(False)).alias("shared"))


@query("u4_distinct_ids", f"WITH {views.RECALLS} SELECT DISTINCT doc_id FROM recalls")
def distinct_ids(spark, d):
    return views.recalls(spark, d).select("doc_id").distinct()


@query("u5_orphan_pages", f"WITH {BULLETS} SELECT 'page_' || section || '_' || knowledge_type AS id FROM bullets GROUP BY section, knowledge_type HAVING max(recall_count) < 19")
def orphan_pages(spark, d):
    b = bullets(spark, d)
    pages = b.groupBy("section", "knowledge_type").agg(F.max("recall_count").alias("m")).select(F.concat_ws("_", F.lit("page"), "section", "knowledge_type").alias("id"), F.concat_ws("/", "section", "knowledge_type").alias("source_hash"), "m")
    ran = pages.where("m >= 19").select("id", "source_hash")
    return topics.orphans(pages, ran)


@query("g6_topic_first")
def topic_first(spark, d):
    pages = _pages(spark, d)
    head = pages.orderBy("id").first()
    query_text = " ".join(head["title"].split()[:3]) if head else Q
    out = search.topic_first(pages, bullets(spark, d), query_text, now(), backing=3)
    return out if out is not None else search.top(search.scored(bullets(spark, d), query_text, now()), 4).select("bullet_id", F.col("final_score").alias("score"))


@query("g8_retrieval_pipeline", f"""WITH {SCORED}, best AS (SELECT *, least(1.0, raw) AS f FROM scored ORDER BY raw DESC, bullet_id LIMIT 20), ran AS (SELECT *, row_number() OVER w AS rn, sum(CAST(floor(length(content) / 4.0) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM best WINDOW w AS (ORDER BY f DESC, raw DESC, bullet_id)),
{ANCHORS}, st AS (SELECT CAST(bullet_key AS VARCHAR) AS bullet_id, CASE WHEN c.content IS NULL THEN 0.7 WHEN NOT contains(c.content, anchor_text) THEN 0.3 ELSE 1.0 END AS trust FROM anchors LEFT JOIN files c USING (file_path))
SELECT bullet_id, round(f * coalesce(trust, 1.0), 6) AS final_score FROM ran LEFT JOIN st USING (bullet_id) WHERE rn <= 5 AND (rn = 1 OR used <= 4096)""")
def retrieval_pipeline(spark, d):
    """Search, trim, verify the few rows that are left, demote by trust."""
    found = search.search(bullets(spark, d), Q, now(), SCOPE).select(F.col("bullet_id").alias("id"), "final_score", F.lit(None).cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verified_status"))
    status = verification(spark, d).withColumn("id", F.col("id").cast("string"))
    out = verify.with_trust(found, status, now()).withColumnRenamed("id", "bullet_id")
    return search.stale_policy(out, "demote").select("bullet_id", F.round("final_score", 6).alias("final_score"))


@query("c2_merged_content", """WITH p AS (SELECT a.item_id, a.text AS c, b.text AS e FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), s AS (SELECT item_id, list_filter(list_transform(list_filter(list_concat(string_split(replace(e, chr(10), '. '), '. '), string_split(replace(c, chr(10), '. '), '. ')), lambda t: trim(t) <> ''), lambda t: trim(regexp_replace(t, '\\.+$', ''))), lambda t: t <> '') AS parts FROM p)
SELECT item_id AS pair_id, array_to_string(list_filter(parts, lambda t, i: list_position(list_transform(parts, lambda z: lower(z)), lower(t)) = i), ' ') AS content FROM s""")
def merged_content(spark, d):
    b = table(spark, d, "benchmark")
    blank = [F.array().cast("array<string>").alias(f"{p}_{k}") for p in ("c", "e") for k in ("tools", "entities", "tags")]
    pairs = b.select(F.col("item_id").alias("pair_id"), F.col("text").alias("c_content")).join(b.select((F.col("item_id") - 1).alias("pair_id"), F.col("text").alias("e_content")), "pair_id")
    pairs = pairs.select("*", F.lit(1.0).alias("c_score"), F.lit(2.0).alias("e_score"), F.lit(0).alias("e_recall"), *blank)
    return curate.merged(pairs, "merge_content").select("pair_id", "content")


@query("c4_executed_merges", f"""WITH {RECORDS}, g AS (SELECT bullet_id AS id, section AS grp, first_value(bullet_id) OVER (PARTITION BY section ORDER BY recall_count DESC, created_at DESC, bullet_id) AS w FROM records WHERE deleted_at IS NULL)
SELECT r.bullet_id AS id, r.deleted_at IS NOT NULL OR g.w IS NULL OR g.w <> r.bullet_id AS gone, CASE WHEN x.w <> r.bullet_id THEN x.w END AS superseded_by FROM records r LEFT JOIN g ON g.id = r.bullet_id LEFT JOIN (SELECT DISTINCT grp, w FROM g) x ON x.grp = r.section""")
def executed_merges(spark, d):
    r = records(spark, d).select(F.col("bullet_id").alias("id"), "section", "recall_count", "created_at", "deleted_at", F.lit(None).cast("string").alias("superseded_by"))
    groups = r.select(F.col("section").alias("grp"), "id")
    won = curate.winners(groups, r)
    out = curate.executed(r, won, groups, r.where("false"), now())
    return out.select("id", F.col("deleted_at").isNotNull().alias("gone"), "superseded_by")


@query("c13_erased_rows", f"WITH {BULLETS} SELECT bullet_id FROM bullets WHERE tags[2] IS DISTINCT FROM 'src3'")
def erased_rows(spark, d):
    return store.erase_user(bullets(spark, d).withColumn("owner", F.element_at("tags", 2)), "owner", "src3").select("bullet_id")


@query("c15_rehydrated_anchors", r"""WITH l AS (SELECT page_id AS id, 'src/page_' || page_id || '.md' AS file_path, string_split_regex(html, '\r\n|\r|\n') AS lines FROM pages),
p AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, 'article')), true) AS nth FROM l),
w AS (SELECT id, file_path, array_to_string(list_slice(lines, greatest(nth - 1, 1), nth + 4), chr(10)) AS body FROM p WHERE nth > 0),
c AS (SELECT *, left(body, 200) AS head, length(left(body, 200)) - strpos(reverse(left(body, 200)), chr(10)) AS cut_at FROM w),
a AS (SELECT id, file_path, CASE WHEN length(body) <= 200 THEN body WHEN contains(head, chr(10)) AND cut_at > 20 THEN left(head, cut_at) ELSE head END AS anchor_text FROM c)
SELECT id, file_path, sha256(anchor_text) AS anchor_hash FROM a WHERE length(anchor_text) >= 20""")
def rehydrated(spark, d):
    """Anchors for records without any: texts that name a file of the table."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("see src/page_"), F.col("page_id").cast("string"), F.lit(".md and `article`")).alias("content"))
    f = table(spark, d, "pages").select(F.concat(F.lit("src/page_"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("html").alias("content"))
    return verify.extract_anchors(p, f, "page_id").select("id", "file_path", "anchor_hash")


@query("r6_source_refs", f"WITH {INTERACTIONS} SELECT conv_id, turn_offset, left(sha256(CASE WHEN assistant_message <> '' THEN assistant_message ELSE user_message END), 16) AS turn_hash, CASE WHEN assistant_message <> '' THEN 'assistant' ELSE 'user' END AS role FROM interactions")
def source_refs(spark, d):
    reply = F.col("assistant_message") != ""
    turn = F.when(reply, F.col("assistant_message")).otherwise(F.col("user_message"))
    return interactions(spark, d).select("conv_id", "turn_offset", F.substring(F.sha2(turn, 256), 1, 16).alias("turn_hash"), F.when(reply, "assistant").otherwise("user").alias("role"))


@query("r9_batch_due", f"WITH {INBOX} SELECT count(*) AS n, count(*) >= 10 OR (count(*) > 0 AND (epoch(TIMESTAMP '{NOW}') - epoch(min(timestamp))) / 3600.0 >= 4) AS due FROM inbox WHERE status = 'pending'")
def batch_due(spark, d):
    return mine.due(inbox(spark, d), now())


@query("e1_recovered_queue", f"WITH {INBOX} SELECT id, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status FROM inbox WHERE status <> 'consumed' OR epoch(TIMESTAMP '{NOW}') - epoch(consumed_at) <= 0.25 * 86400")
def recovered_queue(spark, d):
    return queue.recovered(queue.pruned(inbox(spark, d), now(), 0.25)).select("id", "status")
