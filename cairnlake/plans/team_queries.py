"""Queries: similarity joins, curation, federation, verification, topics, table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEAM as TEAM_CFG
from ..functions import score, text
from ..operators import curate, federate, graph, search, simjoin, topics, verify
from ..operators import team as ops
from ..sources import store
from . import sqltext, views
from .registry import query
from .views import ANCHORS, BULLETS, EDGES, NOW, TEAM, bullets, now, table, team


def _sims(table_name: str, key: str, column: str, same: str | None = None, prefix: str = "") -> str:
    """WITH parts: every pair a < b of word sets that share a word, with its similarity."""
    p = prefix
    extra = f", {same} AS grp" if same else ", '' AS grp"
    return f"""{p}sets AS (SELECT {key} AS id{extra}, {sqltext.word_set(column)} AS ws FROM {table_name}),
{p}tok AS (SELECT id, grp, len(ws) AS n, unnest(ws) AS tok FROM {p}sets),
{p}sims AS (SELECT a.id AS a, b.id AS b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS sim FROM {p}tok a JOIN {p}tok b ON a.tok = b.tok AND a.grp = b.grp AND a.id < b.id GROUP BY 1, 2)"""


@query("m7_similar_pairs", f"WITH {BULLETS}, {_sims('bullets', 'doc_id', 'content', 'scope')} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim >= 0.5")
def similar_pairs(spark, d):
    pairs, members = simjoin.self_join(bullets(spark, d), text.word_set(F.col("content")), 0.5, "doc_id", "scope")
    copies = members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("sim"))
    return simjoin.expand(pairs, members).unionByName(copies).select("a", "b", F.round("sim", 6).alias("sim"))


#: Stand-ins for the default negations, which the invented words of the test data do not have.
NEGATIONS = ("was", "est", "ist")


@query(
    "j6_conflicts",
    f"""WITH {BULLETS}, {_sims('bullets', 'doc_id', 'content', 'scope')}, near AS (SELECT s.a, s.b, s.sim, x.ws AS wa, y.ws AS wb, p.content AS ca, q.content AS cb
 FROM sims s JOIN sets x ON x.id = s.a JOIN sets y ON y.id = s.b JOIN bullets p ON p.doc_id = s.a JOIN bullets q ON q.doc_id = s.b WHERE sim BETWEEN 0.5 AND 0.8)
SELECT a, b, round(sim, 6) AS sim, CASE WHEN {' OR '.join(f"(list_contains(wa, '{x}') AND list_contains(wb, '{y}')) OR (list_contains(wa, '{y}') AND list_contains(wb, '{x}'))" for x, y in text.OPPOSITES)} THEN 'opposing_pair' ELSE 'negation_asymmetry' END AS reason FROM near
WHERE {' OR '.join(f"(list_contains(wa, '{x}') AND list_contains(wb, '{y}')) OR (list_contains(wa, '{y}') AND list_contains(wb, '{x}'))" for x, y in text.OPPOSITES)}
 OR list_has_any(wa, {sqltext.flat_list(NEGATIONS)}) <> list_has_any(wb, {sqltext.flat_list(NEGATIONS)})""",
)
def conflicts(spark, d):
    out = curate.conflicts(bullets(spark, d), "doc_id", negations=NEGATIONS)
    return out.select("a", "b", F.round("sim", 6).alias("sim"), "reason")


_CURATE = f"""WITH {BULLETS}, {TEAM}, c AS (SELECT doc_id, scope, {sqltext.word_set('content')} AS ws, content FROM bullets), t AS (SELECT doc_id, scope, len(ws) AS n, unnest(ws) AS tok FROM c),
e AS (SELECT item_id, {sqltext.word_set('content')} AS ws FROM team), s AS (SELECT item_id, len(ws) AS n, unnest(ws) AS tok FROM e),
m AS (SELECT a.doc_id AS cand, b.item_id AS target, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS sim FROM t a JOIN s b ON a.tok = b.tok AND a.scope = 'global' GROUP BY 1, 2),
best AS (SELECT cand, arg_max(target, (sim, -target)) AS target, max(sim) AS sim FROM m WHERE sim >= 0.3 GROUP BY 1)"""


def _curated(spark, d):
    """All records as candidates against the team's records as a store of scope global; the bound is low enough for the test data to have merges."""
    cands = bullets(spark, d).select(F.col("doc_id").alias("cand_id"), "content", "scope")
    return curate.curate(cands, team(spark, d).select(F.col("item_id").alias("bullet_key"), "content", F.lit("global").alias("scope")), 0.3)


@query("j5_curate", f"{_CURATE} SELECT c.doc_id AS cand_id, CASE WHEN trim(content) = '' THEN 'skip' WHEN target IS NOT NULL THEN 'merge' ELSE 'add' END AS action, target AS target_id, round(sim, 6) AS sim FROM c LEFT JOIN best ON cand = c.doc_id")
def curated(spark, d):
    return _curated(spark, d).withColumn("sim", F.round("sim", 6))


def _greedy(order: str = "id") -> str:
    """WITH parts: kept ids by a walk over the rows in order; a row goes if a kept one conflicts with it."""
    return f"""nbs AS (SELECT id, list(lo) AS los FROM (SELECT b AS id, a AS lo FROM conf) GROUP BY id),
walk AS (SELECT id, coalesce(los, []) AS los, row_number() OVER (ORDER BY {order}) AS nth FROM (SELECT DISTINCT a AS id FROM conf UNION SELECT b FROM conf) u LEFT JOIN nbs USING (id)),
g AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT w.nth, CASE WHEN list_has_any(g.kept, w.los) THEN g.kept ELSE list_append(g.kept, w.id) END FROM g JOIN walk w ON w.nth = g.nth + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY nth DESC LIMIT 1))"""


@query(
    "j10_consolidate",
    f"""WITH RECURSIVE {_sims('documents', 'doc_id', 'text')}, conf AS (SELECT a, b, sim FROM sims WHERE sim >= 0.9), {_greedy()},
lead AS (SELECT c.b AS id, min(c.a) AS seed, arg_min(c.sim, c.a) AS sim FROM conf c JOIN kept k ON k.id = c.a WHERE c.b NOT IN (SELECT id FROM kept) GROUP BY c.b)
SELECT s.id, coalesce(l.seed, s.id) AS seed, CASE WHEN l.seed IS NULL THEN 'kept' WHEN l.sim >= 0.95 THEN 'redundant' ELSE 'member' END AS role FROM sets s LEFT JOIN lead l ON l.id = s.id WHERE len(s.ws) > 0""",
)
def consolidated(spark, d):
    return curate.consolidate(bullets(spark, d), "doc_id")


_BOTH = f"""vecs AS (SELECT b.doc_id AS id, b.scope AS grp, CAST(e.embedding AS DOUBLE[]) AS v FROM bullets b JOIN embeddings e ON e.vec_id = b.doc_id),
hsims AS (SELECT s.a, s.b, s.sim FROM sims s WHERE NOT (s.a IN (SELECT id FROM vecs) AND s.b IN (SELECT id FROM vecs)) UNION ALL
 SELECT x.id, y.id, list_cosine_similarity(x.v, y.v) FROM vecs x JOIN vecs y ON x.id < y.id AND x.grp = y.grp)"""


def with_vectors(spark, d):
    """Records with the vector of their number, where there is one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return bullets(spark, d).join(v, "doc_id", "left")


@query("j5_vector_curate", f"""WITH {BULLETS}, {_sims('bullets', 'doc_id', 'content', 'scope')}, {_BOTH}, best AS (SELECT b AS id, arg_max(a, (sim, -a)) AS target, max(sim) AS sim FROM hsims WHERE sim >= 0.45 GROUP BY b)
SELECT doc_id AS cand_id, CASE WHEN trim(content) = '' THEN 'skip' WHEN target IS NOT NULL THEN 'merge' ELSE 'add' END AS action, target AS target_id, round(sim, 6) AS sim FROM bullets LEFT JOIN best ON id = doc_id""")
def vector_curated(spark, d):
    """Every record against all earlier ones of its scope, by vectors where both have one; the bound is low enough for vectors to match."""
    out = curate.curate_in_order(with_vectors(spark, d), "doc_id", 0.45, "scope", "embedding")
    return out.withColumn("sim", F.round("sim", 6))


@query(
    "j10_vector_consolidate",
    f"""WITH RECURSIVE {BULLETS}, {_sims('bullets', 'doc_id', 'content')}, {_BOTH.replace(' AND x.grp = y.grp', '')}, conf AS (SELECT a, b, sim FROM hsims WHERE sim >= 0.45), {_greedy()},
lead AS (SELECT c.b AS id, min(c.a) AS seed, arg_min(c.sim, c.a) AS sim FROM conf c JOIN kept k ON k.id = c.a WHERE c.b NOT IN (SELECT id FROM kept) GROUP BY c.b)
SELECT s.id, coalesce(l.seed, s.id) AS seed, CASE WHEN l.seed IS NULL THEN 'kept' WHEN l.sim >= 0.95 THEN 'redundant' ELSE 'member' END AS role FROM sets s LEFT JOIN lead l ON l.id = s.id""",
)
def vector_consolidated(spark, d):
    return curate.consolidate(with_vectors(spark, d), "doc_id", 0.45, vector_col="embedding")


def _negative(words: str) -> str:
    return f"len(list_filter(list_transform({words}, lambda w: rtrim(w, '{text.PUNCTUATION.replace(chr(39), chr(39) * 2)}')), lambda w: list_contains({sqltext.flat_list(NEGATIONS)}, w))) > 0"


@query(
    "j10_conflict_pairs",
    f"""WITH RECURSIVE {_sims('documents', 'doc_id', 'text')}, conf AS (SELECT a, b, sim FROM sims WHERE sim >= 0.9), {_greedy()},
lead AS (SELECT c.b AS id, min(c.a) AS seed FROM conf c JOIN kept k ON k.id = c.a WHERE c.b NOT IN (SELECT id FROM kept) GROUP BY c.b),
seeds AS (SELECT s.id, s.ws, coalesce(l.seed, s.id) AS seed, l.seed IS NULL AS is_seed FROM sets s LEFT JOIN lead l ON l.id = s.id)
SELECT m.a, m.b, round(m.sim, 6) AS sim, 'negation' AS kind FROM sims m JOIN seeds x ON x.id = m.a JOIN seeds y ON y.id = m.b
WHERE m.sim >= 0.5 AND m.sim < 0.8 AND x.is_seed AND y.seed >= m.a AND ({_negative('x.ws')}) <> ({_negative('y.ws')})""",
)
def conflict_pairs(spark, d):
    """The conflicts that a consolidation meets; stand-ins for negations, which the invented words of the test data do not have."""
    _, found = curate.consolidation(bullets(spark, d), "doc_id", negations=NEGATIONS)
    return found.select("a", "b", F.round("sim", 6).alias("sim"), "kind")


@query("c6_triage", f"""WITH {BULLETS}, {_sims('bullets', 'doc_id', 'content', 'scope')}, k AS (SELECT a, b, sim, CASE WHEN (a + b) % 2 = 0 THEN 'negation' ELSE 'contradiction' END AS kind FROM sims WHERE sim >= 0.5 AND sim < 1)
SELECT a, b, kind, round(sim * CASE kind WHEN 'negation' THEN 1.0 ELSE 0.95 END, 6) AS confidence, CASE WHEN round(sim * CASE kind WHEN 'negation' THEN 1.0 ELSE 0.95 END, 6) >= 0.85 THEN 'supersede' ELSE CASE WHEN round(sim * CASE kind WHEN 'negation' THEN 1.0 ELSE 0.95 END, 6) >= 0.5 THEN 'review' ELSE 'mark' END END AS action FROM k""")
def triaged(spark, d):
    pairs, members = simjoin.self_join(bullets(spark, d), text.word_set(F.col("content")), 0.5, "doc_id", "scope")
    kind = F.when((F.col("a") + F.col("b")) % 2 == 0, "negation").otherwise("contradiction")
    out = curate.triaged(simjoin.expand(pairs.where("sim < 1"), members).withColumn("kind", kind))
    return out.select("a", "b", "kind", F.round("confidence", 6).alias("confidence"), "action")


@query("c1_keep_best_merge", f"""{_CURATE}, p AS (SELECT cand, target, x.content AS cc, y.content AS ec, x.instructivity_score AS cs, y.instructivity_score AS es, x.tags AS ct, y.tags AS et, y.upvotes AS er FROM best JOIN bullets x ON x.doc_id = cand JOIN team y ON y.item_id = target),
w AS (SELECT *, cs > es OR (cs = es AND length(cc) > length(ec)) AS takes FROM p)
SELECT cand AS pair_id, md5(CASE WHEN takes THEN cc ELSE ec END) AS content_md5, CASE WHEN takes THEN cs ELSE es END AS instructivity_score, er AS recall_count,
 array_to_string(CASE WHEN takes THEN list_concat(ct, list_filter(et, lambda t: NOT list_contains(ct, t))) ELSE list_concat(et, list_filter(ct, lambda t: NOT list_contains(et, t))) END, ',') AS tags FROM w""")
def keep_best(spark, d):
    hit = _curated(spark, d).where("action = 'merge'").select("cand_id", "target_id")
    named = lambda df, key, id_col, p, recalls: df.select(F.col(id_col).alias(key), *[F.col(c).alias(p + n) for c, n in (("content", "content"), ("instructivity_score", "score"), (recalls, "recall"), ("related_tools", "tools"), ("key_entities", "entities"), ("tags", "tags"))])
    none = F.array().cast("array<string>")
    pool = team(spark, d).withColumns({"related_tools": none, "key_entities": none})
    pairs = hit.join(named(bullets(spark, d), "cand_id", "doc_id", "c_", "recall_count"), "cand_id").join(named(pool, "target_id", "item_id", "e_", "upvotes"), "target_id").withColumnRenamed("cand_id", "pair_id")
    return curate.merged(pairs).select("pair_id", F.md5("content").alias("content_md5"), "instructivity_score", "recall_count", F.array_join("tags", ",").alias("tags"))


@query("x24_merged_sentences", """WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
s AS (SELECT item_id, x, y, list_filter(list_transform(list_filter(list_concat(string_split(replace(x, chr(10), '. '), '. '), string_split(replace(y, chr(10), '. '), '. ')), lambda t: trim(t) <> ''), lambda t: trim(regexp_replace(t, '\\.+$', ''))), lambda t: t <> '') AS parts FROM p)
SELECT item_id, array_to_string(list_filter(parts, lambda t, i: list_position(list_transform(parts, lambda z: lower(z)), lower(t)) = i), ' ') AS merged FROM s""")
def merged_sentences(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")
    return pairs.select("item_id", text.merge_sentences(F.col("x"), F.col("y")).alias("merged"))


@query("j11_playbook_dedup", f"""WITH RECURSIVE {TEAM}, r AS (SELECT row_number() OVER (ORDER BY instructivity_score DESC, item_id) AS rk, content FROM team), {_sims('r', 'rk', 'content')},
conf AS (SELECT a, b FROM sims WHERE sim >= 0.3), {_greedy()}
SELECT count(*) AS kept, CAST(sum(rk) AS BIGINT) AS ranks FROM r WHERE rk NOT IN (SELECT a FROM conf UNION SELECT b FROM conf) OR rk IN (SELECT id FROM kept)""")
def playbook_dedup(spark, d):
    """Deduplication of the playbook, best score first; the bound is low enough for the test data to have pairs."""
    from pyspark.sql import Window

    r = team(spark, d).select(F.row_number().over(Window.orderBy(F.desc("instructivity_score"), "item_id")).cast("long").alias("id"), "content")
    pairs, members = simjoin.self_join(r, text.word_set(F.col("content")), 0.3, "id")
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    kept = simjoin.suppress(r.select("id", F.col("id").alias("rank"), F.lit(False).alias("forced")), simjoin.expand(pairs, members).select("a", "b").unionByName(copies))
    return kept.where("kept").agg(F.count("*").alias("kept"), F.sum("id").alias("ranks"))


def _local(spark, d):
    b = bullets(spark, d)
    return b.select(F.col("bullet_id").alias("local_id"), "content", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string"))).alias("supersedes"))


_CROSS = f"""ls AS (SELECT bullet_id AS l, {sqltext.word_set('content')} AS ws FROM bullets), ts AS (SELECT team_id AS t, {sqltext.word_set('content')} AS ws FROM team),
lt AS (SELECT l, len(ws) AS n, unnest(ws) AS tok FROM ls), tt AS (SELECT t, len(ws) AS n, unnest(ws) AS tok FROM ts),
cross_sims AS (SELECT l, t, count(*) / CAST(any_value(lt.n) + any_value(tt.n) - count(*) AS DOUBLE) AS sim FROM lt JOIN tt USING (tok) GROUP BY 1, 2)"""


@query("j8_supersede_conflicts", f"""WITH {BULLETS}, {TEAM}, {_CROSS}, named AS (SELECT bullet_id AS local_id, 't' || CAST(doc_id % 40 AS VARCHAR) AS team_id FROM bullets WHERE doc_id % 50 = 0)
SELECT local_id, team_id, 'explicit' AS kind FROM named WHERE team_id IN (SELECT team_id FROM team) UNION ALL SELECT l, t, 'implicit' FROM cross_sims WHERE sim >= 0.3 AND sim < 1 AND l NOT IN (SELECT local_id FROM named WHERE team_id IN (SELECT team_id FROM team))""")
def supersede_conflicts(spark, d):
    return federate.supersede_conflicts(_local(spark, d), team(spark, d).select("team_id", "content"), 0.3)


@query("j9_supersede_proposals", f"""WITH {BULLETS}, {TEAM}, {_CROSS} SELECT l AS local_id, t AS team_id, round(least(1.0, sim * 2), 6) AS similarity FROM cross_sims WHERE sim * 2 >= 0.5 AND 1 - sim >= 0.2 AND NOT (l = '0' AND t = 't0')""")
def supersede_proposals(spark, d):
    """Proposals by a similarity measure of the caller's: here twice the word similarity."""
    local, pool = _local(spark, d), team(spark, d).select("team_id", "content")
    near = federate.alike(local.select(F.col("local_id").alias("l"), "content"), pool.select(F.col("team_id").alias("t"), "content"), 0.25)
    pairs = near.select(F.col("l").alias("local_id"), F.col("t").alias("team_id"), F.least(F.lit(1.0), F.col("sim") * 2).alias("similarity"))
    ignored = spark.createDataFrame([("0", "t0")], "local_id string, team_id string")
    return federate.proposals(local, pool, pairs, ignored, 0.5).withColumn("similarity", F.round("similarity", 6))


@query("j16_notifications", f"WITH {BULLETS}, {TEAM}, {_CROSS} SELECT t AS team_id, l AS local_id, round(sim, 6) AS similarity FROM cross_sims WHERE sim >= 0.3")
def notifications(spark, d):
    return federate.notifications(_local(spark, d), team(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query("j18_orphan_ids", f"WITH {BULLETS}, {TEAM} SELECT bullet_id AS id FROM bullets WHERE doc_id NOT IN (SELECT item_id FROM team)")
def orphan_ids(spark, d):
    server = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return ops.orphans(bullets(spark, d).select(F.col("bullet_id").alias("id")), server)


@query("m25_boosted_team", f"""WITH {TEAM}, o AS (SELECT team_id AS id FROM team WHERE item_id % 9 = 1)
SELECT team_id AS id, enforcement = 'mandatory' AND provenance = 'verified' AND team_id NOT IN (SELECT id FROM o) AS is_mandatory,
 CASE WHEN enforcement = 'mandatory' AND provenance = 'verified' AND team_id NOT IN (SELECT id FROM o) THEN 999.0 ELSE instructivity_score / 100 END AS boosted FROM team""")
def boosted_team(spark, d):
    t = team(spark, d).select("item_id", F.col("team_id").alias("id"), (F.col("instructivity_score") / 100).alias("score"), "enforcement", "provenance", F.lit("team").alias("source"))
    over = t.where("item_id % 9 = 1").select("id", F.lit("why").alias("reason"), (now() + F.make_dt_interval(days=F.lit(5))).alias("expires"), F.lit(1).alias("seq"))
    return ops.boosted(t, ops.active_overrides(over, now())).select("id", "is_mandatory", "boosted")


def _pools(spark, d):
    t = team(spark, d).select(F.col("team_id").alias("id"), "content", (F.col("instructivity_score") / 100).alias("score"), "enforcement", "provenance", "tags", "incompatible_tags", F.lit(None).cast("string").alias("supersedes"))
    b = bullets(spark, d)
    empty = F.array().cast("array<string>")
    own = b.select(F.col("bullet_id").alias("id"), "content", (F.col("instructivity_score") / 100).alias("score"), F.lit("suggestion").alias("enforcement"), F.lit("local_authored").alias("provenance"), "tags", empty.alias("incompatible_tags"), F.when(F.col("doc_id") % 7 == 0, F.lit("t1")).alias("supersedes"))
    return {"local": own, "team": t}


_CLAIM = "enforcement = 'mandatory' AND provenance IN ('local_authored', 'verified')"


def shadow_sql(most: int) -> str:
    """WITH parts up to ``stays``: the best ``most`` rows of each pool, boosted, ranked (rk) and merged by a greedy walk."""
    return f"""WITH RECURSIVE {BULLETS}, {TEAM},
l AS (SELECT bullet_id AS id, 'local' AS source, content, instructivity_score / 100 * {TEAM_CFG.local_boost} AS boosted, false AS forced, tags, CAST([] AS VARCHAR[]) AS inc, doc_id % 7 = 0 AS names FROM bullets ORDER BY instructivity_score DESC, bullet_id LIMIT {most}),
t AS (SELECT team_id AS id, 'team' AS source, content, CASE WHEN {_CLAIM} THEN {TEAM_CFG.mandatory_score} ELSE instructivity_score / 100 * {TEAM_CFG.team_boost} END AS boosted, {_CLAIM} AS forced, tags, CAST(incompatible_tags AS VARCHAR[]) AS inc, false AS names FROM team ORDER BY instructivity_score DESC, team_id LIMIT {most}),
u AS (SELECT * FROM l UNION ALL SELECT * FROM t), live AS (SELECT * FROM u WHERE source = 'local' OR forced OR id <> 't1' OR NOT (SELECT bool_or(names) FROM l)),
r AS (SELECT *, row_number() OVER (ORDER BY boosted DESC, id) AS rk FROM live), plain AS (SELECT * FROM r WHERE len(inc) = 0 AND content <> ''), {_sims('plain', 'rk', 'content')},
conf AS (SELECT a, b FROM sims WHERE sim >= 0.95 UNION SELECT least(x.rk, y.rk), greatest(x.rk, y.rk) FROM r x JOIN r y ON x.rk <> y.rk AND list_has_any(x.tags, y.inc)),
nbs AS (SELECT b AS id, list(a) AS los FROM conf GROUP BY b),
walk AS (SELECT e.id, coalesce(los, []) AS los, r.forced, row_number() OVER (ORDER BY e.id) AS nth FROM (SELECT a AS id FROM conf UNION SELECT b FROM conf) e LEFT JOIN nbs USING (id) JOIN r ON r.rk = e.id),
g AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT w.nth, CASE WHEN list_has_any(g.kept, w.los) AND NOT w.forced THEN g.kept ELSE list_append(g.kept, w.id) END FROM g JOIN walk w ON w.nth = g.nth + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY nth DESC LIMIT 1)),
stays AS (SELECT r.* FROM r WHERE rk NOT IN (SELECT id FROM walk) OR rk IN (SELECT id FROM kept))"""


@query("g12_federated_search", f"{shadow_sql(40)} SELECT id, source, round(boosted, 6) AS boosted FROM stays ORDER BY rk LIMIT 20")
def federated(spark, d):
    return federate.search(_pools(spark, d), None, 20).select("id", "source", F.round("boosted", 6).alias("boosted"))


@query("u1_pool_union", f"""WITH {BULLETS}, {TEAM}, l AS (SELECT 'local' AS source, bullet_id AS id, instructivity_score / 100 AS score FROM bullets ORDER BY score DESC, id LIMIT 40), t AS (SELECT 'team' AS source, team_id AS id, instructivity_score / 100 AS score FROM team ORDER BY score DESC, id LIMIT 40)
SELECT * FROM l UNION ALL SELECT * FROM t""")
def pool_union(spark, d):
    return ops.pool_union(_pools(spark, d), 20).select("source", "id", "score")


@query("u2_keyword_first", f"""WITH {TEAM}, k AS (SELECT content, 1.0 AS score, 1 AS kw FROM team WHERE contains(lower(content), 'ther')), v AS (SELECT content, instructivity_score / 100 AS score, 0 AS kw FROM team)
SELECT md5(content) AS content_md5, arg_max(score, (kw, score)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY content""")
def keyword_first(spark, d):
    t = team(spark, d)
    k = t.where(F.contains(F.lower("content"), F.lit("ther"))).select("content", F.lit(1.0).alias("score"))
    return ops.keyword_first(k, t.select("content", (F.col("instructivity_score") / 100).alias("score"))).select(F.md5("content").alias("content_md5"), "score")


@query("x30_normalised_tags", f"""WITH {TEAM} SELECT team_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT team_id, list_filter(t2, lambda x, i: list_position(t2, x) = i) AS list_distinct_ordered FROM
 (SELECT team_id, list_transform(tags, lambda t: CASE WHEN t = 'docs' THEN 'Documentation' WHEN lower(t) = 'sql' THEN 'SQL' WHEN lower(t) = 'team' THEN 'SQL' ELSE t END) AS t2 FROM team))""")
def normalised_tags(spark, d):
    alias = spark.createDataFrame([("docs", "Documentation"), ("team", "SQL")], "alias string, tag string")
    canon = spark.createDataFrame([("SQL",), ("Rustlang",)], "tag string")
    return ops.normalise_tags(team(spark, d), alias, canon, "team_id").select("team_id", F.array_join("tags", ",").alias("tags"))


@query("c14_verification", f"""WITH {ANCHORS} SELECT bullet_key AS id, CASE WHEN content IS NULL THEN 'unverifiable' WHEN NOT contains(content, anchor_text) THEN 'stale' ELSE 'verified' END AS verified_status FROM anchors LEFT JOIN files USING (file_path)""")
def verification(spark, d):
    a = views.anchors(spark, d).select(F.col("bullet_key").alias("id"), "pos", "file_path", "anchor_text", F.sha2("anchor_text", 256).alias("anchor_hash"))
    return verify.check(a, views.files(spark, d))


@query("a4_verify_report", f"""WITH {ANCHORS}, s AS (SELECT CASE WHEN content IS NULL THEN 'unverifiable' WHEN NOT contains(content, anchor_text) THEN 'stale' ELSE 'verified' END AS verified_status FROM anchors LEFT JOIN files USING (file_path)) SELECT verified_status, count(*) AS n FROM s GROUP BY 1""")
def verify_report(spark, d):
    from ..operators import aggregates

    return aggregates.status_report(verification(spark, d))


@query("f8_stale_policy", f"""WITH {ANCHORS}, s AS (SELECT bullet_key, CASE WHEN content IS NULL THEN 0.7 WHEN NOT contains(content, anchor_text) THEN 0.3 ELSE 1.0 END AS trust FROM anchors LEFT JOIN files USING (file_path))
SELECT bullet_key AS id, round(trust * ((bullet_key * 13) % 101) / 101.0::DOUBLE, 6) AS final_score FROM s""")
def stale_policy(spark, d):
    v = verification(spark, d)
    base = views.anchors(spark, d).select(F.col("bullet_key").alias("id"), F.lit(None).cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verified_status"), ((F.col("bullet_key") * 13) % 101 / F.lit(101.0)).alias("final_score"))
    out = verify.with_trust(base, v, now()).withColumn("bullet_id", F.col("id").cast("string"))
    return search.stale_policy(out, "demote").select("id", F.round("final_score", 6).alias("final_score"))


@query("j7_anchor_mismatch", f"""WITH {ANCHORS}, r AS (SELECT bullet_key AS id, CASE WHEN bullet_key % 3 = 1 THEN 'stale' ELSE 'verified' END AS st, regexp_extract(file_path, '://([^/]+)', 1) AS f, list_distinct(list_filter(string_split_regex(anchor_text, '\\s+'), lambda w: w <> '')) AS w FROM anchors)
SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM r a JOIN r b ON a.f = b.f AND a.st = 'verified' AND b.st = 'stale' AND a.f <> '' WHERE len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) >= 0.5""")
def anchor_mismatch(spark, d):
    a = views.anchors(spark, d)
    rows = a.select(F.col("bullet_key").alias("id"), F.when(F.col("bullet_key") % 3 == 1, "stale").otherwise("verified").alias("verified_status"), F.regexp_extract("file_path", "://([^/]+)", 1).alias("file_path"), "anchor_text")
    return curate.anchor_mismatches(rows)


@query("j13_derived_from", f"""WITH {views.RECALLS}, s AS (SELECT DISTINCT doc_id AS id, user_id AS key FROM recalls), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS x, b.id AS y, count(*) AS both_n FROM s a JOIN s b ON a.key = b.key AND a.id <> b.id GROUP BY 1, 2)
SELECT x AS from_id, y AS to_id, round(both_n / CAST(nx.n + ny.n - both_n AS DOUBLE), 6) AS weight FROM p JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE both_n / CAST(nx.n + ny.n - both_n AS DOUBLE) > 0.2""")
def derived_from(spark, d):
    s = views.recalls(spark, d).select(F.col("doc_id").alias("id"), F.col("user_id").alias("key"))
    return graph.derived_from(s, 0.2).withColumn("weight", F.round("weight", 6))


@query("w1_edge_increments", f"""WITH {EDGES}, inc AS (SELECT from_id, to_id, count(*) AS n FROM edges WHERE weight > 0.15 GROUP BY ALL) SELECT e.from_id, e.to_id, round(least(1.0, e.weight + 0.1 * coalesce(n, 0)), 6) AS weight FROM edges e LEFT JOIN inc USING (from_id, to_id)""")
def edge_increments(spark, d):
    e = views.co_recall_edges(spark, d)
    return store.increment(e, e.where("weight > 0.15").select("from_id", "to_id"), ["from_id", "to_id"], 0.1).withColumn("weight", F.round("weight", 6))


@query("w1_edge_decay", f"WITH {EDGES} SELECT from_id, to_id, round(weight * 0.95, 6) AS weight FROM edges")
def edge_decay(spark, d):
    return graph.decay_edges(views.co_recall_edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query("w1_upsert", """WITH a AS (SELECT user_id, event_type, ts, value FROM events WHERE event_id % 3 <> 0), b AS (SELECT user_id, event_type, ts, value FROM events WHERE event_id % 3 = 0), u AS (SELECT *, 0 AS fresh FROM a UNION ALL SELECT *, 1 FROM b)
SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, ts DESC) AS rn FROM u) WHERE rn = 1""")
def upsert(spark, d):
    """Two batches of one log as old and new state."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "value", "event_id")
    return store.upsert(e.where("event_id % 3 <> 0").drop("event_id"), e.where("event_id % 3 = 0").drop("event_id"), ["user_id", "event_type"], "ts")


@query("w7_winners", f"WITH {BULLETS}, r AS (SELECT scope AS grp, bullet_id AS winner, row_number() OVER (PARTITION BY scope ORDER BY recall_count DESC, created_at DESC, bullet_id) AS rn FROM bullets) SELECT grp, winner FROM r WHERE rn = 1")
def winners(spark, d):
    b = bullets(spark, d)
    groups = b.select(F.col("scope").alias("grp"), F.col("bullet_id").alias("id"))
    return curate.winners(groups, b.select(F.col("bullet_id").alias("id"), "recall_count", "created_at", F.lit(None).cast("timestamp").alias("deleted_at")))


@query("c7_supersede_edges", f"WITH {BULLETS}, r AS (SELECT section, bullet_id, first_value(bullet_id) OVER (PARTITION BY section ORDER BY recall_count DESC, created_at DESC, bullet_id) AS w FROM bullets) SELECT w AS from_id, bullet_id AS to_id FROM r WHERE w <> bullet_id")
def supersede_edges(spark, d):
    b = bullets(spark, d)
    groups = b.select(F.col("section").alias("grp"), F.col("bullet_id").alias("id"))
    won = curate.winners(groups, b.select(F.col("bullet_id").alias("id"), "recall_count", "created_at", F.lit(None).cast("timestamp").alias("deleted_at")))
    return curate.supersede_edges(groups, won)


@query("c9_change_feed", f"""WITH {TEAM} SELECT team_id AS id, CASE WHEN item_id % 4 = 1 THEN 'new ' || md5(content) ELSE md5(content) END AS content FROM team WHERE item_id % 4 <> 0""")
def change_feed(spark, d):
    t = team(spark, d).select("item_id", F.col("team_id").alias("id"), F.md5("content").alias("content"))
    k = F.col("item_id") % 4
    feed = t.where(k < 2).select("id", now().alias("updated_at"), F.when(k == 0, "tombstone").otherwise("approved").alias("status"))
    fetched = t.where(k == 1).select("id", F.concat(F.lit("new "), F.col("content")).alias("content"))
    return ops.apply_changes(t.select("id", "content"), feed, fetched)


@query("a12_taxonomy_merge", f"""WITH {TEAM}, x AS (SELECT status AS category, unnest(tags) AS tag FROM team) SELECT category, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM x GROUP BY category""")
def taxonomy_merge(spark, d):
    t = team(spark, d).select(F.col("status").alias("category"), "tags")
    return ops.merge_taxonomy(t, t).select("category", F.array_join("tags", ",").alias("tags"))


def _pages(spark, d):
    c = graph.clusters(graph.vector_communities(table(spark, d, "embeddings"), 0.3))
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return topics.summarise(c, records)


@query("g11_topic_pages")
def topic_pages(spark, d):
    return _pages(spark, d)


@query("j19_drift_targets", f"""WITH {BULLETS}, n AS (SELECT section AS id, list(bullet_id) AS ids FROM bullets GROUP BY 1), o AS (SELECT section || '-old' AS id, list(bullet_id) AS ids FROM bullets WHERE recall_count > 4 GROUP BY 1),
p AS (SELECT n.id AS new_id, o.id AS page_id, len(list_intersect(n.ids, o.ids)) AS b, len(n.ids) AS nn, len(o.ids) AS oo FROM n, o), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY b DESC, page_id) AS rn FROM p WHERE b * 2 >= nn)
SELECT new_id, page_id, round(1 - b / CAST(nn + oo - b AS DOUBLE), 6) AS drift FROM r WHERE rn = 1""")
def drift_targets(spark, d):
    b = bullets(spark, d)
    fresh = b.groupBy(F.col("section").alias("id")).agg(F.collect_list("bullet_id").alias("bullet_ids"))
    old = b.where("recall_count > 4").groupBy(F.concat("section", F.lit("-old")).alias("id")).agg(F.collect_list("bullet_id").alias("bullet_ids"))
    return topics.drift_targets(fresh, old).withColumn("drift", F.round("drift", 6))
