"""Queries: single functions and small operators of the inventory, each over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import privacy, score, text
from ..operators import aggregates, curate, graph, mine, search, topics, verify
from ..operators import team as pools
from ..sources import scratch, store
from ..streaming import idle
from . import sqltext, views
from .registry import query
from .search_queries import SCOPE, SCORED, Q
from .store_queries import INBOX, RECORDS, inbox, records
from .text_queries import _DETECT, _SECTION, FAILED, SOLVED
from .views import ANCHORS, BULLETS, EDGES, INTERACTIONS, NOW, TEAM, bullets, interactions, now, table, team

# ---- text ---------------------------------------------------------------------------------------------------------

def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("x1_query_terms", f"""WITH t AS (SELECT item_id AS i, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+(?:''[a-z]+)?')) AS term FROM benchmark)
SELECT DISTINCT i, term FROM t WHERE NOT list_contains({sqltext.flat_list(sorted(text.QUERY_STOPWORDS))}, term)""")
def query_terms(spark, d):
    """The terms of every text of the benchmark as a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("i"), F.explode(text.query_words(F.col("text"))).alias("term"))


@query("x2_word_matches", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') AS has_{w}" for w in ("anea", "the", "und")) + " FROM documents")
def word_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", *[text.has_word(F.col("text"), w).alias(f"has_{w}") for w in ("anea", "the", "und")])


#: The test data have no CJK text, so vowels stand in for ideographs.
_CJK = ("aeiou", "的一是不了")
_CJK_SQL = f"translate(text, '{_CJK[0]}', '{_CJK[1]}')"


@query("x3_cjk_positions", f"WITH t AS (SELECT doc_id, {_CJK_SQL} AS t FROM documents) SELECT doc_id, CAST(len(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, 2) = '的一')) AS INTEGER) AS n, contains(t, '一一') AS twice FROM t")
def cjk_positions(spark, d):
    t = F.translate("text", *_CJK)
    return table(spark, d, "documents").select("doc_id", F.size(text.positions(t, "的一")).alias("n"), F.contains(t, F.lit("一一")).alias("twice"))


_GRAMS = "flatten(list_transform(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]+'), lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"


@query("x4_cjk_bigrams", f"WITH t AS (SELECT doc_id, {_CJK_SQL} AS t FROM documents) SELECT doc_id, md5(array_to_string({_GRAMS}, ' ')) AS grams_md5 FROM t")
def cjk_bigrams(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(text.cjk_bigrams(F.translate("text", *_CJK)), " ")).alias("grams_md5"))


@query("x6_mixed_tokens", f"SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: NOT list_contains({sqltext.flat_list(sorted(text.TOKEN_STOPWORDS))}, w)), lambda w: {sqltext.stem('w')}), ' ')) AS tokens_md5 FROM documents")
def mixed_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(text.mixed_tokens(F.col("text")), " ")).alias("tokens_md5"))


@query("x10_prompt_tokens", "SELECT conv_id, turn, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 4.0::DOUBLE) + 1 END AS INTEGER) AS tokens FROM conversations")
def prompt_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.estimate_prompt_tokens(F.col("text")).alias("tokens"))


def _notes(spark, d):
    """Texts with a path, a symbol and a fenced block."""
    k = F.col("page_id").cast("string")
    head = F.concat(F.lit("see src/page_"), k, F.lit(".md and lib\\util.py, `article"), k, F.lit("` or def run"), k, F.lit("(x)\n```py\nx = "), k, F.lit("\ny\n```\nend"))
    return table(spark, d, "pages").select("page_id", head.alias("note"))


_NOTES = "notes AS (SELECT page_id, 'see src/page_' || page_id || '.md and lib\\util.py, `article' || page_id || '` or def run' || page_id || '(x)' || chr(10) || '```py' || chr(10) || 'x = ' || page_id || chr(10) || 'y' || chr(10) || '```' || chr(10) || 'end' AS note FROM pages)"


@query("x19_anchor_parts", f"""WITH {_NOTES} SELECT page_id, array_to_string(list_distinct_in_order, '|') AS paths, array_to_string(blocks, '|') AS blocks, array_to_string(syms, '|') AS symbols FROM (SELECT page_id,
 regexp_extract_all(note, '((?:[A-Za-z]:[\\\\/])?(?:[\\w.\\-]+[\\\\/])+[\\w.\\-]+\\.(?:{'|'.join(verify.EXTENSIONS)}))', 1) AS list_distinct_in_order, regexp_extract_all(note, '(?s)```[^\\n]*\\n(.*?)```', 1) AS blocks,
 list_concat(list_transform(regexp_extract_all(note, '\\bdef\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda n: 'def ' || n), regexp_extract_all(note, '`([A-Za-z_][A-Za-z0-9_]{{2,}})`', 1)) AS syms FROM notes)""")
def anchor_parts(spark, d):
    n = F.col("note")
    return _notes(spark, d).select("page_id", *[F.array_join(f(n), "|").alias(name) for name, f in (("paths", verify.paths), ("blocks", verify.code_blocks), ("symbols", verify.symbols))])


@query("x20_anchor_windows", "WITH h AS (SELECT page_id, html, left(html, 200) AS head FROM pages), c AS (SELECT *, length(head) - strpos(reverse(head), chr(10)) AS cut_at FROM h) SELECT page_id, CASE WHEN length(html) <= 200 THEN html WHEN contains(head, chr(10)) AND cut_at > 20 THEN left(head, cut_at) ELSE head END AS piece FROM c")
def anchor_windows(spark, d):
    return table(spark, d, "pages").select("page_id", verify.window(F.col("html")).alias("piece"))


#: Stand-ins for antonyms, which the invented words of the test data do not have.
_PAIRS = (("the", "und"), ("of", "les"), ("that", "with"))


def _neighbours(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b")), "item_id")


_NEIGHBOURS = "pairs AS (SELECT x.item_id, x.text AS a, y.text AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)"
_BARE = "list_transform(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> ''), lambda w: rtrim(w, '!\"#$%&()*+,-./:;<=>?@[\\]^_`{{|}}~'))"


@query("x23_antonyms", f"""WITH {_NEIGHBOURS}, w AS (SELECT item_id, {_BARE.format(c='a')} AS wa, {_BARE.format(c='b')} AS wb FROM pairs)
SELECT item_id, CASE {' '.join(f"WHEN list_contains(wa, '{x}') AND list_contains(wb, '{y}') THEN '{x} vs {y}' WHEN list_contains(wa, '{y}') AND list_contains(wb, '{x}') THEN '{y} vs {x}'" for x, y in _PAIRS)} END AS pair FROM w""")
def antonyms(spark, d):
    return _neighbours(spark, d).select("item_id", text.opposing(text.bare_words(F.col("a")), text.bare_words(F.col("b")), _PAIRS).alias("pair"))


@query("x25_list_union", f"WITH {BULLETS} SELECT bullet_id, array_to_string(list_concat(tags, list_filter([section, tags[1], knowledge_type], lambda t: NOT list_contains(tags, t))), ',') AS both_tags FROM bullets")
def list_union(spark, d):
    b = bullets(spark, d).where(F.col("tags").isNotNull())
    return b.select("bullet_id", F.array_join(curate.union_lists(F.col("tags"), F.array(F.col("section"), F.element_at("tags", 1), F.col("knowledge_type"))), ",").alias("both_tags"))


@query("x32_metadata_matches", f"""WITH {BULLETS} SELECT bullet_id, CASE WHEN list_bool_or(list_transform(related_tools, lambda x: starts_with(lower(x), 'np') OR starts_with(lower(x), 'entity_7'))) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN starts_with(key_entities[1], 'entity_7') OR starts_with(key_entities[1], 'np') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS points FROM bullets""")
def metadata_matches(spark, d):
    return bullets(spark, d).select("bullet_id", search.metadata_score("np:Entity_7", F.col("related_tools"), F.col("key_entities"), F.col("tags")).alias("points"))


@query("x36_first_scores", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value / 2 END, 1 - CASE WHEN event_id % 5 = 0 THEN value / 4 END, 0.0) AS score FROM events")
def first_scores(spark, d):
    pick = lambda n, by: F.when(F.col("event_id") % n == 0, F.col("value") / by)
    return table(spark, d, "events").select("event_id", score.first_score(pick(2, 1), pick(3, 2), pick(5, 4)).alias("score"))


@query("x37_pooled_vectors", """WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, 1 + vec_id % 4 AS n FROM embeddings),
m AS (SELECT vec_id, list_transform(range(1, 17), lambda i: list_sum(list_transform(range(0, n), lambda j: e[j * 16 + i])) / n) AS m FROM t)
SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first, round(m[16] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS last FROM m""")
def pooled_vectors(spark, d):
    """Four token vectors of 16 dimensions a row, of which the first 1 to 4 count."""
    parts = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i <= F.col("vec_id") % 4, 1).otherwise(0))
    v = table(spark, d, "embeddings").select("vec_id", score.mean_pool(parts, mask).alias("p"))
    return v.select("vec_id", F.round(F.element_at("p", 1), 6).alias("first"), F.round(F.element_at("p", 16), 6).alias("last"))


# ---- scores ---------------------------------------------------------------------------------------------------------


@query("m1_decay", f"WITH {BULLETS} SELECT bullet_id, round(CASE WHEN age <= 0 THEN 1.0 ELSE pow(2.0, -age / 45.0) END, 6) AS weight, CASE WHEN age <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS without_half_life FROM bullets")
def decay(spark, d):
    age = score.age_days(F.col("created_at"), now())
    return bullets(spark, d).select("bullet_id", F.round(score.exponential_decay(age, 45.0), 6).alias("weight"), score.exponential_decay(age, 0.0).alias("without_half_life"))


def _against_first(spark, d):
    v = table(spark, d, "embeddings")
    return v, F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").first()["embedding"]])


_FIRST = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"


@query("m4_cosines", f"WITH {_FIRST} SELECT vec_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(a, q))), 6) AS cosine, 0.0::DOUBLE AS unequal FROM e")
def cosines(spark, d):
    v, q = _against_first(spark, d)
    return v.select("vec_id", F.round(score.cosine(F.col("embedding"), q), 6).alias("cosine"), score.cosine(F.slice("embedding", 1, 3), q).alias("unequal"))


@query("m5_short_cosines", f"WITH {_FIRST} SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(list_slice(a, 1, 16), list_slice(q, 1, 16)))), 6) AS cosine FROM e")
def short_cosines(spark, d):
    v, q = _against_first(spark, d)
    return v.select("vec_id", F.round(score.short_cosine(F.col("embedding"), F.slice(q, 1, 16)), 6).alias("cosine"))


@query("m6_plain_cosines", f"WITH {_FIRST} SELECT vec_id, round(list_cosine_similarity(a, q), 6) AS cosine FROM e")
def plain_cosines(spark, d):
    v, q = _against_first(spark, d)
    return v.select("vec_id", F.round(score.cosine(F.col("embedding"), q, None, None), 6).alias("cosine"))


_CASED = "list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


@query("m8_cased_jaccard", f"WITH {_NEIGHBOURS}, w AS (SELECT item_id, {_CASED.format(c='a')} AS wa, {_CASED.format(c='b')} AS wb FROM pairs) SELECT item_id, round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb)) / CAST(len(wa) + len(wb) - len(list_intersect(wa, wb)) AS DOUBLE) END, 6) AS sim FROM w")
def cased_jaccard(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return _neighbours(spark, d).select("item_id", F.round(score.jaccard(words("a"), words("b")), 6).alias("sim"))


@query("m9_source_jaccard", f"""WITH {views.RECALLS}, s AS (SELECT user_id, list(DISTINCT doc_id) AS ids FROM recalls GROUP BY 1) SELECT x.user_id, round(len(list_intersect(x.ids, y.ids)) / CAST(len(x.ids) + len(y.ids) - len(list_intersect(x.ids, y.ids)) AS DOUBLE), 6) AS sim FROM s x JOIN s y ON y.user_id = x.user_id + 1""")
def source_jaccard(spark, d):
    s = views.recalls(spark, d).groupBy("user_id").agg(F.collect_set("doc_id").alias("ids"))
    pairs = s.join(s.select((F.col("user_id") - 1).alias("user_id"), F.col("ids").alias("other")), "user_id")
    return pairs.select("user_id", F.round(score.jaccard(F.col("ids"), F.col("other")), 6).alias("sim"))


@query("m10_drift", f"WITH {_NEIGHBOURS}, w AS (SELECT item_id, {_CASED.format(c='a')} AS wa, {_CASED.format(c='b')} AS wb FROM pairs) SELECT item_id, round(1 - len(list_intersect(wa, wb)) / CAST(len(wa) + len(wb) - len(list_intersect(wa, wb)) AS DOUBLE), 6) AS drift FROM w")
def drift(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return _neighbours(spark, d).select("item_id", F.round(score.drift(words("a"), words("b")), 6).alias("drift"))


@query("m11_adamic_adar", f"WITH {EDGES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id) SELECT from_id, to_id, round(weight / ln(degree + 2.0), 6) AS strength FROM edges JOIN deg ON id = to_id")
def adamic_adar(spark, d):
    e = views.co_recall_edges(spark, d)
    return e.join(graph.degrees(e).withColumnRenamed("id", "to_id"), "to_id").select("from_id", "to_id", F.round(score.adamic_adar(F.col("weight"), F.col("degree")), 6).alias("strength"))


@query("m13_blend_weights", """SELECT event_id, round(CASE WHEN value + event_id % 5 <= 0 OR event_id % 7 = 0 THEN 1.0::DOUBLE ELSE value / (value + event_id % 5) END, 9) AS keyword, round(CASE WHEN value + event_id % 5 <= 0 OR event_id % 7 = 0 THEN 0.0::DOUBLE ELSE (event_id % 5) / (value + event_id % 5) END, 9) AS semantic FROM events""")
def blend_weights(spark, d):
    """An event's value and number as the two weights; every seventh is without semantic scores."""
    e = table(spark, d, "events")
    keyword, semantic = score.blend_columns(F.col("value"), (F.col("event_id") % 5).cast("double"), F.col("event_id") % 7 != 0)
    return e.select("event_id", F.round(keyword, 9).alias("keyword"), F.round(semantic, 9).alias("semantic"))


@query("m15_scope_boost", f"WITH {BULLETS} SELECT bullet_id, CASE WHEN scope = 'project:de' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS boost, 1.0::DOUBLE AS unscoped FROM bullets")
def scope_boost(spark, d):
    return bullets(spark, d).select("bullet_id", score.scope_boost(F.col("scope"), "project:de").alias("boost"), score.scope_boost(F.col("scope"), None).alias("unscoped"))


@query("m17_sections", f"WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, {_SECTION} AS section FROM w")
def sections(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", score.section_of(F.col("text")).alias("section"))


@query("m18_score_gate", f"WITH {BULLETS} SELECT bullet_id, least(100.0, greatest(0.0, instructivity_score * 1.5)) AS points FROM bullets WHERE instructivity_score * 1.5 >= 30")
def score_gate(spark, d):
    p = F.col("instructivity_score") * 1.5
    return bullets(spark, d).where(score.passes(p)).select("bullet_id", score.clamp(p, 0.0, 100.0).alias("points"))


@query("m21_conflict_confidence", f"WITH {BULLETS} SELECT bullet_id, round(instructivity_score / 101 * CASE section WHEN 'tools' THEN 1.0 WHEN 'debugging' THEN 0.95 ELSE 0.9 END, 6) AS confidence FROM bullets")
def conflict_confidence(spark, d):
    kind = F.when(F.col("section") == "tools", "negation").when(F.col("section") == "debugging", "contradiction").otherwise("other")
    return bullets(spark, d).select("bullet_id", score.conflict_confidence(F.col("instructivity_score") / 101, kind).alias("confidence"))


# ---- joins, aggregates, trims -----------------------------------------------------------------------------------------


@query("j1_semantic_join", f"""WITH {BULLETS}, sem AS (SELECT CAST(vec_id AS VARCHAR) AS bullet_id, CAST(label AS DOUBLE) / 10 AS s FROM embeddings) SELECT bullet_id, coalesce(s, 0.0) AS semantic_score FROM bullets LEFT JOIN sem USING (bullet_id) WHERE scope IN ('{SCOPE}', 'global')""")
def semantic_join(spark, d):
    sem = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("bullet_id"), (F.col("label").cast("double") / 10).alias("similarity"))
    return search.scored(bullets(spark, d), Q, now(), SCOPE, sem).select("bullet_id", "semantic_score")


_GAINED = f"""{SCORED}, {EDGES}, base AS (SELECT bullet_id, least(1.0, greatest(0.0, raw)) AS final_score FROM scored ORDER BY raw DESC, bullet_id LIMIT 20),
deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id),
gained AS (SELECT CAST(e.to_id AS VARCHAR) AS bullet_id, sum(b.final_score * e.weight / ln(d.degree + 2.0)) AS g FROM base b JOIN edges e ON CAST(e.from_id AS VARCHAR) = b.bullet_id JOIN deg d ON d.id = e.to_id GROUP BY 1)"""


def _expanded(spark, d, **options):
    b = bullets(spark, d)
    base = search.top(search.scored(b, Q, now(), SCOPE), 20).select("bullet_id", "final_score")
    e = views.co_recall_edges(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "weight")
    return search.graph_search(base, b, e, **options)


@query("j3_new_neighbours", f"WITH {_GAINED} SELECT bullet_id, round(0.3 * g, 6) AS score FROM gained WHERE g > 0 AND bullet_id NOT IN (SELECT bullet_id FROM base) AND bullet_id IN (SELECT bullet_id FROM bullets)")
def new_neighbours(spark, d):
    """Neighbours that the base does not have, looked up by id, without a cap on their number."""
    most = 1 << 30
    return _expanded(spark, d, expand=most, limit=most).where("is_new").select("bullet_id", F.round("score", 6).alias("score"))


@query("a9_graph_scores", f"WITH {_GAINED} SELECT bullet_id, round(final_score + 0.3 * coalesce(g, 0), 6) AS score FROM base LEFT JOIN gained USING (bullet_id)")
def graph_scores(spark, d):
    return _expanded(spark, d, expand=0).where("not is_new").select("bullet_id", F.round("score", 6).alias("score"))


@query("t9_new_hit_cap", f"WITH {_GAINED}, fresh AS (SELECT bullet_id, g FROM gained WHERE g > 0 AND bullet_id NOT IN (SELECT bullet_id FROM base) ORDER BY g DESC, bullet_id LIMIT 2) SELECT bullet_id, false AS is_new FROM base UNION ALL SELECT bullet_id, true FROM fresh")
def new_hit_cap(spark, d):
    return _expanded(spark, d, expand=2, limit=100).select("bullet_id", "is_new")


@query("j20_live_winners", f"WITH {RECORDS}, r AS (SELECT section AS grp, bullet_id AS winner, row_number() OVER (PARTITION BY section ORDER BY recall_count DESC, created_at DESC, bullet_id) AS rn FROM records WHERE deleted_at IS NULL) SELECT grp, winner FROM r WHERE rn = 1")
def live_winners(spark, d):
    r = records(spark, d).select(F.col("bullet_id").alias("id"), "section", "recall_count", "created_at", "deleted_at")
    return curate.winners(r.select(F.col("section").alias("grp"), "id"), r.drop("section"))


@query("j21_anchor_files", f"WITH {ANCHORS} SELECT bullet_key AS id, CASE WHEN content IS NULL THEN 'unverifiable' WHEN bullet_key % 5 = 0 OR NOT contains(content, anchor_text) THEN 'stale' ELSE 'verified' END AS verified_status FROM anchors LEFT JOIN files USING (file_path)")
def anchor_files(spark, d):
    """Anchors joined to their files; every fifth anchor's hash does not fit its text."""
    hashed = F.when(F.col("bullet_key") % 5 == 0, F.lit("other")).otherwise(F.sha2("anchor_text", 256))
    return verify.check(views.anchors(spark, d).select(F.col("bullet_key").alias("id"), "pos", "file_path", "anchor_text", hashed.alias("anchor_hash")), views.files(spark, d))


@query("a11_cluster_weights", f"WITH {EDGES} SELECT from_id % 7 AS community, round(sum(weight), 6) AS weight FROM edges WHERE from_id < to_id AND from_id % 7 = to_id % 7 GROUP BY 1")
def cluster_weights(spark, d):
    homes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("community"))
    e = views.co_recall_edges(spark, d).where("from_id < to_id").select(F.col("from_id").alias("u"), F.col("to_id").alias("v"), "weight")
    return aggregates.cluster_weight(homes, e).select("community", F.round("weight", 6).alias("weight"))


@query("t2_trimmed", f"""WITH {TEAM}, s AS (SELECT team_id, instructivity_score / 100 AS f, CAST(floor(length(content) / 4.0) AS BIGINT) AS t FROM team), r AS (SELECT team_id, row_number() OVER w AS rank, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM s WINDOW w AS (ORDER BY f DESC, team_id))
SELECT team_id, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS tokens_used FROM r WHERE rank <= 30 AND (rank = 1 OR used <= 900)""")
def trimmed(spark, d):
    """The best of a bounded list that fit a budget of 900 tokens."""
    s = F.col("instructivity_score") / 100
    t = team(spark, d).select(F.col("team_id").alias("bullet_id"), "content", s.alias("final_score"), s.alias("raw"))
    return search.trim(t, 30, 900).select(F.col("bullet_id").alias("team_id"), "rank", "tokens_used")


# ---- merges, conflicts, lineage ----------------------------------------------------------------------------------------


@query("c3_unknown_strategy", f"WITH {_NEIGHBOURS} SELECT item_id AS pair_id, CASE WHEN trim(a) = '' AND trim(b) <> '' THEN b WHEN length(a) > length(b) THEN a ELSE b END AS content FROM pairs")
def unknown_strategy(spark, d):
    """A strategy that is not known merges as keep_best does."""
    blank = [F.array().cast("array<string>").alias(f"{p}_{k}") for p in ("c", "e") for k in ("tools", "entities", "tags")]
    p = _neighbours(spark, d).select(F.col("item_id").alias("pair_id"), F.col("a").alias("c_content"), F.col("b").alias("e_content"), F.lit(1.0).alias("c_score"), F.lit(1.0).alias("e_score"), F.lit(0).alias("e_recall"), *blank)
    return curate.merged(p, "no such strategy").select("pair_id", "content")


@query("c5_redundant_rows", f"WITH {RECORDS} SELECT bullet_id AS id, deleted_at IS NOT NULL OR doc_id % 4 = 1 AS gone FROM records")
def redundant_rows(spark, d):
    r = records(spark, d).select(F.col("bullet_id").alias("id"), "doc_id", "deleted_at", F.lit(None).cast("string").alias("superseded_by"))
    none = r.where("false").select(F.lit("").alias("grp"), "id")
    out = curate.executed(r, none.select("grp", F.col("id").alias("winner")), none, r.where("doc_id % 4 = 1").select("id"), now())
    return out.select("id", F.col("deleted_at").isNotNull().alias("gone"))


def _found_conflicts(spark, d):
    k = F.col("doc_id")
    return bullets(spark, d).select(k.alias("a"), (k + 1).alias("b"), F.element_at(F.array(F.lit("negation"), F.lit("contradiction"), F.lit("value_difference")), (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 2 == 0, "version_conflict").otherwise("opposing_pair").alias("reason"))


_CONFLICTS = f"{BULLETS}, conflicts AS (SELECT doc_id AS a, doc_id + 1 AS b, ['negation', 'contradiction', 'value_difference'][CAST(doc_id % 3 + 1 AS INTEGER)] AS kind, CASE WHEN doc_id % 2 = 0 THEN 'version_conflict' ELSE 'opposing_pair' END AS reason FROM bullets)"


@query("f10_conflict_kinds", f"WITH {_CONFLICTS} SELECT a, b FROM conflicts WHERE kind = 'negation' UNION ALL SELECT a, b FROM conflicts WHERE reason = 'opposing_pair'")
def conflict_kinds(spark, d):
    c = _found_conflicts(spark, d)
    return curate.of_kind(c, "negation").unionByName(curate.of_kind(c, "opposing_pair")).select("a", "b")


@query("c8_conflict_patches", f"""WITH {_CONFLICTS}, e AS (SELECT a AS id, CAST(b AS VARCHAR) AS other FROM conflicts WHERE kind = 'negation' UNION SELECT b, CAST(a AS VARCHAR) FROM conflicts WHERE kind = 'negation'),
g AS (SELECT id, list_sort(list(DISTINCT other)) AS others FROM e GROUP BY 1) SELECT bullet_id, array_to_string(list_concat([section], list_filter(coalesce(others, []), lambda o: o <> section)), ',') AS conflict_with FROM bullets LEFT JOIN g ON id = doc_id""")
def conflict_patches(spark, d):
    """Ids of conflicting records appended to what a record lists already, each once."""
    b = bullets(spark, d).select(F.col("doc_id").alias("id"), "bullet_id", F.array("section").alias("conflict_with"))
    return curate.with_conflicts(b, curate.of_kind(_found_conflicts(spark, d), "negation")).select("bullet_id", F.array_join("conflict_with", ",").alias("conflict_with"))


@query("s24_review_queue", f"""WITH {_CONFLICTS}, s AS (SELECT c.*, round(((a * 17) % 101) / 101.0::DOUBLE * CASE kind WHEN 'negation' THEN 1.0 WHEN 'contradiction' THEN 0.95 ELSE 0.9 END, 6) AS confidence FROM conflicts c) SELECT a, b, kind, confidence FROM s WHERE confidence >= 0.5 AND confidence < 0.85""")
def review_queue(spark, d):
    """Conflicts for review appended to a queue of JSON lines, and the queue as it is read back."""
    path = _folder(spark, "review")
    found = curate.triaged(_found_conflicts(spark, d).withColumn("sim", (F.col("a") * 17) % 101 / F.lit(101.0)))
    store.append_reviews(found, path)
    return store.read_reviews(spark, path).select("a", "b", "kind", "confidence")


# ---- mining ------------------------------------------------------------------------------------------------------------


def _rule(spark, d, name):
    found = mine.detect(interactions(spark, d), errors=FAILED, retry_errors=FAILED, retry_success=SOLVED)
    return found.where(F.col("pattern_type") == name).select("conv_id", "turn_offset", F.md5("content").alias("content_md5"), F.round("confidence", 6).alias("confidence"))


_RULE = _DETECT + " SELECT conv_id, turn_offset, md5(content) AS content_md5, round(confidence, 6) AS confidence FROM found WHERE pattern_type = '{}'"


@query("w3_retry_success", _RULE.replace("{}", "retry_success"))
def retry_success(spark, d):
    return _rule(spark, d, "retry_success")


@query("w5_repetitive", _RULE.replace("{}", "repetitive_op"))
def repetitive(spark, d):
    return _rule(spark, d, "repetitive_op")


_TOLD = f"""{INTERACTIONS}, told AS (SELECT *, ['git', '', 'docker'][CAST((conv_id + turn_offset) % 3 + 1 AS INTEGER)] AS tool_name, CASE WHEN (conv_id + turn_offset) % 4 = 0 THEN 'boom' END AS error_msg, row_number() OVER (PARTITION BY conv_id ORDER BY turn_offset) AS nth FROM interactions)"""
_HEAVY = "length(regexp_replace(assistant_message, '^\\s+|\\s+$', '', 'g')) >= 20"


def _told(spark, d):
    k = F.col("conv_id") + F.col("turn_offset")
    tool = F.element_at(F.array(F.lit("git"), F.lit(""), F.lit("docker")), (k % 3 + 1).cast("int"))
    return interactions(spark, d).withColumn("tool_name", tool).withColumn("error_msg", F.when(k % 4 == 0, "boom"))


@query("w4_new_tool", f"""WITH {_TOLD} SELECT conv_id, turn_offset, md5('Tool: ' || tool_name || chr(10) || left(assistant_message, 300)) AS content_md5 FROM told t WHERE tool_name <> '' AND {_HEAVY}
 AND NOT EXISTS (SELECT 1 FROM told p WHERE p.conv_id = t.conv_id AND p.nth < t.nth AND p.nth >= t.nth - 20 AND p.tool_name = t.tool_name)""")
def new_tool(spark, d):
    """Tools that a conversation has not used before."""
    return mine.detect(_told(spark, d)).where("pattern_type = 'new_tool'").select("conv_id", "turn_offset", F.md5("content").alias("content_md5"))


@query("w6_error_fix", f"""WITH {_TOLD} SELECT conv_id, turn_offset, md5('Error: ' || left(user_message, 200) || chr(10) || 'Fix: ' || left(assistant_message, 300)) AS content_md5 FROM told
 WHERE ({' OR '.join(f"contains(lower(user_message), {_literal(w)})" for w in mine.ERROR_WORDS)} OR error_msg IS NOT NULL) AND {_HEAVY} AND ({' OR '.join(f"contains(lower(assistant_message), '{w}')" for w in mine.FIX_WORDS)})""")
def error_fix(spark, d):
    """Errors by the words of the message or by the interaction's own error message."""
    return mine.detect(_told(spark, d)).where("pattern_type = 'error_fix'").select("conv_id", "turn_offset", F.md5("content").alias("content_md5"))


# ---- streams and queues as tables ----------------------------------------------------------------------------------------


@query("e2_batch_trigger", f"WITH {INBOX} SELECT count(*) AS n, count(*) >= 100000 OR (count(*) > 0 AND (epoch(TIMESTAMP '{NOW}') - epoch(min(timestamp))) / 3600.0 >= 9.5) AS due FROM inbox WHERE status = 'pending'")
def batch_trigger(spark, d):
    return mine.due(inbox(spark, d), now(), 100_000, 9.5)


@query("e4_short_history", f"WITH {INTERACTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_offset) AS nth FROM interactions) SELECT a.conv_id, a.turn_offset, md5(coalesce(string_agg(b.user_message, '|' ORDER BY b.nth), '')) AS said_md5 FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.nth < a.nth AND b.nth >= a.nth - 2 GROUP BY ALL")
def short_history(spark, d):
    h = mine.with_history(interactions(spark, d), 2)
    return h.select("conv_id", "turn_offset", F.md5(F.array_join(F.transform("history", lambda x: x["said"]), "|")).alias("said_md5"))


@query("e6_ttl_reuse", f"WITH {RECORDS} SELECT bullet_id, verified_status IS NOT NULL AND age * 86400 < 864000 AS fresh FROM records")
def ttl_reuse(spark, d):
    """States of the last ten days are used again."""
    return records(spark, d).select("bullet_id", verify.within_ttl(F.col("created_at"), F.col("verified_status"), now(), 864_000).alias("fresh"))


@query("e7_last_recalls", f"WITH {BULLETS}, {views.RECALLS} SELECT bullet_id, last_recall FROM bullets LEFT JOIN (SELECT doc_id, max(ts) AS last_recall FROM recalls GROUP BY 1) r USING (doc_id)")
def last_recalls(spark, d):
    return aggregates.reinforce(bullets(spark, d), views.recalls(spark, d)).select("bullet_id", "last_recall")


# ---- files -------------------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{scratch.folder(spark)}/cairnlake/{name}-{uuid.uuid4().hex}"


@query("s8_playbook_scan", f"WITH {TEAM} SELECT md5(content) AS content_md5, lower(status) AS knowledge_type, instructivity_score, array_to_string(tags, ',') AS tags, 'x' || upvotes AS extra FROM team")
def playbook_scan(spark, d):
    """A playbook of JSON lines with a header, an empty and a malformed line and a key of its own."""
    path = _folder(spark, "playbook")
    row = F.struct("content", F.upper("status").alias("knowledge_type"), "instructivity_score", "tags", F.concat(F.lit("x"), F.col("upvotes").cast("string")).alias("own"))
    lines = team(spark, d).select(F.to_json(row).alias("value")).unionByName(spark.createDataFrame([('{"_header": true, "model": "m", "dim": 3}',), ("",), ("{not json",)], "value string"))
    lines.write.text(path)
    p = store.read_playbook(spark, path)
    return p.select(F.md5("content").alias("content_md5"), "knowledge_type", "instructivity_score", F.array_join("tags", ",").alias("tags"), F.col("extra")["own"].alias("extra"))


@query("s9_inbox_scan", f"WITH {INBOX} SELECT id, turn_offset, role, md5(content) AS content_md5, status, timestamp FROM inbox")
def inbox_scan(spark, d):
    path = _folder(spark, "inbox")
    lines = inbox(spark, d).select(F.to_json(F.struct("id", "turn_offset", "role", "content", "status", "timestamp")).alias("value"))
    lines.unionByName(spark.createDataFrame([("{broken",), ('{"role": "user"}',)], "value string")).write.text(path)
    return store.read_inbox(spark, path).select("id", "turn_offset", "role", F.md5("content").alias("content_md5"), "status", "timestamp")


@query("s13_page_sink", f"WITH {TEAM} SELECT team_id AS page, md5(string_agg(line, chr(10) ORDER BY i)) AS page_md5 FROM (SELECT team_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM team) GROUP BY 1")
def page_sink(spark, d):
    path = _folder(spark, "pages")
    store.write_pages(team(spark, d).select("team_id", F.col("content").alias("value")), path, "team_id")
    whole = spark.read.option("basePath", path).text(path, wholetext=True)
    return whole.select("page", F.md5(F.regexp_replace("value", "\n$", "")).alias("page_md5"))


@query("s14_scope_export", f"WITH {BULLETS} SELECT bullet_id, md5(content) AS content_md5, recall_count FROM bullets WHERE scope = 'project:de'")
def scope_export(spark, d):
    path = _folder(spark, "export")
    store.export_json(bullets(spark, d), path, "project:de")
    return spark.read.schema("bullet_id string, content string, recall_count long").json(path).select("bullet_id", F.md5("content").alias("content_md5"), "recall_count")


@query("s15_import", f"""WITH {BULLETS}, n AS (SELECT scope, content, min(bullet_id) AS bullet_id FROM bullets WHERE trim(content) <> '' GROUP BY 1, 2) SELECT bullet_id, scope FROM n WHERE NOT EXISTS (SELECT 1 FROM bullets b WHERE b.scope = n.scope AND b.content = n.content AND b.recall_count >= 15)""")
def imported(spark, d):
    """An export of all records read into a store of those with many recalls: what is new, each content once a scope."""
    path = _folder(spark, "import")
    b = bullets(spark, d)
    store.export_json(b.select("bullet_id", "content", "scope"), path)
    return store.import_json(spark, path, b.where("recall_count >= 15")).select("bullet_id", "scope")


@query("s16_envelopes", f"WITH {BULLETS} SELECT bullet_id, md5(content) AS content_md5, section, coalesce(instructivity_score, 50.0) AS instructivity_score, array_to_string(tags, ',') AS tags FROM bullets")
def envelopes(spark, d):
    """Records as an export's envelopes, and the candidates that they become."""
    b = bullets(spark, d).select("bullet_id", "content", "section", "instructivity_score", "tags")
    e = store.to_payload(b, ["section", "instructivity_score", "tags"]).select(F.to_json(F.struct(F.col("bullet_id").alias("id"), F.col("content").alias("memory"), "metadata")).alias("envelope"))
    c = store.from_envelope(e, "envelope")
    return c.select("bullet_id", F.md5("content").alias("content_md5"), "section", "instructivity_score", F.array_join("tags", ",").alias("tags"))


# ---- nomination, review, outbox, upkeep --------------------------------------------------------------------------------


@query("a15_nomination_summary", f"""WITH {BULLETS}, c AS (SELECT doc_id FROM bullets WHERE recall_count >= 3 AND instructivity_score >= 70)
SELECT (SELECT count(*) FROM c) AS total_candidates, (SELECT count(*) FROM bullets WHERE doc_id % 3 = 0) AS nominated_count, (SELECT count(*) FROM bullets WHERE doc_id % 11 = 0) AS ignored_count, (SELECT count(*) FROM c WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS pending_count""")
def nomination_summary(spark, d):
    b = bullets(spark, d)
    every = lambda n: b.where(F.col("doc_id") % n == 0)
    found = pools.nomination_candidates(b, b.where("false").select("bullet_id"))
    return pools.nomination_summary(found, every(3), every(11), every(7))


@query("c11_finalized", f"""WITH {BULLETS}, e AS (SELECT doc_id, content, CASE WHEN doc_id % 5 = 0 THEN '[REDACTED_TOKEN] <EMAIL>' WHEN doc_id % 5 = 1 THEN section || ' ask me@corp.example for it' ELSE section END AS edited FROM bullets)
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'same' END AS edit FROM e WHERE doc_id % 5 <> 0""")
def finalized(spark, d):
    """Reviewers' texts searched again: personal data that came in with an edit goes, and texts of placeholders only stay here."""
    k = F.col("doc_id") % 5
    edited = F.when(k == 0, "[REDACTED_TOKEN] <EMAIL>").when(k == 1, F.concat("section", F.lit(" ask me@corp.example for it"))).otherwise(F.col("section"))
    out = privacy.finalized(privacy.rescanned(bullets(spark, d).withColumn("edited", edited), "content", "edited"))
    return out.select("doc_id", F.when(F.contains("clean", F.lit("me@corp.example")), "leaked").when(F.col("clean") == F.col("edited"), "same").otherwise("changed").alias("edit"))


@query("s12_stored_pages", f"""WITH {BULLETS}, p AS (SELECT section, lpad(CAST(min(doc_id) AS VARCHAR), 8, '0') AS id FROM bullets GROUP BY 1),
fresh AS (SELECT section, id FROM p UNION ALL SELECT section, 'new_' || id FROM p)
SELECT 'topic_' || id AS id, section || CASE WHEN id LIKE 'new%' THEN '-' || right(id, 8) ELSE '' END AS slug, section AS title, CASE WHEN id LIKE 'new%' THEN '2024-02-01' ELSE '2024-01-01' END AS created, CASE WHEN section = 'tools' THEN '2024-01-01' ELSE '2024-02-01' END AS updated FROM fresh WHERE NOT (section = 'tools' AND id LIKE 'new%')""")
def stored_pages(spark, d):
    """A page a section is stored; then all but one come again, each with a new page of the same title."""
    p = bullets(spark, d).groupBy("section").agg(F.lpad(F.min("doc_id").cast("string"), 8, "0").alias("k"), F.array_sort(F.collect_list("bullet_id")).alias("bullet_ids"))
    page = lambda head: p.select(F.concat(F.lit(head), "k").alias("id"), F.col("section").alias("title"), F.lit("").alias("summary"), "bullet_ids", topics.source_hash(F.col("bullet_ids")).alias("source_hash"))
    old = scratch.written(topics.upserted(spark.createDataFrame([], topics.PAGE), page("topic_"), F.to_timestamp(F.lit("2024-01-01"))))
    out = topics.upserted(old, page("topic_").unionByName(page("topic_new_")).where("title <> 'tools'"), now())
    return out.select("id", "slug", "title", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("s23_outbox", f"""WITH {BULLETS} SELECT kind, target, priority, body FROM (
 SELECT 'nominate' AS kind, bullet_id AS target, 'urgent' AS priority, '{{"bullet_id":"' || bullet_id || '","section":"' || section || '"}}' AS body FROM bullets WHERE recall_count >= 15
 UNION ALL SELECT 'vote', bullet_id, NULL, '{{"vote":"' || CASE WHEN doc_id % 2 = 0 THEN 'up' ELSE 'down' END || '"}}' FROM bullets
 UNION ALL SELECT 'supersede', bullet_id, 'normal', '{{"section":"' || section || '"}}' FROM bullets WHERE doc_id % 4 = 0
 UNION ALL SELECT 'override-deviation', bullet_id, NULL, '{{"bullet_id":"' || bullet_id || '","reason":"' || scope || '"}}' FROM bullets WHERE doc_id % 9 = 0)""")
def outbox(spark, d):
    """What goes to the team's server, appended to a queue of JSON lines by kind, and the queue as it is read back."""
    path, b, k = _folder(spark, "outbox"), bullets(spark, d), F.col("doc_id")
    store.append_outbox(store.nominations(b.where("recall_count >= 15").select("bullet_id", "section"), now(), "urgent"), path)
    store.append_outbox(store.ballots(b.select("bullet_id", F.when(k % 2 == 0, "up").otherwise("down").alias("vote")), now()), path)
    store.append_outbox(store.corrections(b.where("doc_id % 4 = 0").select(F.col("bullet_id").alias("origin_id"), "section"), now()), path)
    store.append_outbox(store.deviations(b.where("doc_id % 9 = 0").select("bullet_id", F.col("scope").alias("reason")), now()), path)
    return store.read_outbox(spark, path).select("kind", "target", "priority", "body")


@query("s24_log_block", f"""WITH {RECORDS}, {_CONFLICTS.replace(BULLETS + ', ', '')}, s AS (SELECT round(((a * 17) % 101) / 101.0::DOUBLE * CASE kind WHEN 'negation' THEN 1.0 WHEN 'contradiction' THEN 0.95 ELSE 0.9 END, 6) AS c FROM conflicts),
g AS (SELECT count(DISTINCT section) FILTER (WHERE deleted_at IS NULL) AS m, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 1) AS r FROM records), x AS (SELECT count(*) FILTER (WHERE c >= 0.85) AS a, count(*) FILTER (WHERE c >= 0.5 AND c < 0.85) AS q, count(*) FILTER (WHERE c < 0.5) AS k FROM s)
SELECT '## ' || strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%SZ') || ' consolidate' || chr(10) || 'merged: ' || m || ' groups (' || n || ' bullets -> ' || m || ')' || chr(10) || 'soft-deleted: ' || r || chr(10) || 'auto-supersede: ' || a || chr(10) || 'queued-for-review: ' || q || chr(10) || 'marked-conflict: ' || k || chr(10) || 'duration: 2.5s' || chr(10) AS block FROM g, x""")
def consolidation_log(spark, d):
    r = records(spark, d).select(F.col("bullet_id").alias("id"), "doc_id", "section", "recall_count", "created_at", "deleted_at")
    groups = r.select(F.col("section").alias("grp"), "id")
    found = curate.triaged(_found_conflicts(spark, d).withColumn("sim", (F.col("a") * 17) % 101 / F.lit(101.0)))
    report = curate.execution_report(groups, curate.winners(groups, r.drop("section")), r.where("doc_id % 4 = 1"), found, 2.5)
    return report.select(store.log_block(now()).alias("block"))


@query("e3_idle_gate", f"""WITH s AS (SELECT conv_id, TIMESTAMP '{NOW}' - to_seconds(CAST(200 + max(turn) AS BIGINT)) AS last_activity FROM conversations GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS open, CAST(epoch(TIMESTAMP '{NOW}') - epoch(max(last_activity)) AS BIGINT) AS idle_seconds, epoch(TIMESTAMP '{NOW}') - epoch(max(last_activity)) >= 180 AS due FROM s""")
def idle_gate(spark, d):
    """A session a conversation, all of them ended; the last run was an hour ago."""
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    seen = now() - F.make_dt_interval(secs=(F.lit(200) + F.col("n")).cast("decimal(18,6)"))
    return idle.due(s.select(seen.alias("last_activity"), seen.alias("ended_at")), now(), now() - F.expr("interval 1 hour"))
