"""Queries: text functions, redaction, mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SECTIONS
from ..functions import privacy, text
from ..operators import mine
from . import sqltext, views
from .registry import query
from .views import BULLETS, INTERACTIONS, bullets, interactions, table


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redact_sql(column: str, patterns) -> str:
    for _, p, r in patterns:
        column = f"regexp_replace({column}, '{_re2(p)}', '{_re2(r)}', 'g')"
    return column


def _steps_sql(patterns) -> tuple[str, str]:
    """WITH parts that redact step by step, and the counts' column list."""
    parts, last = ["s0 AS (SELECT doc_id, text AS clean FROM documents)"], "s0"
    for i, (name, p, r) in enumerate(patterns, 1):
        parts.append(f"s{i} AS (SELECT * EXCLUDE (clean), CAST(len(regexp_extract_all(clean, '{_re2(p)}')) AS BIGINT) AS n_{name}, regexp_replace(clean, '{_re2(p)}', '{_re2(r)}', 'g') AS clean FROM {last})")
        last = f"s{i}"
    return ", ".join(parts), last


_PARTS, _LAST = _steps_sql(privacy.PATTERNS)
_COUNTS = ", ".join(f"n_{n}" for n, _, _ in privacy.PATTERNS)


@query("x11_redaction", f"WITH {_PARTS} SELECT doc_id, md5(clean) AS clean_md5, {_COUNTS} FROM {_LAST}")
def redaction(spark, d):
    out = privacy.redaction_counts(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.md5("clean").alias("clean_md5"), *[f"n_{n}" for n, _, _ in privacy.PATTERNS])


@query("x12_team_redaction", f"SELECT doc_id, md5({_redact_sql('text', (*privacy.PATTERNS, *privacy.TEAM_PATTERNS))}) AS clean_md5 FROM documents")
def team_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(privacy.redact_team(F.col("text"))).alias("clean_md5"))


@query("x13_fully_redacted", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_redact_sql('text', privacy.PATTERNS)}, '\\[[\\w_]+\\]', '', 'g'), '<[\\w_]+>', '', 'g'), '\\s+', '', 'g') = '' AS fully FROM documents")
def fully_redacted(spark, d):
    return table(spark, d, "documents").select("doc_id", privacy.fully_redacted(privacy.redact(F.col("text"))).alias("fully"))


@query("x8_word_sets", f"SELECT doc_id, CAST(len({sqltext.word_set('text')}) AS BIGINT) AS n_words FROM documents")
def word_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.word_set(F.col("text"))).cast("long").alias("n_words"))


@query("x5_stems", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, {sqltext.stem('word')} AS stem FROM w")
def stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


@query("x15_sentence_cut", """WITH h AS (SELECT doc_id, text, left(text, 500) AS head FROM documents), c AS (SELECT *,
 length(head) - strpos(reverse(head), ' .') - 1 AS a, length(head) - strpos(reverse(head), chr(10)) AS b, length(head) - strpos(reverse(head), ' ;') - 1 AS c1, length(head) - strpos(reverse(head), ' ,') - 1 AS e,
 strpos(reverse(head), ' .') > 0 AS ha, strpos(reverse(head), chr(10)) > 0 AS hb, strpos(reverse(head), ' ;') > 0 AS hc, strpos(reverse(head), ' ,') > 0 AS he FROM h)
SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text WHEN ha AND a > 250 THEN regexp_replace(left(head, a + 2), '\\s+$', '') WHEN hb AND b > 250 THEN regexp_replace(left(head, b + 1), '\\s+$', '')
 WHEN hc AND c1 > 250 THEN regexp_replace(left(head, c1 + 2), '\\s+$', '') WHEN he AND e > 250 THEN regexp_replace(left(head, e + 2), '\\s+$', '') ELSE regexp_replace(head, '\\s+$', '') || '...' END) AS cut_md5 FROM c""")
def sentence_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncate_sentence(F.col("text"))).alias("cut_md5"))


@query("x18_entities", """WITH f AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(text, '`([^`]+)`', 1), regexp_extract_all(text, '"([^"]{2,30})"', 1)),
 list_concat(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), list_filter(regexp_extract_all(text, '([0-9A-Za-z_-]+\\.[0-9A-Za-z_.]*[0-9A-Za-z_])', 1), lambda m: NOT regexp_matches(m, '^[0-9-]')))) AS e FROM documents)
SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(e)), 1, 10), '|') AS entities FROM f""")
def entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.entities(F.col("text")), "|").alias("entities"))


@query("x17_known_tools", f"SELECT doc_id, array_to_string(list_sort(list_filter({sqltext.flat_list(text.KNOWN_TOOLS)}, lambda t: list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), t))), ',') AS tools FROM documents")
def tools(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.known_tools(F.col("text")), ",").alias("tools"))


@query("x22_negations", f"SELECT doc_id, CAST(len(list_filter(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), lambda w: list_contains({sqltext.flat_list(text.NEGATIONS)}, rtrim(w, '!\"#$%&()*+,-./:;<=>?@[\\]^_`{{|}}~')))) AS INTEGER) AS negations FROM documents")
def negations(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_negations(F.col("text")).alias("negations"))


@query("x27_slugs", "WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{M}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE regexp_replace(left(s, 60), '-+$', '') END AS slug FROM s")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("x29_markdown_escapes", "SELECT doc_id, regexp_replace(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120), '([\\\\*`\\[\\]_])', '\\\\\\1', 'g') AS line FROM documents")
def markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", text.escape_markdown(F.col("text")).alias("line"))


_LOOKS = r"regexp_matches(x, '^\s') OR regexp_matches(x, '[{};]|\(\)|\[\]|==|!=|->') OR regexp_matches(ltrim(x), '^(import|from|def|class|return|if|for) ') OR (regexp_matches(x, '[=()]') AND len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) < 3)"


@query("f12_code_heavy", rf"""WITH l AS (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n') AS lines FROM conversations),
f AS (SELECT *, list_filter(lines, lambda x: trim(x) <> '') AS full_lines FROM l)
SELECT conv_id, turn, len(lines) >= 3 AND len(full_lines) > 0 AND len(list_filter(full_lines, lambda x: {_LOOKS})) / greatest(1, len(full_lines)) > 0.6 AS heavy FROM f""")
def code_heavy(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.code_heavy(F.col("text")).alias("heavy"))


@query("f13_corrections", f"SELECT conv_id, turn, {sqltext.is_correction('text')} AS correction FROM conversations")
def corrections(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", mine.is_correction(F.col("text")).alias("correction"))


@query("r1_interactions", f"WITH {INTERACTIONS} SELECT conv_id, turn_offset, md5(user_message) AS user_md5, md5(assistant_message) AS reply_md5 FROM interactions")
def interaction_rows(spark, d):
    return interactions(spark, d).select("conv_id", "turn_offset", F.md5("user_message").alias("user_md5"), F.md5("assistant_message").alias("reply_md5"))


@query("r1_parsed_messages", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS user_message, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS reply_md5 FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def parsed(spark, d):
    return mine.parse_messages(table(spark, d, "conversations")).select("conv_id", "user_message", F.md5("assistant_message").alias("reply_md5"))


def _any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + w.replace("'", "''") + "')" for w in words) + ")"


#: The default error words do not occur in the test data, so these stand in for them.
FAILED, SOLVED = ("queja", "chach", "ether"), ("tion", "ung")
_HIST = f"""{INTERACTIONS}, lows AS (
  SELECT *, lower(user_message) AS low, list_distinct(regexp_extract_all(lower(user_message), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn_offset) AS nth FROM interactions
), past AS (
  SELECT a.conv_id, a.turn_offset, b.user_message AS said, b.low AS b_low, b.nth AS b_nth FROM lows a JOIN lows b ON a.conv_id = b.conv_id AND b.nth < a.nth AND b.nth >= a.nth - 20 AND len(list_intersect(a.words, b.words)) >= 2
), alikes AS (SELECT conv_id, turn_offset, count(*) AS n FROM past GROUP BY ALL
), failed AS (SELECT conv_id, turn_offset, arg_max(said, b_nth) AS said FROM past WHERE {_any_sql("b_low", FAILED)} GROUP BY ALL)"""
_ENOUGH = "length(regexp_replace(assistant_message, '^\\s+|\\s+$', '', 'g')) >= 20"
_DETECT = f"""WITH {_HIST}, found AS (
  SELECT conv_id, turn_offset, 'error_fix' AS pattern_type, 'Error: ' || left(user_message, 200) || chr(10) || 'Fix: ' || left(assistant_message, 300) AS content, 0.8::DOUBLE AS confidence FROM lows
  WHERE {_any_sql("low", FAILED)} AND {_ENOUGH} AND {_any_sql("lower(assistant_message)", mine.FIX_WORDS)}
  UNION ALL SELECT conv_id, turn_offset, 'retry_success', 'Previous issue: ' || left(said, 200) || chr(10) || 'Resolution: ' || left(assistant_message, 300), 0.7::DOUBLE
  FROM lows JOIN failed USING (conv_id, turn_offset) WHERE {_any_sql("lower(assistant_message)", SOLVED)}
  UNION ALL SELECT conv_id, turn_offset, 'config_change', 'Config: ' || left(assistant_message, 400), 0.6::DOUBLE FROM lows WHERE {_any_sql("lower(user_message || ' ' || assistant_message)", mine.CONFIG_WORDS)} AND {_ENOUGH}
  UNION ALL SELECT conv_id, turn_offset, 'repetitive_op', 'Repeated pattern (' || CAST(n + 1 AS VARCHAR) || 'x): ' || left(user_message, 300), 0.5::DOUBLE + least(0.3::DOUBLE, n * 0.1::DOUBLE)
  FROM lows JOIN alikes USING (conv_id, turn_offset) WHERE n >= 2 AND len(words) >= 2
)"""


def _found(spark, d):
    return mine.detect(interactions(spark, d), errors=FAILED, retry_errors=FAILED, retry_success=SOLVED)


@query("r2_patterns", f"{_DETECT} SELECT conv_id, turn_offset, pattern_type, content, round(confidence, 6) AS confidence FROM found")
def patterns(spark, d):
    return _found(spark, d).select("conv_id", "turn_offset", "pattern_type", "content", F.round("confidence", 6).alias("confidence"))


from ..functions.score import ACTIONABLE, PATTERN_TYPES, SECTION_WORDS  # noqa: E402

_SECTION = "CASE " + " ".join(f"WHEN list_has_any(ws, {sqltext.flat_list(k)}) THEN '{n}'" for n, k in SECTION_WORDS) + " ELSE 'general' END"
_TYPE = "CASE pattern_type " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in PATTERN_TYPES.items()) + " END"


_SCORED = f"""{_DETECT}, w AS (SELECT *, list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '') AS ws FROM found), p AS (
 SELECT *, confidence * 100 * least(1.0, len(ws) / 20.0::DOUBLE) + CASE WHEN {_any_sql("lower(content)", ACTIONABLE)} THEN 10 ELSE 0 END + CASE WHEN regexp_matches(content, '[./\\\\]') THEN 5 ELSE 0 END AS points FROM w
), scored AS (SELECT conv_id, turn_offset, pattern_type, content, {_SECTION} AS section, {_TYPE} AS knowledge_type, least(100.0, greatest(0.0, points)) AS instructivity_score FROM p WHERE points >= 30)"""


@query("r3_scored_patterns", f"{_SCORED} SELECT * EXCLUDE (content) REPLACE (round(instructivity_score, 6) AS instructivity_score) FROM scored")
def scored_patterns(spark, d):
    return mine.scored(_found(spark, d)).select("conv_id", "turn_offset", "pattern_type", "section", "knowledge_type", F.round("instructivity_score", 6).alias("instructivity_score"))


@query("r4_sanitised", f"{_SCORED} SELECT conv_id, turn_offset, pattern_type, {_redact_sql('content', privacy.PATTERNS)} AS content FROM scored")
def sanitised(spark, d):
    return mine.sanitised(mine.scored(_found(spark, d))).select("conv_id", "turn_offset", "pattern_type", "content")


def _distil_sql(source: str) -> str:
    """WITH parts and the last select over candidates: redacted, cut, tools and entities, the turn they come from."""
    return f"""clean AS (SELECT * REPLACE ({_redact_sql('content', privacy.PATTERNS)} AS content) FROM {source}), {sqltext.sentence_cut('clean', 'content', 'short')}
SELECT conv_id, turn_offset, pattern_type, section, knowledge_type, round(instructivity_score, 6) AS instructivity_score, short AS content, {sqltext.tools('content')} AS related_tools, {sqltext.entities('content')} AS key_entities,
 left(sha256(CASE WHEN assistant_message <> '' THEN assistant_message ELSE user_message END), 16) AS turn_hash, CASE WHEN assistant_message <> '' THEN 'assistant' ELSE 'user' END AS role FROM clean_cut JOIN interactions USING (conv_id, turn_offset)"""


def _flat(df):
    return df.withColumns({"instructivity_score": F.round("instructivity_score", 6), "related_tools": F.array_join("related_tools", ","), "key_entities": F.array_join("key_entities", "|")})


@query("r5_distilled", f"{_SCORED}, {_distil_sql('scored')}")
def distilled(spark, d):
    return _flat(mine.reflect(interactions(spark, d), errors=FAILED, retry_errors=FAILED, retry_success=SOLVED))


def _replies(spark, d):
    """A model's replies to turns, by kinds that the ids say: failed calls, no JSON, nothing to learn, fenced JSON, unknown names, no score."""
    k = (F.col("conv_id") * 31 + F.col("turn_offset") * 7) % 11
    points = ((F.col("conv_id") * 13 + F.col("turn_offset") * 5) % 111).cast("string")
    body = lambda *parts: F.concat(F.lit('{"should_record": true, '), *parts, F.lit("}"))
    full = body(F.lit('"knowledge_type": "Method", "section": "debugging", "instructivity_score": '), points, F.lit(', "summary": "use git rebase in '), F.col("conv_id").cast("string"), F.lit('"'))
    reply = (
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("I would keep this.")).when(k == 2, F.lit('{"should_record": false, "instructivity_score": 90}'))
        .when(k == 3, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(k == 4, body(F.lit('"knowledge_type": "story", "section": "poems", "instructivity_score": "high"'))).when(k == 5, body(F.lit('"section": "tools"'))).otherwise(full)
    )
    return interactions(spark, d).select("conv_id", "turn_offset", reply.alias("reply"))


_SAID = f"""ks AS (SELECT conv_id, turn_offset, (conv_id * 31 + turn_offset * 7) % 11 AS k, least(100.0::DOUBLE, (conv_id * 13 + turn_offset * 5) % 111) AS points FROM interactions),
said AS (SELECT conv_id, turn_offset, k NOT IN (1, 2) AS learn, CASE WHEN k = 5 AND {'tools' in SECTIONS} THEN 'tools' WHEN k IN (4, 5) THEN 'general' ELSE 'debugging' END AS model_section, CASE WHEN k IN (4, 5) THEN 'knowledge' ELSE 'method' END AS model_type,
 CASE WHEN k IN (4, 5) THEN 50.0::DOUBLE ELSE points END AS model_score, CASE WHEN k IN (4, 5) THEN '' ELSE 'use git rebase in ' || CAST(conv_id AS VARCHAR) END AS summary FROM ks WHERE k <> 0),
direct AS (SELECT conv_id, turn_offset, 'llm_evaluated' AS pattern_type, CASE WHEN summary <> '' THEN summary ELSE left(assistant_message, 400) END AS content, model_section, model_type, model_score FROM said JOIN interactions USING (conv_id, turn_offset) WHERE learn AND model_score >= 30)"""


@query("r7_hybrid_reflection", f"""{_SCORED}, {_SAID}, cand AS (
 SELECT conv_id, turn_offset, pattern_type, content, coalesce(model_section, section) AS section, coalesce(model_type, knowledge_type) AS knowledge_type, coalesce((instructivity_score + model_score) / 2, instructivity_score) AS instructivity_score FROM scored LEFT JOIN (SELECT * FROM said WHERE learn) USING (conv_id, turn_offset)
 UNION ALL SELECT * FROM direct WHERE (conv_id, turn_offset) NOT IN (SELECT (conv_id, turn_offset) FROM found)), {_distil_sql('cand')}""")
def hybrid_reflection(spark, d):
    return _flat(mine.reflect_with(interactions(spark, d), _replies(spark, d), "hybrid", errors=FAILED, retry_errors=FAILED, retry_success=SOLVED))


@query("r7_model_reflection", f"""{_SCORED}, {_SAID}, cand AS (SELECT conv_id, turn_offset, pattern_type, content, section, knowledge_type, instructivity_score FROM scored WHERE (conv_id, turn_offset) NOT IN (SELECT (conv_id, turn_offset) FROM said) UNION ALL SELECT * FROM direct), {_distil_sql('cand')}""")
def model_reflection(spark, d):
    return _flat(mine.reflect_with(interactions(spark, d), _replies(spark, d), "llm", errors=FAILED, retry_errors=FAILED, retry_success=SOLVED))


@query("t4_packed_batches", """WITH RECURSIVE e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(length(text) / 4.0::DOUBLE) AS BIGINT) + 1 END AS tokens FROM conversations),
g AS (SELECT conv_id, turn, nth, 0 AS batch, 1 AS size, tokens AS used FROM e WHERE nth = 1 UNION ALL
 SELECT e.conv_id, e.turn, e.nth, CASE WHEN g.size >= 3 OR g.used + e.tokens > 300 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.size >= 3 OR g.used + e.tokens > 300 THEN 1 ELSE g.size + 1 END, CASE WHEN g.size >= 3 OR g.used + e.tokens > 300 THEN e.tokens ELSE g.used + e.tokens END
 FROM g JOIN e ON e.conv_id = g.conv_id AND e.nth = g.nth + 1)
SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch FROM g""")
def packed(spark, d):
    e = table(spark, d, "conversations").select("conv_id", "turn", text.estimate_prompt_tokens(F.col("text")).alias("tokens"))
    return mine.pack(e, 3, 300)
