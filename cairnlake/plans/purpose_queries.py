"""Queries: purpose files of pools, the gate and the scores that follow from them. Every document is a pool of its own with a project file; languages own global files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import purpose
from .registry import query
from .views import table


def _project_files(spark, d):
    """A file a document, whose kind its id says: fields left out, lists as text or YAML, thresholds that are no number, no file at all, no header."""
    k = F.col("doc_id")
    line = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    header = F.concat(
        F.lit("---\n"), line(k % 3 != 0, F.concat(F.lit("scope: team-"), (k % 7).cast("string"), F.lit("\n"))),
        line(k % 4 == 1, F.lit('keywords: "that, with ,"\n')), line(k % 4 == 2, F.concat(F.lit("keywords:\n  - kw"), (k % 9).cast("string"), F.lit("\n  - 12\n"))),
        line(k % 5 == 0, F.lit("nominate_threshold: 0.4\n")), line(k % 5 == 1, F.lit("nominate_threshold: often\n")), F.lit("title: x\n---\n"),
    )
    body = F.when(k % 2 == 1, F.col("text")).otherwise(F.lit(" \n"))
    value = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, F.col("text")).otherwise(F.concat(header, body))
    return table(spark, d, "documents").select(k.alias("pool"), F.col("lang").alias("owner"), value.alias("value"))


def _common_files(spark, d):
    """A global file for each language but one."""
    owner = F.col("owner")
    value = F.concat(F.lit("---\nscope: all\nkeywords: [que, "), F.concat(F.lit("word-"), owner), F.lit(', "the of"]\nexcluded_topics: und\nnominate_threshold: 0.25\n---\nqueja und les the of '), owner, F.lit("\n"))
    return table(spark, d, "documents").where("lang is not null and lang <> 'es'").select(F.col("lang").alias("owner")).distinct().select(owner, value.alias("value"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("s21_purposes", rf"""WITH p AS (SELECT doc_id AS pool, lang AS owner, doc_id AS k, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS headed, coalesce(lang <> 'es', false) AS shared,
 CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 OR doc_id % 2 = 1 THEN coalesce({_STRIP.format('text')}, '') ELSE '' END AS body, text IS NULL AND doc_id % 2 = 1 AS lost FROM documents),
q AS (SELECT * REPLACE (headed AND NOT lost AS headed) FROM p)
SELECT pool, CASE WHEN headed AND k % 3 <> 0 THEN 'team-' || (k % 7) WHEN shared THEN 'all' ELSE '' END AS scope,
 CASE WHEN headed AND k % 4 = 1 THEN 'that|with' WHEN headed AND k % 4 = 2 THEN 'kw' || (k % 9) || '|12' WHEN shared THEN 'que|word-' || owner || '|the of' ELSE '' END AS keywords, CASE WHEN shared THEN 'und' ELSE '' END AS excluded,
 md5(CASE WHEN body <> '' THEN body WHEN shared THEN 'queja und les the of ' || owner ELSE '' END) AS body_md5, CASE WHEN headed AND k % 5 = 0 THEN 0.4::DOUBLE WHEN shared THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END AS threshold FROM q""")
def purposes(spark, d):
    out = purpose.merged(purpose.parsed(_project_files(spark, d)), purpose.parsed(_common_files(spark, d)), "owner")
    return out.select("pool", "scope", F.array_join("keywords", "|").alias("keywords"), F.array_join("excluded_topics", "|").alias("excluded"), F.md5("intent_body").alias("body_md5"), "threshold")


def _owners(spark, d):
    """The languages' purposes as those of pools; their vector is that of their first document that has one."""
    both = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    first = both.groupBy(F.col("lang").alias("pool")).agg(F.min_by("embedding", "doc_id").cast("array<double>").alias("purpose_vector"))
    return purpose.parsed(_common_files(spark, d)).withColumnRenamed("owner", "pool").join(first, "pool", "left")


def _records(spark, d):
    v = table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("pool")).join(v, "doc_id", "left")


_WORDS = "list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{M}\\p{N}_]+'))"


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"


@query("f16_vector_gate", f"""WITH firsts AS (SELECT lang, arg_min(CAST(embedding AS DOUBLE[]), doc_id) AS q FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang <> 'es' GROUP BY 1),
r AS (SELECT doc_id, text AS content, lang, CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
w AS (SELECT r.*, q, coalesce({_WORDS}, []) AS ws, list_distinct(['queja', 'und', 'les', 'the', 'of', lang]) AS body FROM r LEFT JOIN firsts USING (lang)),
b AS (SELECT *, CASE WHEN lang IS NULL OR lang = 'es' THEN 'open' WHEN e IS NOT NULL AND q IS NOT NULL THEN 'vector' ELSE 'words' END AS decided_by FROM w)
SELECT doc_id, decided_by, CASE decided_by WHEN 'open' THEN true WHEN 'vector' THEN {_DOT.format('e', 'q')} / sqrt({_DOT.format('e', 'e')} * {_DOT.format('q', 'q')}) >= 0.25 ELSE len(ws) > 0 AND (list_contains(ws, 'que') OR list_has_all(ws, ['word', lang]) OR list_has_all(ws, ['the', 'of']) OR len(list_intersect(body, ws)) / len(body) >= 0.25) END AS nominated FROM b""")
def vector_gate(spark, d):
    return purpose.nominations(_records(spark, d), _owners(spark, d)).select("doc_id", "decided_by", "nominated")


@query("m19_pool_scores", f"""WITH w AS (SELECT doc_id, lang, doc_id % 101 AS points, coalesce({_WORDS.replace('content', 'text')}, []) AS ws FROM documents)
SELECT doc_id, round(points * CASE WHEN lang IS NULL OR lang = 'es' THEN 1.0::DOUBLE WHEN list_contains(ws, 'und') THEN 0.3::DOUBLE WHEN list_contains(ws, 'que') OR list_has_all(ws, ['word', lang]) OR list_has_all(ws, ['the', 'of']) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS points FROM w""")
def pool_scores(spark, d):
    rows = _records(spark, d).select("doc_id", "content", "pool", (F.col("doc_id") % 101).cast("double").alias("points"))
    return purpose.adjusted(rows, purpose.parsed(_common_files(spark, d)).withColumnRenamed("owner", "pool"), "points").select("doc_id", F.round("points", 6).alias("points"))
