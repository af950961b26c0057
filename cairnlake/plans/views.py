"""The engine's tables, derived from the test tables by arithmetic that SQL can repeat.

Each view has a DataFrame form (a function of spark and folder) and a SQL form (a chain of WITH parts), which
say the same. NOW is the reference time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import KNOWLEDGE_TYPES, SECTIONS, TOOLS
from ..functions import score

NOW = "2024-02-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge records: one for each document, with its labels."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    created = now() - F.make_dt_interval(days=((k * 7) % 180).cast("int"))
    recalls = k % 20
    out = d.select(
        k,
        k.cast("string").alias("bullet_id"),
        F.col("text").alias("content"),
        F.when(F.col("lang") == "en", "global").otherwise(F.concat(F.lit("project:"), F.coalesce("lang", F.lit("und")))).alias("scope"),
        _pick(SECTIONS, k).alias("section"),
        _pick(KNOWLEDGE_TYPES, k).alias("knowledge_type"),
        ((k * 37) % 101).cast("double").alias("instructivity_score"),
        recalls.alias("recall_count"),
        created.alias("created_at"),
        F.array("lang", "source").alias("tags"),
        F.array(_pick(TOOLS, k)).alias("related_tools"),
        F.array(F.concat(F.lit("entity_"), (k % 100).cast("string"))).alias("key_entities"),
        score.decay_weight(created, recalls, now()).alias("decay_weight"),
    )
    return out


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


BULLETS = f"""b0 AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS bullet_id, text AS content,
    CASE WHEN lang = 'en' THEN 'global' ELSE 'project:' || coalesce(lang, 'und') END AS scope,
    {_list(SECTIONS)}[CAST(doc_id % {len(SECTIONS)} + 1 AS INTEGER)] AS section,
    {_list(KNOWLEDGE_TYPES)}[CAST(doc_id % {len(KNOWLEDGE_TYPES)} + 1 AS INTEGER)] AS knowledge_type,
    CAST((doc_id * 37) % 101 AS DOUBLE) AS instructivity_score, doc_id % 20 AS recall_count, (doc_id * 7) % 180 AS age,
    TIMESTAMP '{NOW}' - to_days(CAST((doc_id * 7) % 180 AS INTEGER)) AS created_at,
    [lang, source] AS tags, [{_list(TOOLS)}[CAST(doc_id % {len(TOOLS)} + 1 AS INTEGER)]] AS related_tools, ['entity_' || CAST(doc_id % 100 AS VARCHAR)] AS key_entities
  FROM documents
), bullets AS (
  SELECT *, CASE WHEN recall_count >= 15 OR age <= 7 THEN 1.0::DOUBLE
    ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(2.0::DOUBLE, -age / 30.0::DOUBLE) * (1 + 0.1::DOUBLE * recall_count))) END AS decay_weight
  FROM b0
)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn that follows it; the message is empty if another turn follows. System turns do not count."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("")
    return turns.where("role = 'user'").select("conv_id", F.col("turn").alias("turn_offset"), F.col("text").alias("user_message"), answer.alias("assistant_message"))


INTERACTIONS = """turns AS (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations WHERE role <> 'system'
), interactions AS (
  SELECT conv_id, turn AS turn_offset, text AS user_message, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS assistant_message
  FROM turns WHERE role = 'user'
)"""


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall log: each event recalls one bullet; a user's events of one day are a set."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    e = table(spark, sf_dir, "events").join(F.broadcast(n))
    return e.select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % F.col("n_docs")).alias("doc_id"), "ts")


RECALLS = """recalls AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id % (SELECT count(*) FROM documents) AS doc_id, ts FROM events
)"""


def co_recall_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets that one set recalls, in both directions; weight 0.1 a set, 1 at most."""
    from ..operators import graph

    r = recalls(spark, sf_dir)
    return graph.co_recall(r, ["user_id", "day"], "doc_id")


EDGES = f"""{RECALLS}, sets AS (SELECT DISTINCT user_id, day, doc_id FROM recalls
), edges AS (
  SELECT a.doc_id AS from_id, b.doc_id AS to_id, least(1.0::DOUBLE, 0.1::DOUBLE * count(*)) AS weight
  FROM sets a JOIN sets b ON a.user_id = b.user_id AND a.day = b.day AND a.doc_id <> b.doc_id GROUP BY ALL
)"""


def team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team records: one for each benchmark item, with governance columns."""
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        k,
        F.concat(F.lit("t"), k.cast("string")).alias("team_id"),
        F.col("text").alias("content"),
        _pick(("approved", "staging", "rejected", "approved"), k).alias("status"),
        _pick(("suggestion", "mandatory", "recommended"), k).alias("enforcement"),
        _pick(("synced", "verified", "external"), k).alias("provenance"),
        ((k * 53) % 101).cast("double").alias("instructivity_score"),
        (k % 7).alias("upvotes"),
        (k % 4).alias("downvotes"),
        F.array(_pick(("security", "python", "rust", "sql", "docs"), k), F.lit("team")).alias("tags"),
        F.when(k % 5 == 0, F.array(F.lit("rust"))).otherwise(F.array().cast("array<string>")).alias("incompatible_tags"),
        (now() - F.make_dt_interval(days=((k * 3) % 60).cast("int"))).alias("nominated_at"),
    )


TEAM = f"""team AS (
  SELECT item_id, 't' || CAST(item_id AS VARCHAR) AS team_id, text AS content,
    ['approved', 'staging', 'rejected', 'approved'][CAST(item_id % 4 + 1 AS INTEGER)] AS status,
    ['suggestion', 'mandatory', 'recommended'][CAST(item_id % 3 + 1 AS INTEGER)] AS enforcement,
    ['synced', 'verified', 'external'][CAST(item_id % 3 + 1 AS INTEGER)] AS provenance,
    CAST((item_id * 53) % 101 AS DOUBLE) AS instructivity_score, item_id % 7 AS upvotes, item_id % 4 AS downvotes,
    [['security', 'python', 'rust', 'sql', 'docs'][CAST(item_id % 5 + 1 AS INTEGER)], 'team'] AS tags,
    CASE WHEN item_id % 5 = 0 THEN ['rust'] ELSE [] END AS incompatible_tags,
    TIMESTAMP '{NOW}' - to_days(CAST((item_id * 3) % 60 AS INTEGER)) AS nominated_at
  FROM benchmark
)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors into pages: a third as they stand, a third altered, a third of a missing file."""
    k = F.col("page_id")
    piece = F.substring("html", 40, 120)
    return table(spark, sf_dir, "pages").select(
        k.alias("bullet_key"),
        F.when(k % 3 == 2, F.concat(F.lit("missing/"), F.col("url"))).otherwise(F.col("url")).alias("file_path"),
        F.when(k % 3 == 1, F.concat(piece, F.lit("#"))).otherwise(piece).alias("anchor_text"),
        k.cast("int").alias("pos"),
    )


ANCHORS = """anchors AS (
  SELECT page_id AS bullet_key, CASE WHEN page_id % 3 = 2 THEN 'missing/' || url ELSE url END AS file_path,
    CASE WHEN page_id % 3 = 1 THEN substring(html, 40, 120) || '#' ELSE substring(html, 40, 120) END AS anchor_text FROM pages
), files AS (SELECT url AS file_path, max(html) AS content FROM pages GROUP BY url)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.col("url").alias("file_path")).agg(F.max("html").alias("content"))
