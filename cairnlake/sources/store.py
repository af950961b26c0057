"""Record tables: lookups, payloads, upserts, exports and imports. Tables are Parquet; writes go to a new folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFIX = "meta_"


def lookup(df: DataFrame, ids: list[str], key: str = "bullet_id") -> DataFrame:
    """One row an asked id, in order (pos), with nulls for misses."""
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} string")
    found = df.where(F.col(key).isin(*sorted(set(ids))))
    return asked.join(found, key, "left").orderBy("pos")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Of rows with the same key the last stays, new before old."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.col(order).desc())
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def increment(old: DataFrame, log: DataFrame, keys: list[str], step: float, most: float = 1.0) -> DataFrame:
    """Weights grow by ``step`` for each log row of their key, up to ``most``; new keys begin at 0."""
    n = log.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = old.join(n, keys, "full")
    return out.withColumn("weight", F.least(F.lit(most), F.coalesce("weight", F.lit(0.0)) + step * F.coalesce("_n", F.lit(0)))).drop("_n")


def from_payload(df: DataFrame, payload: str = "metadata") -> DataFrame:
    """Typed columns from a map of strings: prefix stripped, lists decoded from JSON, defaults for what is missing."""
    get = lambda k: F.try_element_at(F.col(payload), F.lit(PREFIX + k))
    array = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>"))
    return df.select(
        *[c for c in df.columns if c != payload],
        F.coalesce(get("section"), F.lit("general")).alias("section"),
        F.coalesce(get("knowledge_type"), F.lit("knowledge")).alias("knowledge_type"),
        F.coalesce(get("scope"), F.lit("global")).alias("scope"),
        F.coalesce(get("instructivity_score").cast("double"), F.lit(50.0)).alias("instructivity_score"),
        F.coalesce(get("recall_count").cast("long"), F.lit(0)).alias("recall_count"),
        F.coalesce(get("decay_weight").cast("double"), F.lit(1.0)).alias("decay_weight"),
        array("tags").alias("tags"),
        array("related_tools").alias("related_tools"),
        array("key_entities").alias("key_entities"),
    )


def to_payload(df: DataFrame, fields: list[str]) -> DataFrame:
    """A map of strings from typed columns: prefixed, arrays as JSON, nulls left out."""
    kinds = dict(df.dtypes)
    value = lambda c: F.to_json(c) if kinds[c].startswith("array") else F.col(c).cast("string")
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(PREFIX + c).alias("key"), value(c).alias("value")) for c in fields]))
    return df.withColumn("metadata", F.map_filter(pairs, lambda k, v: v.isNotNull())).drop(*fields)


def from_envelope(df: DataFrame, envelope: str) -> DataFrame:
    """Candidates from an export's envelopes {id, memory | content, metadata}: id, content and the typed columns; others go."""
    e = F.from_json(F.col(envelope), "id string, memory string, content string, metadata map<string,string>")
    rows = df.select(e.alias("_e")).select(F.col("_e.id").alias("bullet_id"), F.coalesce("_e.memory", "_e.content").alias("content"), F.coalesce("_e.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    return from_payload(rows.where("content is not null and trim(content) <> ''"))


REVIEW = "a long, b long, kind string, confidence double"


def append_reviews(df: DataFrame, path: str) -> None:
    """Conflicts (with action) that wait for a review, as JSON lines added to a queue."""
    df.where("action = 'review'").select("a", "b", "kind", "confidence").write.mode("append").json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW).json(path)


def log_block(at) -> Column:
    """The text of one consolidation in a log, over the columns of an execution report."""
    count = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("## "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" consolidate\nmerged: "), count("merged_groups"), F.lit(" groups ("), count("merged_bullets"), F.lit(" bullets -> "), count("merged_groups"),
        F.lit(")\nsoft-deleted: "), count("soft_deleted"), F.lit("\nauto-supersede: "), count("auto_supersede"), F.lit("\nqueued-for-review: "), count("queued_for_review"),
        F.lit("\nmarked-conflict: "), count("marked_conflict"), F.lit("\nduration: "), F.format_string("%.1f", "seconds"), F.lit("s\n"),
    )


def append_log(report: DataFrame, path: str, at) -> None:
    """A block a row of a report added to a log; blocks are apart by an empty line."""
    report.select(log_block(at).alias("value")).write.mode("append").text(path)


OUTBOX = "kind string, target string, priority string, body string, at timestamp"
PRIORITIES = ("normal", "urgent")


def _outgoing(df: DataFrame, kind: str, target: str, body, at, priority: str | None = None) -> DataFrame:
    if priority is not None and priority not in PRIORITIES:
        raise ValueError(f"priority must be one of {PRIORITIES}")
    return df.select(F.lit(kind).alias("kind"), F.col(target).cast("string").alias("target"), F.lit(priority).alias("priority"), F.to_json(body).alias("body"), at.alias("at"))


def nominations(df: DataFrame, at, priority: str = "normal") -> DataFrame:
    """Outbox rows that offer records (bullet_id, content, ...) to the team."""
    return _outgoing(df, "nominate", "bullet_id", F.struct(*df.columns), at, priority)


def ballots(df: DataFrame, at) -> DataFrame:
    """Outbox rows of votes (bullet_id, vote: up or down); any other vote is an error."""
    vote = F.when(F.col("vote").isin("up", "down"), F.col("vote")).otherwise(F.raise_error(F.concat(F.lit("no such vote: "), F.coalesce("vote", F.lit("null")))))
    return _outgoing(df, "vote", "bullet_id", F.struct(vote.alias("vote")), at)


def corrections(df: DataFrame, at, priority: str = "normal") -> DataFrame:
    """Outbox rows that offer records in the place of others (origin_id)."""
    return _outgoing(df, "supersede", "origin_id", F.struct(*[c for c in df.columns if c != "origin_id"]), at, priority)


def deviations(df: DataFrame, at) -> DataFrame:
    """Outbox rows that report overrides of mandatory records (bullet_id, reason, expires)."""
    return _outgoing(df, "override-deviation", "bullet_id", F.struct(*df.columns), at)


def append_outbox(df: DataFrame, path: str) -> None:
    """Rows for whatever sends them, added as JSON lines."""
    df.write.mode("append").json(path)


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTBOX).json(path)


def scope_name(scope: str | None) -> str:
    """global for none; a project needs a name."""
    if not scope:
        return "global"
    if scope == "project:":
        raise ValueError("a project scope needs a name")
    return scope


def export_json(df: DataFrame, path: str, scope: str | None = None) -> None:
    """JSON lines, of one scope if given."""
    (df.where(F.col("scope") == scope) if scope else df).write.mode("overwrite").json(path)


def export_markdown(df: DataFrame, path: str, scope: str | None = None) -> None:
    """One text a section, written as its own partition."""
    df = df.where(F.col("scope") == scope) if scope else df
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), F.regexp_replace("content", r"\s+", " "))))
    pages = df.groupBy("section").agg(F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join(lines, "\n")).alias("value"))
    pages.write.mode("overwrite").partitionBy("section").text(path)


def import_json(spark: SparkSession, path: str, existing: DataFrame, schema: str = "bullet_id string, content string, scope string") -> DataFrame:
    """Rows of a JSON export that are no repeats of each other or of existing contents in their scope."""
    rows = spark.read.schema(schema).json(path).where("content is not null and trim(content) <> ''").withColumn("scope", F.coalesce("scope", F.lit("global")))
    once = Window.partitionBy("scope", "content").orderBy("bullet_id")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return rows.join(existing.select("scope", "content"), ["scope", "content"], "left_anti")


def read_playbook(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a team playbook: the header line and malformed lines go, types are lower-cased, unknown keys are kept in ``extra``."""
    fields = "content string, section string, knowledge_type string, instructivity_score double, schema_version long, author_id string, enforcement string, tags array<string>, incompatible_tags array<string>"
    raw = spark.read.text(path).select("value", F.from_json("value", fields + ", _header boolean").alias("r"), F.from_json("value", "map<string,string>").alias("all"))
    known = [f.split()[0] for f in fields.split(", ")]
    rows = raw.where("r is not null and r.content is not null and coalesce(r._header, false) = false")
    extra = F.map_filter("all", lambda k, v: ~k.isin(*known))
    out = rows.select(*[F.col(f"r.{k}").alias(k) for k in known], extra.alias("extra"))
    empty = F.array().cast("array<string>")
    return out.withColumn("knowledge_type", F.coalesce(F.lower("knowledge_type"), F.lit("knowledge"))).withColumn("tags", F.coalesce("tags", empty)).withColumn("incompatible_tags", F.coalesce("incompatible_tags", empty))


INBOX = "id string, conversation_id string, turn_hash string, turn_offset long, role string, content string, assistant_message string, timestamp timestamp, status string, correction_detected boolean, metadata map<string,string>, consumed_at timestamp"


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of queued turns; malformed lines go."""
    return spark.read.schema(INBOX + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and id is not null").drop("_bad")


def front_matter(text):
    """(header, body) of a Markdown text with a YAML header, as a struct column."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).otherwise("").alias("header"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def with_front_matter(df: DataFrame, fields: list[str], body: str = "content"):
    """A Markdown text with the fields as its YAML header."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.to_json(F.struct(F.col(f).alias("v"))), F.lit("null"))) for f in fields]
    clean = [F.regexp_replace(x, r'\{"v":(.*)\}$', "$1") for x in lines]
    return df.withColumn("value", F.concat(F.lit("---\n"), F.concat_ws("\n", *clean), F.lit("\n---\n"), F.col(body)))


def write_pages(df: DataFrame, path: str, name: str) -> None:
    """One folder of text a page: value, partitioned by its name."""
    df.select(F.col(name).alias("page"), "value").write.mode("overwrite").partitionBy("page").text(path)


def erase_user(df: DataFrame, user_col: str, user: str) -> DataFrame:
    return df.where(~F.col(user_col).eqNullSafe(user))


def purge(df: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return df.where("deleted_at is null")
