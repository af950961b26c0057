"""Purposes of pools: read from Markdown files with a header, project fields over global ones, applied to records as a gate and to scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..config import TEAM
from ..functions import score, udfs
from ..functions.udfs import literal_unicode_tokens
from ..sources.scratch import written

_HEADER = r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*\r?\n?(.*)\z"
FIELDS = ["scope", "keywords", "excluded_topics", "intent_body", "threshold"]


_TEXTS = ArrayType(StringType())


@F.pandas_udf(StructType().add("scope", StringType()).add("keywords", _TEXTS).add("excluded_topics", _TEXTS).add("threshold", DoubleType()))
def _fields(headers: pd.Series) -> pd.DataFrame:
    """Fields of YAML headers; lists may be written as a text with commas. A header that is no YAML mapping has none."""
    import yaml

    def many(value) -> list[str]:
        parts = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else [] if value is None else [value]
        return [t for t in (str(p).strip() for p in parts) if t]

    def number(value) -> float | None:
        try:
            return float(value)
        except (TypeError, ValueError):
            return None

    def read(text: str | None) -> tuple:
        try:
            data = yaml.safe_load(text) if text else {}
        except (yaml.YAMLError, ValueError):  # dates that do not exist are ValueErrors
            data = {}
        data = data if isinstance(data, dict) else {}
        return str(data.get("scope") or ""), many(data.get("keywords")), many(data.get("excluded_topics")), number(data.get("nominate_threshold"))

    return pd.DataFrame([read(t) for t in headers], columns=["scope", "keywords", "excluded_topics", "threshold"])


@F.pandas_udf(ArrayType(_TEXTS))
def _phrases(lists: pd.Series) -> pd.Series:
    """The distinct words of each phrase of a list. (The helper is named by itself: its module holds functions that do not travel once used.)"""
    return lists.map(lambda texts: [literal_unicode_tokens(t) for t in texts] if texts is not None else [])


def parsed(files: DataFrame, value: str = "value", default: float = TEAM.purpose_threshold) -> DataFrame:
    """files with FIELDS in place of their text. Without a header all of it is the body; a missing or unreadable threshold is the default.

    A null text is a file that is missing: its fields are empty, as those of an empty file."""
    text = F.coalesce(value, F.lit(""))
    has = text.rlike(_HEADER)
    body = F.regexp_replace(F.when(has, F.regexp_extract(text, _HEADER, 2)).otherwise(text), r"(?U)\A\s+|\s+\z", "")
    out = files.withColumns({"_f": _fields(F.when(has, F.regexp_extract(text, _HEADER, 1))), "intent_body": body})
    rest = [c for c in files.columns if c != value]
    return out.select(*rest, "_f.scope", "_f.keywords", "_f.excluded_topics", "intent_body", F.coalesce("_f.threshold", F.lit(default)).alias("threshold"))


def merged(project: DataFrame, common: DataFrame, owner: str, default: float = TEAM.purpose_threshold) -> DataFrame:
    """Parsed project files with their gaps filled from the owner's global file (one row an owner): empty texts and lists, and thresholds left at the default."""
    theirs = common.select(owner, *[F.col(c).alias(f"_{c}") for c in FIELDS])
    given = {c: F.col(c) != "" for c in ("scope", "intent_body")} | {c: F.size(c) > 0 for c in ("keywords", "excluded_topics")} | {"threshold": F.col("threshold") != default}
    out = project.join(theirs, owner, "left")
    return out.withColumns({c: F.when(given[c], F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) for c in FIELDS}).drop(*[f"_{c}" for c in FIELDS])


def with_words(purposes: DataFrame) -> DataFrame:
    """Purposes with the words of their phrases and body, taken once a pool rather than once a record.

    They are written, so that the optimiser sees how small they are and does not move all records of a pool into one task."""
    return written(purposes).withColumns({"keyword_words": _phrases("keywords"), "excluded_words": _phrases("excluded_topics"), "intent_words": udfs.unicode_tokens(F.col("intent_body"))})


def _all_of(phrase: Column, words: Column) -> Column:
    return F.size(F.array_except(phrase, words)) == 0


def nominations(records: DataFrame, purposes: DataFrame, pool: str = "pool", threshold: float | None = None) -> DataFrame:
    """Records with ``nominated`` and ``decided_by``: whether each is in the purpose of its pool, and what said so.

    open: the pool has no purpose, or one that says nothing, and takes all. vector: the cosine with ``purpose_vector`` reaches the threshold, where the record's
    ``embedding`` has as many dimensions. words: a record without words is refused, one with all words of a keyword taken, others
    need that share of the body's words; a body without words takes none.

    records: content, pool, perhaps embedding; purposes: one row a pool, FIELDS, perhaps purpose_vector. Null pools are open."""
    mine = with_words(purposes).select(F.col(pool), *[F.col(c).alias(f"_{c}") for c in ["scope", "keywords", "excluded_topics", "intent_body", "threshold", "keyword_words", "intent_words"]], F.col("purpose_vector").alias("_vector") if "purpose_vector" in purposes.columns else F.lit(None).cast("array<double>").alias("_vector"))
    out = records.withColumn("_words", udfs.unicode_tokens(F.col("content"))).join(mine, pool, "left")
    least = F.lit(threshold) if threshold is not None else F.col("_threshold")
    said = (F.col("_scope") != "") | (F.size("_keywords") > 0) | (F.size("_excluded_topics") > 0) | (F.col("_intent_body") != "")
    theirs = F.col("embedding") if "embedding" in records.columns else F.lit(None).cast("array<double>")
    comparable = F.coalesce((F.size(theirs) > 0) & (F.size(theirs) == F.size("_vector")), F.lit(False))
    keyword = F.exists("_keyword_words", lambda p: _all_of(p, F.col("_words")))
    share = F.size(F.array_intersect("_intent_words", "_words")) / F.size("_intent_words")
    words = (F.size("_words") > 0) & (keyword | ((F.size("_intent_words") > 0) & F.coalesce(share >= least, F.lit(False))))
    by = F.when(~F.coalesce(said, F.lit(False)), "open").when(comparable, "vector").otherwise("words")
    taken = F.when(F.col("decided_by") == "open", True).when(F.col("decided_by") == "vector", score.cosine(theirs, F.col("_vector")) >= least).otherwise(words)
    return out.withColumn("decided_by", by).withColumn("nominated", taken).select(*records.columns, "nominated", "decided_by")


def adjusted(records: DataFrame, purposes: DataFrame, column: str, pool: str = "pool") -> DataFrame:
    """Records with ``column`` times 0.3 where all words of an excluded topic of their pool stand in the content, else times 1.2 for those of a keyword."""
    mine = with_words(purposes).select(F.col(pool), F.col("keyword_words").alias("_keys"), F.col("excluded_words").alias("_out"))
    out = records.withColumn("_words", udfs.unicode_tokens(F.col("content"))).join(mine, pool, "left")
    hit = lambda lists: F.coalesce((F.size("_words") > 0) & F.exists(lists, lambda p: (F.size(p) > 0) & _all_of(p, F.col("_words"))), F.lit(False))
    return out.withColumn(column, F.when(hit("_out"), F.col(column) * 0.3).when(hit("_keys"), F.col(column) * 1.2).otherwise(F.col(column))).select(*records.columns)
