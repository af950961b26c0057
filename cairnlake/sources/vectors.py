"""Vectors kept by content: a record table keyed by the content's digest, the model and its number of dimensions.

Only contents that the table lacks reach the embedding function, each once however many records share it. What has been embedded
is one commit, so a run that fails embeds again and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import RecordTable
from .scratch import dropped, written

VECTORS = "digest string, model string, dims int, vector array<float>"
KEYS = ["digest", "model", "dims"]


def digest(content):
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def missing(table: RecordTable, records: DataFrame, model: str, dims: int) -> DataFrame:
    """(digest, content), once a content, of what has no vector of this model and number of dimensions."""
    have = table.read().where((F.col("model") == model) & (F.col("dims") == dims)).select("digest")
    once = records.where("trim(content) <> ''").select(digest(F.col("content")).alias("digest"), "content").groupBy("digest").agg(F.min("content").alias("content"))
    return once.join(have, "digest", "left_anti")


def embedded(table: RecordTable, records: DataFrame, embed: Callable[[pd.Series], pd.Series], model: str, dims: int) -> DataFrame:
    """records (content, ...) with ``vector``, null for blank contents. ``embed`` gets texts in batches and returns lists of ``dims`` numbers;
    another number of them is an error, and nothing is kept then."""

    def run(frames):
        for frame in frames:
            vectors = [list(map(float, v)) for v in embed(frame["content"])]
            if any(len(v) != dims for v in vectors) or len(vectors) != len(frame):
                raise ValueError(f"the embedding function must return {dims} numbers a text")
            yield pd.DataFrame({"digest": frame["digest"], "vector": vectors})

    fresh = written(missing(table, records, model, dims).mapInPandas(run, "digest string, vector array<float>"))
    if not fresh.isEmpty():
        table.change(fresh.select("digest", F.lit(model).alias("model"), F.lit(dims).alias("dims"), "vector"))
    dropped(fresh)
    mine = table.read().where((F.col("model") == model) & (F.col("dims") == dims)).select(F.col("digest").alias("_digest"), "vector")
    key = F.when(F.trim("content") != "", digest(F.col("content")))
    return records.drop("vector").withColumn("_key", key).join(mine, F.col("_key") == F.col("_digest"), "left").drop("_key", "_digest")
