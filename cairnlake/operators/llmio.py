"""Model replies as data: they come as a column or table of the caller's; nothing here calls a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfenced(reply):
    """The text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(reply, r"(?s)^\s*```[A-Za-z]*\s*\n?|\n?\s*```\s*$", ""))


def parsed(df: DataFrame, reply: str, schema: str) -> DataFrame:
    """df with the fields of its JSON replies; replies that are no JSON have nulls."""
    return df.withColumn("_r", F.from_json(unfenced(F.col(reply)), schema)).select(*df.columns, "_r.*")


def refined(df: DataFrame, scores: DataFrame, key: str, column: str = "instructivity_score") -> DataFrame:
    """df with ``refined``: the mean of its score and the model's, or its own where the model gave none."""
    return df.join(scores.select(key, "model_score"), key, "left").withColumn("refined", F.when(F.col("model_score").isNull(), F.col(column)).otherwise((F.col(column) + F.col("model_score")) / 2)).drop("model_score")


def asked(df: DataFrame, prompt: str, caller: Callable[[list[str]], list[str]]) -> DataFrame:
    """df with ``reply``, from a caller that takes the prompts of an Arrow batch; df has only string-like columns to keep order."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def ask(prompts):
        import pandas as pd

        return pd.Series(caller(prompts.tolist()))

    return df.withColumn("reply", ask(F.col(prompt)))
