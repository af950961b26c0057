"""Vectors kept by content: only what is new reaches the embedding function."""

import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cairnlake.sources import vectors
from cairnlake.sources.records import RecordTable


def test_only_new_contents_are_embedded(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "vectors"), vectors.VECTORS, vectors.KEYS, 8)
    log = tmp_path / "calls"
    log.mkdir()

    def embed(texts: pd.Series) -> pd.Series:
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return texts.map(lambda t: [float(len(t)), float(sum(map(ord, t)) % 97)])

    def called():
        seen = [line for f in log.iterdir() for line in f.read_text().split("\n") if line]
        for f in list(log.iterdir()):
            f.unlink()
        return seen

    rows = [(i, f"text number {i % 200}") for i in range(400)] + [(400, ""), (401, None)]
    df = spark.createDataFrame(rows, "id long, content string").withColumn("vector", F.lit("clash"))
    out = {r.id: r.vector for r in vectors.embedded(table, df, embed, "m", 2).collect()}
    assert len(out) == 402 and out[7] == out[207] == [13.0, float(sum(map(ord, "text number 7")) % 97)] and out[400] is None and out[401] is None
    assert len(called()) == 200
    changed = df.withColumn("content", F.when((F.col("id") < 400) & (F.col("id") % 200 < 2), F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    assert vectors.embedded(table, changed, embed, "m", 2).where("vector is not null").count() == 400
    assert sorted(called()) == ["text number 0 new", "text number 1 new"]  # 1 percent
    assert vectors.missing(table, df, "m", 2).count() == 0 and vectors.missing(table, df, "other", 2).count() == 200
    with pytest.raises(PythonException):
        vectors.embedded(table, df, embed, "m", 3).collect()
    assert vectors.missing(table, df, "m", 3).count() == 200
