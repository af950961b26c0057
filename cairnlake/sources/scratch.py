"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, dictionary: int | None = None) -> DataFrame:
    """df as a table that is written once and read from then on (a checkpoint() would compute df twice).

    dictionary: bytes that the distinct values of a column may take in a file, for tables in which many values recur."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cairnlake/scratch-{uuid.uuid4().hex}"
    writer = df.write if dictionary is None else df.write.option("parquet.dictionary.page.size", dictionary)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
