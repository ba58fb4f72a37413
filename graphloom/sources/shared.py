"""The folder that driver and executors share, and tables written there to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For tables of texts, vectors and weights by term: they take two thirds of the disk that Spark's own choice takes.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": 4 << 20}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (tests, where driver and executors are one) a temporary folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="graphloom-")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df, computed once and read back: later steps survive lost executors and all see the same rows."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
