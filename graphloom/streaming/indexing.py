"""Incremental indexing: micro-batches of extracted nodes are upserted into an entity table (an addition of this library)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import strip
from graphloom.operators.graph import upsert_nodes

BUCKETS = 256
ENTITY = "id string, entity_type string, entity_role string, labels array<string>"


def upsert_stream(nodes: DataFrame, table_path: str, checkpoint: str, seq: str = "seq", buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps an entity table in folders by a bucket of the id. A micro-batch rewrites the buckets it has ids of, and no
    others: they are written beside the table first and then put in place, so nothing is read and overwritten at once.
    An upsert that is done again gives the same rows, so a batch may be run again. Stops once what is there has been read."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(strip(F.col("id")).alias("id")).select(bucket.alias("bucket")).distinct()
        try:
            table = spark.read.schema(f"{ENTITY}, bucket int").parquet(table_path)
            old = table.join(F.broadcast(touched), "bucket", "left_semi").select("id", "entity_type", "entity_role", "labels")  # buckets at most
        except AnalysisException:  # no table yet
            old = spark.createDataFrame([], ENTITY)
        stage = f"{table_path}.stage"
        upsert_nodes(old, batch, seq).withColumn("bucket", bucket).write.mode("overwrite").parquet(stage)
        fresh = spark.read.schema(f"{ENTITY}, bucket int").parquet(stage)
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table_path)

    return nodes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
