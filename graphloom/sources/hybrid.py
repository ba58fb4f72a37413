"""One stored index of points for hybrid search: vectors in cells, sparse postings in blocks, payloads, and their state.

A save writes all parts into a folder of its own and then, as its last step, one row that names the folder and holds the
state. A reader takes the newest row, so it sees all parts of one save or all of another, never some of each; a save that is
broken off leaves no row, and the index before it stays."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import many
from graphloom.sources.index import SKIPPING, _save_postings

MANIFEST = "number long, folder string, state string"
PAYLOAD = ["id", "content", "doc_id", "chunk_type"]


@dataclass
class HybridIndex:
    """points: payloads by id; vectors and cells: of many.celled(); postings: of many.blocked(); state: what was saved with
    them, among it doc_count, metric, constant (of the fusion) and weights of the two searches."""

    points: DataFrame
    vectors: DataFrame
    cells: DataFrame
    postings: DataFrame
    state: dict


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def _newest(spark: SparkSession, path: str):
    try:
        return _rows(spark, path).filter(F.col("folder").isNotNull()).orderBy(F.desc("number"), F.desc("folder")).first()
    except AnalysisException:
        return None


def save(points: DataFrame, path: str, dimension: int, metric: str = "cosine", constant: float = 2.0, weights: tuple[float, float] = (1.0, 1.0)) -> dict:
    """Points (as sources.index.POINT has them) as the newest version of the index at path; its state."""
    spark, folder = points.sparkSession, f"v-{uuid.uuid4().hex}"
    at = f"{path}/{folder}"
    points.select(*PAYLOAD).repartitionByRange("id").sortWithinPartitions("id").write.options(**SKIPPING).parquet(f"{at}/points")
    count = spark.read.parquet(f"{at}/points").count()
    _, cells = many.celled(points.select("id", "dense", "doc_id", "chunk_type"), dimension, "dense", "id", f"{at}/vectors")
    cells.write.parquet(f"{at}/cells")
    _save_postings(many.blocked(many.map_weights(points, "id", "sparse")), f"{at}/postings", count)
    state = {"doc_count": count, "dimension": dimension, "metric": metric, "constant": constant, "weights": list(weights)}
    before = _newest(spark, path)
    row = spark.createDataFrame([((before.number if before else 0) + 1, folder, json.dumps(state))], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return state


def load(spark: SparkSession, path: str) -> HybridIndex | None:
    """The newest whole version; None if there is none, or if one of its parts is gone."""
    row = _newest(spark, path)
    if row is None:
        return None
    try:
        parts = [spark.read.parquet(f"{path}/{row.folder}/{part}") for part in ("points", "vectors", "cells", "postings")]
    except AnalysisException:
        return None
    return HybridIndex(*parts, json.loads(row.state))
