"""Texts of search results for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _end(id_: str, kind: str, role: str) -> Column:
    return F.concat(F.col(id_), F.lit(" ("), F.coalesce(kind, F.lit("Unknown")), F.when(F.coalesce(role, F.lit("")) == "", "").otherwise(F.concat(F.lit(", "), F.col(role))), F.lit(")"))


def _joined(rows: DataFrame, order: list, line: Column, between: str, empty: str) -> DataFrame:
    """One row: the lines of a short list in order."""
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy(*order))).select("i", line.alias("line"))
    return numbered.agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x")).select(F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda x: x["line"]), between)).otherwise(empty).alias("context"))


def graph_context(triples: DataFrame) -> DataFrame:
    line = F.concat(F.col("i").cast("string"), F.lit(". "), _end("source_id", "source_type", "source_role"), F.lit(" --["), F.col("relationship"), F.lit("]--> "), _end("target_id", "target_type", "target_role"))
    return _joined(triples, ["source_id", "relationship", "target_id"], line, "\n", "No graph relationships found.")


def chunk_context(rows: DataFrame) -> DataFrame:
    """rows: doc_id, score, text."""
    line = F.concat(F.lit("[Chunk "), F.col("i").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    return _joined(rows, [F.desc("score"), "doc_id"], line, "\n\n", "No relevant document chunks found.")
