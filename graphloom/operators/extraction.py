"""What a model extracts from chunks, as JSON payloads, to rows of nodes and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ("id", "entity_type", "entity_role")
RELATIONSHIP = ("source", "target", "relationship_type")
SCHEMA = f"nodes array<struct<{','.join(f'{n}:string' for n in NODE)}>>, relationships array<struct<{','.join(f'{n}:string' for n in RELATIONSHIP)}>>"
ANALYSIS = "target_entities array<string>, excluded_entities array<string>, normalized_query string"


def usable(chunks: DataFrame, payload: str = "payload", content: str = "content") -> DataFrame:
    """The chunks with text whose payload is JSON with both nodes and relationships, and it parsed, as column x. A chunk
    without (the call failed, the answer is malformed, or lacks a list) takes no further part."""
    filled = F.length(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", "")) > 0
    return chunks.filter(filled).withColumn("x", F.from_json(payload, SCHEMA)).filter("x.nodes IS NOT NULL AND x.relationships IS NOT NULL")


def _rows(found: DataFrame, field: str, names: tuple[str, ...], seq: str) -> DataFrame:
    """The structs of one list, missing fields as '', with seq, the order of chunks and places in them."""
    each = found.select(F.col(seq).alias("chunk_seq"), F.posexplode(f"x.{field}").alias("i", "n"))
    return each.select("chunk_seq", (F.shiftleft(F.col("chunk_seq"), 20) + F.col("i")).alias("seq"), *[F.coalesce(F.col(f"n.{c}"), F.lit("")).alias(c) for c in names])


def nodes(found: DataFrame, seq: str = "seq") -> DataFrame:
    return _rows(found, "nodes", NODE, seq)


def relationships(found: DataFrame, seq: str = "seq") -> DataFrame:
    return _rows(found, "relationships", RELATIONSHIP, seq).withColumnRenamed("relationship_type", "rel_type")


def analysis(answer: Column, query: Column) -> Column:
    """A model's analysis of a query as a struct: no targets and exclusions where they are missing, and the query itself."""
    x = F.from_json(answer, ANALYSIS)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(x["target_entities"], none).alias("target_entities"), F.coalesce(x["excluded_entities"], none).alias("excluded_entities"),
        F.coalesce(x["normalized_query"], query).alias("normalized_query"),
    )


def rendered(template: str, values: dict[str, str | Column]) -> Column:
    """The template with each {{ name }} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        for mark in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            out = F.replace(out, F.lit(mark), value if isinstance(value, Column) else F.lit(value))
    return out
