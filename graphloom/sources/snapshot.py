"""Backup of a graph as CSV folders with a metadata file, and its restoration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import stored
from graphloom.sources.star import tasks_for

VERSION = "1.0"
NODE = "id string, labels string, entity_type string, entity_role string"
RELATIONSHIP = "source string, target string, type string"
#: Records of a file: one is read by one task, as a value may hold line breaks.
FILE_RECORDS = 1_000_000
BROKEN = "_broken"


def _written(df: DataFrame, path: str) -> None:
    """A value with a comma, quote or line break is quoted, quotes inside are doubled; null and the empty string look alike."""
    options = {"header": True, "escape": '"', "emptyValue": '""', "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxRecordsPerFile": FILE_RECORDS}
    df.write.mode("overwrite").options(**options).csv(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder or file, of which one may go over several lines; one of another number of fields is kept as it
    stands in the column BROKEN."""
    options = {"header": True, "escape": '"', "emptyValue": "", "multiLine": True, "enforceSchema": True, "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    return spark.read.options(**options).schema(f"{schema}, {BROKEN} string").csv(path)


def backup(entities: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Writes nodes, relationships and metadata below path; returns the counts, which are taken as the rows are written."""
    spark = entities.sparkSession
    seen = {"node_count": Observation(), "relationship_count": Observation()}
    count = F.count(F.lit(1)).alias("n")
    nodes = entities.select("id", F.concat_ws(";", "labels").alias("labels"), "entity_type", "entity_role")
    _written(nodes.observe(seen["node_count"], count), f"{path}/nodes")
    _written(edges.select("source", "target", F.col("rel_type").alias("type")).observe(seen["relationship_count"], count), f"{path}/relationships")
    counts = {k: v.get["n"] for k, v in seen.items()}
    row = spark.range(1).select(F.current_timestamp().cast("string").alias("backup_timestamp"), *[F.lit(v).alias(k) for k, v in counts.items()], F.lit(VERSION).alias("schema_version"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return counts


def metadata(spark: SparkSession, path: str) -> dict:
    """What backup() wrote about itself; nothing where that is missing or broken."""
    try:
        row = spark.read.schema("backup_timestamp string, node_count long, relationship_count long, schema_version string").json(f"{path}/metadata").first()
    except AnalysisException:
        return {}
    return {k: v for k, v in row.asDict().items() if v is not None} if row else {}


def restore_nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, f"{path}/nodes", NODE)
    return restored_nodes(rows.filter(F.col(BROKEN).isNull()))


def restored_nodes(rows: DataFrame) -> DataFrame:
    """Backup rows as entities: blank ids are left out, all labels are kept, one that has none but the generic one gets UNKNOWN."""
    labels = F.filter(F.transform(F.split(F.coalesce("labels", F.lit("")), ";"), F.trim), lambda x: x != "")
    named = rows.filter(F.length(F.trim(F.coalesce("id", F.lit("")))) > 0)
    out = F.when(F.size(labels) > 1, labels).otherwise(F.array(F.coalesce(F.get(labels, F.lit(0)), F.lit("Entity")), F.lit("UNKNOWN")))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return named.select("id", blank("entity_type"), blank("entity_role"), out.alias("labels"))


def restored_edges(rows: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """Backup rows as edges: all three fields, both ends among the entities, each triple once. tasks: as for graph.between()."""
    from graphloom.operators.graph import between

    return between(rows.filter(_whole()).select("source", "target", F.col("type").alias("rel_type")), entities, tasks).distinct()


def restore_edges(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    rows = _read(spark, f"{path}/relationships", RELATIONSHIP)
    return restored_edges(rows.filter(F.col(BROKEN).isNull()), entities, tasks_for(metadata(spark, path).get("relationship_count", 0)))


def _whole() -> Column:
    filled = F.lit(True)
    for c in ("source", "target", "type"):
        filled &= F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return filled


@dataclass
class Restored:
    """The graph after a restoration; rejects: what could not be taken, with part (nodes or relationships), reason and record;
    metadata: what the backup says of itself."""

    entities: DataFrame
    edges: DataFrame
    rejects: DataFrame
    metadata: dict
    read: dict[str, DataFrame]

    def counts(self) -> DataFrame:
        """One row: nodes_restored and relationships_restored (rows of the backup that were taken, repeats included), and errors."""
        parts = {"nodes_restored": self.read["nodes"], "relationships_restored": self.read["relationships"], "errors": self.rejects}
        every = None
        for name, df in parts.items():
            one = df.select(F.lit(name).alias("what"))
            every = one if every is None else every.unionByName(one)
        return every.agg(*[F.count_if(F.col("what") == name).alias(name) for name in parts])


def restore(spark: SparkSession, path: str, entities: DataFrame | None = None, edges: DataFrame | None = None, clear: bool = True) -> Restored:
    """A backup into a given graph, or into an empty one (clear, or none given). Restored rows are upserted: a node's type and
    role replace those of its id and its labels are added, an edge is there once. Broken records, nodes without an id,
    edges without a field and edges with an end that is not in the graph are rejected, and hold back nothing else."""
    from graphloom.operators.graph import between

    rows = {k: stored(_read(spark, f"{path}/{k}", v), k) for k, v in (("nodes", NODE), ("relationships", RELATIONSHIP))}  # parsed once
    sound = {k: df.filter(F.col(BROKEN).isNull()) for k, df in rows.items()}
    fresh = restored_nodes(sound["nodes"])
    empty = spark.createDataFrame([], fresh.schema), spark.createDataFrame([], "source string, target string, rel_type string")
    old, old_edges = empty if clear or entities is None else (entities, edges if edges is not None else empty[1])
    numbered = old.select("id", "entity_type", "entity_role", "labels", F.lit(0).alias("o")).unionByName(fresh.withColumn("o", F.lit(1)))
    last = F.max_by(F.struct("entity_type", "entity_role"), F.struct("o", "entity_type", "entity_role")).alias("p")
    labels = F.array_distinct(F.flatten(F.array_sort(F.collect_set(F.col("labels"))))).alias("labels")
    after = numbered.groupBy("id").agg(last, labels).select("id", "p.entity_type", "p.entity_role", "labels")
    named = sound["relationships"].filter(_whole()).select("source", "target", F.col("type").alias("rel_type"))
    taken = between(named, after)
    after_edges = old_edges.select("source", "target", "rel_type").unionByName(taken).distinct()
    ids = after.select("id")
    missing = named.join(ids, named["source"] == ids["id"], "left_anti").unionByName(named.join(ids, named["source"] == ids["id"], "left_semi").join(ids, named["target"] == ids["id"], "left_anti"))
    told = lambda df, part, reason: df.select(F.lit(part).alias("part"), F.lit(reason).alias("reason"), F.to_json(F.struct(*[c for c in df.columns if c != BROKEN])).alias("record"))
    broken = [df.filter(F.col(BROKEN).isNotNull()).select(F.lit(k).alias("part"), F.lit("broken record").alias("reason"), F.col(BROKEN).alias("record")) for k, df in rows.items()]
    rejects = [
        *broken,
        told(sound["nodes"].filter(F.length(F.trim(F.coalesce("id", F.lit("")))) == 0), "nodes", "no id"),
        told(sound["relationships"].filter(~_whole()), "relationships", "a field is missing"),
        told(missing, "relationships", "an end is not in the graph"),
    ]
    every = rejects[0]
    for one in rejects[1:]:
        every = every.unionByName(one)
    return Restored(after, after_edges, every, metadata(spark, path), {"nodes": fresh, "relationships": taken})
