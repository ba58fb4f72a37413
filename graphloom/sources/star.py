"""The star schema as a property graph: entities and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERIC = "Entity"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over enough tasks for work that costs much a row: a scan of fewer parts than there are cores (a small table, or
    one of few row groups) is dealt by key, at most eight tasks for a part. A large table stays as it is scanned."""
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 8 * parts), key) if 0 < parts < cores else df


#: Rows that a task of an exchange has, about.
TASK_ROWS = 1 << 19


def tasks_for(rows: int) -> int | None:
    """How many tasks an exchange of so many rows is dealt over, so that a task's memory does not grow with the table; None,
    which leaves it to the session's setting, for what four tasks can hold."""
    return -(-rows // TASK_ROWS) if rows > 4 * TASK_ROWS else None


#: Documents that a task has which works on their lines, about.
TASK_DOCS = 4096


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by their id over tasks of about TASK_DOCS, which Parquet's footers count: what works on a document's
    lines then keeps them where they are, and its memory does not grow with the table."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.count()
    return docs.repartition(max(2, -(-rows // TASK_DOCS)), "doc_id") if rows > TASK_DOCS else spread(docs, "doc_id")


def edge_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """tasks_for() the edges, of which there are about as many as line items; these are counted in Parquet's footers."""
    return tasks_for(table(spark, sf_dir, "lineitem").count())


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_type, entity_role, labels; ids are unique."""

    def some(name: str, id_, role, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(id_.alias("id"), F.lit(kind).alias("entity_type"), role.alias("entity_role"))

    part_id = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    parts = [
        some("region", F.col("r_name"), F.lit(""), "region"),
        some("nation", F.col("n_name"), F.lit(""), "nation"),
        some("customer", F.col("c_name"), F.col("c_mktsegment"), "customer"),
        some("supplier", F.col("s_name"), F.lit(""), "supplier"),
        some("part", part_id, F.col("p_type"), "part"),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("labels", F.array(F.lit(GENERIC), F.upper("entity_type")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, rel_type."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    names = nation.select("n_nationkey", "n_name")
    supply, parts, suppliers, tasks = t("lineitem").select("l_suppkey", "l_partkey"), t("part").select("p_partkey", "p_name"), t("supplier"), edge_tasks(spark, sf_dir)
    if tasks:  # repeats and the part's row are in the same task, which holds its share of the parts
        supply, parts, suppliers = supply.repartition(tasks, "l_partkey"), parts.hint("shuffle_hash"), suppliers.hint("shuffle_hash")
    supply = supply.distinct().join(parts, F.col("l_partkey") == F.col("p_partkey"))
    supply = supply.repartition(tasks, "l_suppkey") if tasks else supply
    part_id = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    kinds = [
        nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("IN_REGION").alias("rel_type")),
        t("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("LIVES_IN").alias("rel_type")),
        t("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("BASED_IN").alias("rel_type")),
        supply.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("source"), part_id.alias("target"), F.lit("SUPPLIES").alias("rel_type")),
    ]
    return reduce(DataFrame.unionByName, kinds)


def keyword_documents(docs: DataFrame, keyword: str | None, most: int = 10) -> DataFrame | None:
    """id (from 0) and content of the first documents that hold the keyword; None for no keyword."""
    if keyword is None:
        return None
    from pyspark.sql import Window

    found = docs.filter(F.contains(F.lower("text"), F.lit(keyword.lower()))).select("doc_id", "text").orderBy("doc_id").limit(most)
    return found.select((F.row_number().over(Window.orderBy("doc_id")) - 1).alias("id"), F.col("text").alias("content"))
