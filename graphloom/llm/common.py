"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are what lies between these; the same class in Java, RE2 and Python.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_graphloom_shared", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark._graphloom_shared = folder
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: later steps survive lost executors and see the
    same rows however often they are computed. Rows go through Spark's own row format, so this is for tables of short rows;
    stored() writes columns, which is for the rest."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """nodes (a stored table comes back) with i, the place from 0 of each in its tree by order, and n, the tree's size.

    One sort by range; places are a row's number in its task's part of the tree, plus what earlier tasks hold of the tree:
    sums over a row for each task and tree."""
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = nodes.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    numbered = stored(dealt.withColumn("at", at)).withColumn("task", F.shiftright("at", 33))
    counts = numbered.groupBy("task", tree).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(tree)
    before = F.sum("here").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("task").alias("s_task"), F.col(tree).alias("s_tree"), F.col("first") - F.coalesce(before, F.lit(0)), F.sum("here").over(whole).alias("n"))
    starts = starts.toDF("s_task", "s_tree", "shift", "n")
    same = (F.col("task") == F.col("s_task")) & F.col(tree).eqNullSafe(F.col("s_tree"))
    return numbered.join(starts, same).withColumn("i", F.col("at") - F.col("shift")).drop("at", "task", "s_task", "s_tree", "shift")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it many times or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, unchanged, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
