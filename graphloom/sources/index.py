"""Stored indexes: BM25 postings by term, vectors, the token table, and collections of points as catalog tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import rank
from graphloom.sources.shared import PACKED

SLOTS = 64


def slot(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(SLOTS)).cast("int")


#: Documents for each file of a slot, and blocks of a term that stay in one file.
FILE_DOCS, RUN_BITS = 1 << 20, 8


def _save_postings(blocks: DataFrame, path: str, n_docs: int) -> None:
    """Blocks of postings in folders by slot of the term, in the order of term and block. A slot has a file for every FILE_DOCS
    documents, and runs of a term's blocks are dealt over them, so a frequent term is as many files' work as the corpus is large."""
    rows = blocks.withColumn("slot", slot(F.col("term")))
    file = F.pmod(F.xxhash64("term", F.shiftright("block", RUN_BITS)), F.lit(n_docs // FILE_DOCS + 1))
    dealt = rows.repartition("slot", file).sortWithinPartitions("slot", "term", "block")
    dealt.write.mode("overwrite").options(**SKIPPING).partitionBy("slot").parquet(path)


def save_lexical(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """BM25 postings in blocks (operators.many.blocked), and the corpus row."""
    from graphloom.operators import many

    stats = rank.corpus_stats(docs, text).first()
    _save_postings(many.blocked(many.bm25_weights(many.term_counts(docs, doc_id, text), stats["avgdl"])), f"{path}/postings", stats["n_docs"])
    row = docs.sparkSession.createDataFrame([(stats["n_docs"], stats["avgdl"], rank.K1, rank.B)], "n_docs long, avgdl double, k1 double, b double")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/corpus")


def save_sparse(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Postings of the sparse encodings' weights by term, in blocks."""
    from graphloom.operators import many

    weights = many.term_counts(docs, doc_id, text).select("doc_id", "block", "term", (1 + F.log(F.col("tf").cast("double"))).alias("weight"))
    _save_postings(many.blocked(weights), f"{path}/postings", docs.count())


def load_lexical(spark: SparkSession, path: str) -> dict | None:
    """The postings as a DataFrame, n_docs and avgdl; None if there is no index at path."""
    try:
        row = spark.read.json(f"{path}/corpus").first()
        return {"postings": spark.read.parquet(f"{path}/postings"), "n_docs": row["n_docs"], "avgdl": row["avgdl"] if "avgdl" in row else None}
    except (AnalysisException, KeyError, ValueError, TypeError):
        return None


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms: their folders only, and in these the terms' row groups."""
    slots = sorted({r[0] for r in postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(slot(F.col("t"))).collect()}) if terms else []
    return postings.filter(F.col("slot").isin(slots) & F.col("term").isin(terms))


#: Small pages and row groups, so that an equality or a prefix skips to some thousand rows of a large sorted table.
SKIPPING = {"parquet.block.size": 8 << 20, "parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 2000}


def save_tokens(entities: DataFrame, path: str) -> None:
    """The token index of the entities' ids: postings by token, and the tokens by their deletion keys."""
    from graphloom.operators.graph import deletion_keys, token_index

    postings = token_index(entities)
    postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").options(**SKIPPING).parquet(f"{path}/postings")
    tokens = postings.sparkSession.read.parquet(f"{path}/postings")
    deletion_keys(tokens).repartitionByRange("key", "token").sortWithinPartitions("key", "token").write.mode("overwrite").options(**SKIPPING).parquet(f"{path}/keys")


def load_tokens(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The postings and keys as graph.fuzzy() takes them; None if there is no index at path."""
    try:
        return {k: spark.read.parquet(f"{path}/{k}") for k in ("postings", "keys")}
    except AnalysisException:
        return None


def save_vectors(points: DataFrame, path: str, metric: str = "cosine") -> None:
    points.write.mode("overwrite").parquet(f"{path}/vectors")
    points.sparkSession.range(1).select(F.lit(metric).alias("metric")).coalesce(1).write.mode("overwrite").json(f"{path}/state")


def load_vectors(spark: SparkSession, path: str) -> dict | None:
    """The vectors as a DataFrame, and their metric; None if there is no index at path."""
    try:
        return {"points": spark.read.parquet(f"{path}/vectors"), "metric": spark.read.json(f"{path}/state").first()["metric"]}
    except (AnalysisException, TypeError):
        return None


#: The columns of a collection. sparse: weights by term.
POINT = "id string, dense array<double>, sparse map<string,double>, content string, doc_id string, chunk_type string"
METRICS = ("cosine", "dot", "euclid")


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is such a collection. One whose replacement by put() was broken off between two renames is put back."""
    there, before = spark.catalog.tableExists(name), f"{name}__before"
    if spark.catalog.tableExists(before):
        spark.sql(f"DROP TABLE {before}" if there else f"ALTER TABLE {before} RENAME TO {name}")
        there = True
    return there


def create(spark: SparkSession, name: str, dimension: int, metric: str = "cosine", sparse: bool = True) -> bool:
    """A collection as a table; one that is there already stays as it is. An unknown metric means cosine."""
    if exists(spark, name):
        return True
    told = f"'dimension' = '{int(dimension)}', 'metric' = '{metric if metric in METRICS else 'cosine'}', 'sparse' = '{str(sparse).lower()}'"
    packed = ", ".join(f"'{k}' = '{v}'" for k, v in PACKED.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({POINT}) USING parquet OPTIONS ({packed}) TBLPROPERTIES ({told})")
    return True


def ensure(spark: SparkSession, name: str, dimension: int) -> None:
    if not exists(spark, name):
        create(spark, name, dimension)


def drop(spark: SparkSession, name: str) -> bool:
    """Whether there was a collection to drop."""
    there = exists(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def info(spark: SparkSession, name: str) -> dict | None:
    """name, points_count, vectors_count, dimension, metric and status; None if there is no such collection."""
    if not exists(spark, name):
        return None
    n, vectors = spark.table(name).agg(F.count(F.lit(1)), F.count_if(F.size("dense") > 0)).first()
    told = properties(spark, name)
    return {"name": name, "points_count": n, "vectors_count": vectors, "dimension": int(told["dimension"]), "metric": told["metric"], "status": "green"}


#: Ids that go to every task; rows that meet more than these are exchanged.
SENT = 1 << 18


def _meet(rows: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """rows semi- or anti-joined with n ids; null equals null."""
    ids = ids.select(F.col("id").alias("_id"))
    return rows.join(F.broadcast(ids) if n <= SENT else ids, F.col("id").eqNullSafe(F.col("_id")), how)


def _after(old: DataFrame, new: DataFrame, seq: str | None) -> tuple[DataFrame, int]:
    """The points of vector.upsert(), and how many were given. Ids alone are exchanged and counted first. A new point whose id
    comes once then goes where it is written without an exchange, and so does an old one; those with an id that comes several
    times are exchanged to find the last, and old ones only where more than SENT are replaced and more than SENT are kept."""
    from graphloom.operators.vector import upsert

    both = old.select("id", F.lit(0).alias("new")).union(new.select("id", F.lit(1)))
    seen = both.groupBy("id").agg(F.sum("new").alias("n_new"), F.sum(1 - F.col("new")).alias("n_old"))
    again, met = F.col("n_new") > 1, F.col("id").isNotNull() & (F.col("n_new") > 0)
    replaced, kept = met & (F.col("n_old") > 0), ~met & (F.col("n_old") > 0)
    n = seen.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("given"), F.count_if(again).alias("again"), F.count_if(replaced).alias("replaced"), F.count_if(kept).alias("kept")).first()

    # maps cannot be compared, so upsert sees them as sorted entries
    flat = lambda df: df.withColumn("sparse", F.array_sort(F.map_entries("sparse")))
    last = lambda df: upsert(flat(old.limit(0)), flat(df), "id", seq).withColumn("sparse", F.map_from_entries("sparse"))
    if n.again > SENT:
        now = last(new)
    elif n.again:
        now = _meet(new, seen.filter(again), n.again, "left_anti").select(*old.columns).unionByName(last(_meet(new, seen.filter(again), n.again, "left_semi")))
    else:
        now = new.select(*old.columns)
    if n.kept and n.replaced:
        fewer = n.kept < n.replaced
        old = _meet(old, seen.filter(kept if fewer else replaced), min(n.kept, n.replaced), "left_semi" if fewer else "left_anti")
    return (old.unionByName(now) if n.kept else now), n.given


def put(spark: SparkSession, name: str, points: DataFrame, seq: str | None = None) -> int:
    """Points into a collection, replacing those of the same id (the last by seq counts); how many were given. A point whose
    vector is not of the collection's size, or is none, fails the whole call. The new table is written beside the old one and
    then takes its name: old renamed, new renamed, old dropped. A call broken off before that leaves the old one, one broken
    off within it is settled by exists(), which every call here goes through."""
    from graphloom.operators.vector import usable

    columns = [f.strip().split(" ")[0] for f in POINT.replace("map<string,double>", "map").split(",")]
    if not exists(spark, name):
        raise ValueError(f"there is no collection {name}")
    told = properties(spark, name)
    fresh = f"{name}_{uuid.uuid4().hex[:8]}"
    wrong = F.raise_error(F.concat(F.lit(f"{name} takes vectors of {told['dimension']} numbers; not that of point "), F.coalesce("id", F.lit("null"))))
    checked = F.when(usable(F.col("dense"), int(told["dimension"])), F.col("dense")).otherwise(wrong.cast("array<double>"))
    rows = points.select(*columns, *([seq] if seq else [])).withColumn("dense", checked)
    create(spark, fresh, int(told["dimension"]), told["metric"], told["sparse"] == "true")
    try:
        both, given = _after(spark.table(name), rows, seq)
        both.write.mode("append").insertInto(fresh)
    except Exception as e:
        spark.sql(f"DROP TABLE {fresh}")
        raise ValueError(f"the points were not put into {name}, which stays as it was") from e
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__before")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    spark.sql(f"DROP TABLE {name}__before")
    return given


def clear(spark: SparkSession, name: str) -> None:
    """All points of a collection go."""
    spark.sql(f"TRUNCATE TABLE {name}")
