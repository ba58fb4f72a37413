"""Vector collections: distances, search, upsert and deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def inverse(a: Column, b: Column) -> Column:
    """A distance as a similarity: 1 / (1 + d)."""
    return 1.0 / (1.0 + euclid(a, b))


def usable(vector: Column, dimension: Column | int) -> Column:
    """Whether a vector is there, has that many components, and has no null, NaN or infinite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False), "inverse": (inverse, True)}


def search(points: DataFrame, query: list[float] | Column, k: int = 5, metric: str = "cosine", threshold: float = 0.0, where: dict | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest points with their score; an unknown metric means cosine; a threshold of 0 means none. Points whose vector
    is none (see usable()), or of another size than the query's, are not among them. Filters and columns reach the scan, and
    the top k is taken per task before it is merged."""
    measure, rising = METRICS.get(metric, METRICS["cosine"])
    kept = reduce(lambda df, x: df.filter(F.col(x[0]) == x[1]), (where or {}).items(), points)
    y = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    kept = kept.filter(usable(F.col(vector), F.size(y) if isinstance(query, Column) else len(query)))
    best = kept.withColumn("score", F.round(measure(F.col(vector), y), 12)).orderBy(F.desc("score") if rising else F.asc("score"), key).limit(k)
    if threshold > 0:  # the k best of those beyond the threshold are those of the k best that are beyond it
        best = best.filter(F.col("score") >= threshold if rising else F.col("score") <= threshold)
    return best.withColumn("score", F.round("score", 6))


def upsert(old: DataFrame, new: DataFrame, key: str = "vec_id", seq: str | None = None) -> DataFrame:
    """old with new's rows, which replace those of the same key. Of several new rows with a key the last by seq counts (by
    their other columns in order, where there is no seq)."""
    others = [c for c in old.columns if c != key]
    # one struct is both what is compared and what is kept, and the ids alone go to the join, not the rows that were chosen
    last = new.groupBy(key).agg(F.max(F.struct(*([F.col(seq).alias("_seq")] if seq else []), F.struct(*others).alias("_p"))).alias("r")).select(key, *[F.col("r._p")[c].alias(c) for c in others])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def delete_where(points: DataFrame, where: dict) -> DataFrame:
    """points without the rows that have all the given values; a filter without values matches every row, as in search()."""
    return points.filter(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in where.items()], F.lit(True)))
