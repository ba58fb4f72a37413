"""Searches of a table of queries in one pass: the exact k best per query, from blocks of postings and cells of vectors.

Both searches go the same way. What is searched is stored in parts (a term's documents in one range of documents; the
vectors around one centre), and a small row for each part says how good its best can be at most. For every query its parts
are ordered by that bound; the SEEDS best are scored first, which gives a k-th score to beat; of the others only those whose
bound reaches it are scored. That is always exact, ties included, and reads less the better the parts are told apart.

The k best are taken by a window over each query whose limit Spark applies in every task before the shuffle, so a task
sends k rows of a query at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import encode
from graphloom.functions.text import tokens
from graphloom.operators import rank, vector
from graphloom.operators.graph import LITERALS, among
from graphloom.sources.shared import fresh, stored

#: Parts of a query that are scored before others are pruned.
SEEDS = 8
#: Documents of a block, at most.
BLOCK_BITS = 10
#: Rows that centres are chosen from, at most (a sample by hash; every vector is indexed), and centres.
SAMPLE, CENTRES = 20_000, 256
#: Points and queries that meet in one step of a task, about, and queries whose scores are held at once.
POINTS, ASKED, SLICE = 8192, 4096, 256
#: What bounds and scores of size 1, which are sums in different orders, may differ by.
NEAR = 1e-9


def top(scored: DataFrame, k: int, rising: bool = True) -> DataFrame:
    """The k best of each query (query_id, doc_id, score) with their rank, ties to smaller ids."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if rising else F.asc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Pruned:
    """rows: query_id, doc_id, score and rank; first and rest: the parts (query_id, part, bound, bar) that were scored."""

    rows: DataFrame
    first: DataFrame
    rest: DataFrame


def pruned(bounds: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, rising: bool = True, seeds: int = SEEDS) -> Pruned:
    """bounds: query_id, part, n (rows of the part, 1 at least), bound (no score of the part is beyond it); score: those parts'
    query_id, doc_id and score, at least those of each query's k best, and of these only such as reach its bar (a column of
    the parts, null for none), less what sums in different orders may differ by (NEAR). Scored first are the best `seeds` parts, and more where these have not k rows together."""
    bounds = stored(bounds, "bounds")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound") if rising else F.asc("bound"), "part")
    begun = bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(seeds, k))
    held = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = begun.withColumn("held", held).filter((F.col("r") <= seeds) | (F.col("held") < k)).select("query_id", "part", "bound", F.lit(None).cast("double").alias("bar"))
    best = stored(top(score(first), k, rising).drop("rank"), "first")
    least = F.min("score") if rising else F.max("score")
    bar = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, least).alias("bar"))
    reached = F.col("bound") >= F.col("bar") - NEAR * (1 + F.abs("bar")) if rising else F.col("bound") <= F.col("bar") + NEAR * (1 + F.abs("bar"))
    others = bounds.join(first.select("query_id", "part"), ["query_id", "part"], "left_anti")
    rest = others.join(bar, "query_id", "left").filter(F.col("bar").isNull() | reached).select("query_id", "part", "bound", "bar")
    found = top(best.unionByName(score(rest)), k, rising)
    return Pruned(found.withColumn("score", F.round("score", 6)), first, rest)


# Postings


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, block, dl, term and tf. Documents are dealt and sorted by id once; a block is up to 2 ** BLOCK_BITS successive
    ones, however far apart their ids are. Terms are counted inside each document's row."""
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    at = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)).withColumn("c", encode.counted(F.col("text")))
    length = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sized = at.select("doc_id", "block", "c", length.alias("dl"))  # here, as beside explode() it would be worked out for every term
    each = sized.select("doc_id", "block", "dl", F.explode_outer("c").alias("x")).filter("x IS NOT NULL")  # explode() would have texts counted once more, for a filter below it
    return each.select("doc_id", "block", "dl", F.col("x.t").alias("term"), F.col("x.n").alias("tf"))


def map_weights(points: DataFrame, key: str = "id", column: str = "sparse") -> DataFrame:
    """doc_id, block, term and weight from maps of weights, blocks as term_counts() cuts them."""
    dealt = points.select(F.col(key).alias("doc_id"), F.col(column).alias("w")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    at = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    return at.select("doc_id", "block", F.explode("w").alias("term", "weight"))


def blocked(weights: DataFrame) -> DataFrame:
    """Postings in blocks, from doc_id, block, term and weight (not below 0): term, block, n, top (the greatest weight) and
    entries, the block's documents with their weights."""
    entry = F.struct("doc_id", "weight")
    return weights.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top"), F.sort_array(F.collect_list(entry)).alias("entries"))


def bm25_weights(counts: DataFrame, avgdl: float) -> DataFrame:
    """The part of a BM25 score that does not depend on the query."""
    tf = F.col("tf")
    return counts.select("doc_id", "block", "term", (tf / (tf + rank.K1 * (1 - rank.B + rank.B * F.col("dl") / F.lit(avgdl or 1.0)))).alias("weight"))


def asked(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """query_id and term: each word of a query once, without the index's common words."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    kept = F.filter(words, lambda t: (t != "") & ~t.isin(rank.STOP_WORDS))
    return queries.select(F.col(query_id).alias("query_id"), F.explode(kept).alias("term"))


def of_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms asked for: literals that the scan skips by where they are few, joined else."""
    few = [r.term for r in terms.select("term").distinct().limit(LITERALS + 1).collect()]
    return postings.filter(among("term", sorted(few))) if len(few) <= LITERALS else postings.join(terms.select("term").distinct(), "term", "left_semi")


def best_postings(postings: DataFrame, weighted: DataFrame, k: int = 5, seeds: int = SEEDS, within: DataFrame | None = None) -> Pruned:
    """The k documents of each query with the largest sum of weight times the posting's weight. weighted: query_id, term and
    weight; within: doc_id of those that may be found (all, without)."""
    mine = of_terms(postings, weighted)
    heads = mine.select("term", F.col("block").alias("part"), "n", "top").join(weighted, "term")
    bounds = heads.groupBy("query_id", "part").agg(F.max("n").alias("n"), F.sum(F.greatest("weight", F.lit(0.0)) * F.col("top")).alias("bound")).filter("bound > 0")

    def score(parts: DataFrame) -> DataFrame:
        wanted = parts.select("query_id", F.col("part").alias("block")).join(weighted, "query_id")
        each = wanted.join(mine.select("term", "block", "entries"), ["term", "block"]).select("query_id", "weight", F.explode("entries").alias("e"))
        summed = each.groupBy("query_id", F.col("e.doc_id").alias("doc_id")).agg(F.round(rank.total(F.col("weight") * F.col("e.weight")), 12).alias("score")).filter("score > 0")
        return summed if within is None else summed.join(within.select("doc_id"), "doc_id", "left_semi")

    return pruned(bounds, score, k, seeds=seeds)


def bm25(index: dict, queries: DataFrame, k: int = 5, seeds: int = SEEDS, query_id: str = "query_id", text: str = "query") -> Pruned:
    """The k best documents of each query by BM25, from a stored index (sources.index.load_lexical)."""
    terms = asked(queries, query_id, text)
    mine = of_terms(index["postings"], terms)
    df = mine.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(index["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = stored(terms.join(df, "term").select("query_id", "term", idf.alias("weight")), "asked")
    return best_postings(index["postings"], weighted, k, seeds)


def sparse(postings: DataFrame, queries: DataFrame, k: int = 5, seeds: int = SEEDS, query_id: str = "query_id", text: str = "query", within: DataFrame | None = None) -> Pruned:
    """The k documents of each query with the largest dot product of sparse encodings."""
    each = queries.select(F.col(query_id).alias("query_id"), F.explode(encode.sparse(F.col(text))).alias("term", "weight"))
    return best_postings(postings, stored(each, "asked"), k, seeds, within)


# Cells


def centres_of(points: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = CENTRES) -> np.ndarray:
    """Centres of cells: some rounds of k-means over a sample of at most SAMPLE vectors, which come to the driver. The sample
    only decides where cells lie; whatever it is, bounds hold and results are exact."""
    rows = points.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(column).cast("array<double>").alias("v")).toArrow()["v"]
    if not len(rows):
        return np.zeros((0, 0))
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.chunks]).reshape(len(rows), -1)
    n = max(1, min(most, int(np.sqrt(len(x)) * 2)))
    centres = x[:n].copy()
    for _ in range(5):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        total[count > 0] = np.add.reduceat(x[order], (np.cumsum(count) - count)[count > 0])
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def celled(points: DataFrame, dimension: int, column: str = "embedding", key: str = "vec_id", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """points whose vector is one, with `cell`, stored (at path, or in the shared folder); and a row for each cell: centre,
    radius, n. A vector goes to its nearest centre; the radius is the greatest distance found."""
    sound = points.filter(vector.usable(F.col(column), dimension))
    centres = centres_of(sound, column, key)  # CENTRES at most

    @F.pandas_udf("struct<cell:int,far:double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(vectors), 1024):
            x = np.stack(vectors.iloc[i : i + 1024].to_list())
            near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
            out.append(pd.DataFrame({"cell": near, "far": np.sqrt(((x - centres[near]) ** 2).sum(1))}))
        return pd.concat(out) if out else pd.DataFrame({"cell": [], "far": []})

    placed = sound.withColumn("_p", place(F.col(column).cast("array<double>"))).select(*points.columns, F.col("_p.cell").alias("cell"), F.col("_p.far").alias("far"))
    spark = points.sparkSession
    path = path or fresh(spark, "cells")
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.parquet(path)
    table = spark.read.schema(placed.schema).parquet(path)
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    cells = table.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).join(middle, "cell")
    return table.drop("far"), cells


def nearest_of(metric: str, k: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one step does with some points of a cell and some queries: the points that may be among a query's k best, with
    their scores. A product of matrices, with a margin for its rounding, tells which these are; their scores are then summed
    in the order of the components, as the measures of operators.vector do it, so that equal vectors have equal scores."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, size)

    def summed(products: np.ndarray) -> np.ndarray:
        return 0.0 + np.add.accumulate(products, axis=1)[:, -1]

    def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if metric in ("euclid", "inverse"):
            d = np.sqrt(summed((x - q) * (x - q)))
            return 1.0 / (1.0 + d) if metric == "inverse" else d
        inner = summed(x * q)
        if metric == "dot":
            return inner
        n = np.sqrt(summed(x * x)) * np.sqrt(summed(q * q))
        return np.where(n > 0, inner / np.where(n > 0, n, 1.0), 0.0)

    def farthest(score: np.ndarray) -> np.ndarray:
        """The distance that a score no worse than this one, or nearly so, has at most."""
        if metric == "euclid":
            return score + NEAR * (1 + score)
        worst = score - NEAR * (1 + score)
        return np.where(worst > 0, 1.0 / np.where(worst > 0, worst, 1.0) - 1.0, np.inf)

    def nearest(points: pa.Table, queries: pa.Table) -> pa.Table:
        points, empty = points.take(pc.sort_indices(points["doc_id"])) if len(points) else points, pa.table({"query_id": queries["query_id"][:0], "doc_id": points["doc_id"][:0], "score": pa.array([], pa.float64())})
        if not len(points) or not len(queries):
            return empty
        x, q = matrix(points["v"]), matrix(queries["vector"])
        bar = queries["bar"].to_numpy().astype(float)
        # of equal vectors only the k of the smallest ids can be among the best
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * size))).ravel(), return_inverse=True)[1]
        place = np.flatnonzero(pd.Series(same).groupby(same).cumcount().to_numpy() < k)
        x = x[place]
        norms, own = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        slack = 4e-15 * (size + 1)
        distance = metric in ("euclid", "inverse")
        unit = lambda m, n: m / np.where(n > 0, n, 1.0)[:, None]
        right = unit(x, norms).T if metric == "cosine" else x.T
        out = []
        for i in range(0, len(q), SLICE):
            part, least, n = q[i : i + SLICE], bar[i : i + SLICE], own[i : i + SLICE]
            if distance:
                good, margin = 2 * part @ right - norms**2 - (n**2)[:, None], slack * (n**2 + (norms**2).max())
                floor = -(farthest(least) ** 2) - margin
            elif metric == "dot":
                good, margin = part @ right, slack * n * norms.max()
                floor = least - NEAR * (1 + np.abs(least)) - margin
            else:
                good, margin = unit(part, n) @ right, np.full(len(part), slack)
                floor = least - NEAR * (1 + np.abs(least)) - margin
            floor = np.where(np.isnan(least), -np.inf, floor)
            many = np.flatnonzero((good >= floor[:, None]).sum(1) > 4 * k)
            if len(many) and len(x) > k:
                kth = np.partition(good[many], len(x) - k, axis=1)[:, len(x) - k]
                if distance:
                    d = np.sqrt(np.maximum(-kth, 0) + margin[many])
                    own_floor = -(farthest(1.0 / (1.0 + d) if metric == "inverse" else d) ** 2) - margin[many]
                else:
                    own_floor = kth - NEAR * (1 + np.abs(kth)) - 2 * margin[many]
                floor[many] = np.fmax(floor[many], own_floor)
            a, b = np.nonzero(~(good < floor[:, None]))
            wide = max(1, (1 << 20) // size)
            scores = [exact(x[b[j : j + wide]], part[a[j : j + wide]]) for j in range(0, len(a), wide)]
            out.append((a + i, place[b], np.concatenate(scores) if scores else np.zeros(0)))
        a, b, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": queries["query_id"].take(pa.array(a)), "doc_id": points["doc_id"].take(pa.array(b)), "score": pa.array(scores)})

    return nearest


def best_vectors(points: DataFrame, cells: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", seeds: int = SEEDS, column: str = "embedding", key: str = "vec_id", where: Column | None = None) -> Pruned:
    """The k nearest points of each query, as vector.search() has them for one. points and cells: of celled(); queries: query_id
    and vector. By the triangle inequality nothing in a cell is nearer than its centre less its radius (Euclid), nor has a
    larger dot product than the centre's plus radius times the query's norm, nor a smaller angle than the centre's less the
    widest angle of the cell. Cells' rows (CENTRES at most) go to every task of the queries. A step of a task has about POINTS
    points of one cell and ASKED queries at most, however many there are of both."""
    rising = vector.METRICS.get(metric, vector.METRICS["cosine"])[1]
    told = cells.select("cell", "centre", "radius", "n").orderBy("cell").toPandas()  # CENTRES rows at most
    number, radius = told["cell"].to_numpy(), told["radius"].to_numpy()
    centre = np.stack(told["centre"].to_list()) if len(told) else np.zeros((0, 1))
    size = centre.shape[1]

    @F.pandas_udf("array<double>")
    def bound(vectors: pd.Series) -> pd.Series:
        q = np.stack(vectors.to_list())
        norm, own = np.sqrt((q * q).sum(1))[:, None], np.sqrt((centre * centre).sum(1))
        inner = q @ centre.T
        if metric == "dot":
            best = inner + norm * radius
        elif metric in ("euclid", "inverse"):
            distance = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * inner + own * own, 0))
            best = np.maximum(distance - radius - 1e-6, 0)
            best = 1 / (1 + best) if metric == "inverse" else best
        else:
            angle = np.arccos(np.clip(inner / np.maximum(norm * own, 1e-300), -1, 1))
            wide = np.where(radius < own, np.arcsin(np.clip(radius / np.maximum(own, 1e-300), 0, 1)), np.pi)
            best = np.cos(np.maximum(angle - wide - 1e-6, 0))
            best = np.where((norm == 0) | (radius >= own), 1.0, best)
        return pd.Series(list(best))

    sound = queries.filter(vector.usable(F.col("vector"), size)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if not len(told):
        sound = sound.filter("false")
    listed = lambda xs, kind: F.array(*[F.lit(int(x)) for x in xs]).cast(f"array<{kind}>")
    each = sound.select("query_id", F.posexplode(bound("vector")).alias("i", "bound"))
    bounds = each.select("query_id", F.get(listed(number, "int"), F.col("i")).alias("part"), F.get(listed(told["n"], "long"), F.col("i")).alias("n"), "bound")

    groups = max(1, -(-sound.count() // ASKED))
    steps = {int(c): -(-int(n) // POINTS) for c, n in zip(number, told["n"], strict=True)}
    steps_of = F.coalesce(F.get(F.array(*[F.lit(steps.get(c, 1)) for c in range(max(steps, default=0) + 1)]), F.col("cell")), F.lit(1))
    step = F.pmod(F.xxhash64(key), steps_of)
    kept = points if where is None else points.filter(where)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))
    met = kept.select("cell", step.cast("long").alias("step"), every.alias("group"), F.col(key).alias("doc_id"), F.col(column).cast("array<double>").alias("v"))
    schema = StructType([sound.schema["query_id"], met.schema["doc_id"]]).add("score", "double")
    nearest = nearest_of(metric if metric in vector.METRICS else "cosine", k, size)

    def score(parts: DataFrame) -> DataFrame:
        wanted = parts.select("query_id", F.col("part").alias("cell"), "bar").join(sound, "query_id")
        dealt = wanted.withColumn("step", F.explode(F.sequence(F.lit(0), steps_of - 1).cast("array<long>"))).withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("long"))
        keys = ["cell", "step", "group"]
        found = met.groupBy(*keys).cogroup(dealt.select(*keys, "query_id", "vector", "bar").groupBy(*keys)).applyInArrow(nearest, schema)
        return found.withColumn("score", F.round("score", 12))

    return pruned(bounds, score, k, rising, seeds)


# Both


def fused(lists: list[DataFrame], k: int = 5, constant: float = 2.0, base: int = 0, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of the lists (query_id, doc_id, rank) of each query: query_id, doc_id, score and rank."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "doc_id", (F.lit((weights or [1.0] * len(lists))[i]) / (F.lit(constant) + F.col("rank") - 1 + base)).alias("s"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy("query_id", "doc_id").agg(F.round(rank.total(F.col("s")), 12).alias("score"))
    return top(summed, k).withColumn("score", F.round("score", 6))
