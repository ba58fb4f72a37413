"""Operator 1, exact top-k search with block-at-a-time pruning.

Vectors become integers, floor(scale * x). Candidates are numbered in the order of their ids, and `block` successive ones
make a block, however far apart their ids are; a block keeps its forward
index (the integer matrix) and, per term (component), its maximum and minimum, so that the sum over terms of the larger
of q * max and q * min bounds the score of every row in it. Queries are dealt to groups. First the bounds alone are
computed, and each query is scored in the SEEDS blocks of the highest bounds, which gives it a k-th score to begin with.
Only blocks whose bound reaches that of some query of a group are then sent to the group. In a task, a group meets a
range of its blocks: per query they are taken in the order of their bounds (1, 2, 4, ... at a time) and scored through their
forward indexes until the bound falls below the query's k-th score (ties go on, as a smaller id may win). Ranges' results are merged by
rank. So vectors are shuffled once to make the blocks, and then in proportion to the pairs of block and group that survive.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; every
finite component does (an integer beyond a long's range counts as that range's end; sums are exact, and a score beyond the
range counts as its end, too); rows that repeat id and vector count once; an id with several vectors is several candidates,
and its first one (least vector) is the query; shorter vectors count as filled up with zeros; fewer than k candidates give
all; ties go to smaller ids; an empty table gives an empty result; other columns are not carried, so their names clash
with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, placed, stored

K = 10
SCALE = 1024
BLOCK = 128
RANGE = 128  # blocks a task holds
CHUNK = 4096  # bounds a task holds
GROUP = 512  # queries a task holds
SEEDS = 2
OUT = "query_id long, vec_id long, score long"
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and v, an array of long, of the rows that take part."""
    v = F.col("v").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    return named.filter(fine).select("vec_id", F.transform(v, whole).alias("v")).distinct()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of long as a matrix, shorter ones filled up with zeros."""
    flat, n = column.combine_chunks(), np.array(column.combine_chunks().value_lengths(), np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat.flatten().to_numpy()
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: through doubles where these are exact, through unbounded integers where longs are too short."""
    width = min(a.shape[1], b.shape[1])  # what is missing is zeros
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, width)
    if most < 2**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if most < 2**61 else a.astype(object) @ b.astype(object).T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return dot(np.maximum(q, 0), high) + dot(np.minimum(q, 0), low)


def shorter(x: np.ndarray) -> np.ndarray:
    """Numbers in a row as longs, what is beyond them at their ends."""
    return np.array([max(-MOST, min(MOST, int(v))) for v in x], np.int64) if x.dtype == object else x


def index_block(table: pa.Table) -> pa.Table:
    """A block's candidates to one row: its ids and forward index by id, and its maxima and minima."""
    table = table.sort_by("vec_id")
    m = matrix(table["v"])
    return pa.table({"block": table["block"][:1], "ids": [table["vec_id"].to_numpy().tobytes()], "m": [m.tobytes()], "high": [m.max(axis=0).tolist()], "low": [m.min(axis=0).tolist()]})


INDEX = "block long, ids binary, m binary, high array<long>, low array<long>"


def met(left: DataFrame, right: DataFrame, names: tuple[str, str], body, schema: str) -> DataFrame:
    """left and right cogrouped by names; right under new column references, as both may come from one table."""
    return left.groupBy(*names).cogroup(right.toDF(*right.columns).groupBy(*names)).applyInArrow(body, schema)


def wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def sides(queries: pa.Table, blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The queries' matrix, their bounds for blocks, their k-th scores so far, and which have none."""
    q, high, low = matrix(queries["v"]), matrix(blocks["high"]), matrix(blocks["low"])
    width = max(q.shape[1], high.shape[1])
    q, kth = wide(q, width), queries["kth"].combine_chunks()
    return q, bounds(q, wide(high, width), wide(low, width)), np.array(kth.fill_null(0), np.int64), np.array(kth.is_null())


def best_blocks(seeds: int):
    """A function for a group of queries and a chunk of bounds: each query's best blocks."""

    def best(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(queries) or not len(blocks):
            return pa.table({"g": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "bound": pa.array([], pa.int64())})
        blocks = blocks.sort_by("block")
        _, bound, _, _ = sides(queries, blocks)
        top = np.argsort(-bound, axis=1, kind="stable")[:, :seeds]
        names = blocks["block"].to_numpy()
        n = top.shape[1]
        return pa.table({"g": np.repeat(queries["g"].to_numpy(), n), "query_id": np.repeat(queries["query_id"].to_numpy(), n), "block": names[top].ravel(), "bound": shorter(np.take_along_axis(bound, top, 1).ravel())})

    return best


def surviving(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """A group of queries and a chunk of bounds to the blocks that some query of the group has to see."""
    if not len(queries) or not len(blocks):
        return pa.table({"g": pa.array([], pa.int64()), "block": pa.array([], pa.int64())})
    _, bound, kth, fresh = sides(queries, blocks)
    see = (fresh[:, None] | (bound >= kth[:, None])).astype(bool).any(axis=0)
    names = blocks["block"].to_numpy()[see]
    return pa.table({"g": np.full(len(names), queries["g"][0].as_py()), "block": names})


def search_blocks(k: int):
    """A function for a group of queries and some blocks: each query's k best of the blocks."""

    def search(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(queries) or not len(blocks):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q, bound, kth, fresh = sides(queries, blocks)
        ids = [np.frombuffer(x, np.int64) for x in blocks["ids"].to_pylist()]
        m = [np.frombuffer(x, np.int64).reshape(len(i), -1) for x, i in zip(blocks["m"].to_pylist(), ids, strict=True)]
        qid = queries["query_id"].to_numpy()
        order = np.argsort(-bound, axis=1, kind="stable")
        who, score, name = (np.zeros(0, np.int64) for _ in range(3))  # the best so far, by query
        at, step = 0, 1
        while at < len(ids):  # each query's next blocks in its own order: 1, 2, 4, ...
            i, j = np.repeat(np.arange(len(q)), min(step, len(ids) - at)), order[:, at : at + step].ravel()
            live = (fresh[i] | (bound[i, j] >= kth[i])).astype(bool)
            if not live.any():
                break  # later blocks have lower bounds still
            i, j = i[live], j[live]
            found = [(who, score, name)]
            for b in np.unique(j):
                own = i[j == b]
                s = shorter(dot(q[own], m[b]).ravel()).reshape(len(own), -1)
                x, y = np.nonzero((qid[own][:, None] != ids[b]) & (fresh[own][:, None] | (s >= kth[own][:, None])))
                found.append((own[x], s[x, y], ids[b][y]))
            who, score, name = (np.concatenate(c) for c in zip(*found, strict=True))
            top = np.lexsort((name, -score, who))
            place = np.arange(len(top)) - np.searchsorted(who[top], who[top])
            top, place = top[place < k], place[place < k]
            who, score, name = who[top], score[top], name[top]
            kth[who[place == k - 1]], fresh[who[place == k - 1]] = score[place == k - 1], False
            at, step = at + step, 2 * step
        return pa.table({"query_id": qid[who], "vec_id": name, "score": score})

    return search


class Search:
    """The steps of a search; survivors() shows what pruning leaves."""

    def __init__(self, vectors: DataFrame, is_query: Column, vec_id: str, embedding: str, k: int, scale: int, block: int):
        self.k = k
        rows = stored(quantised(vectors, vec_id, embedding, scale))
        ordered = placed(rows.withColumns({"one": F.lit(0), "h": F.xxhash64("v")}), "one", ["vec_id", "h"])
        named = ordered.select(F.floor(F.col("i") / block).cast("long").alias("block"), "vec_id", "v")
        self.index = stored(named.groupBy("block").applyInArrow(index_block, INDEX))
        self.blocks, n = self.index.count(), rows.filter(is_query).select("vec_id").distinct().count()
        self.groups = max(1, -(-n // GROUP))
        group = F.pmod(F.xxhash64("query_id"), F.lit(self.groups)).cast("long")
        own = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
        self.queries = stored(own.select(group.alias("g"), "query_id", "v", F.lit(None).cast("long").alias("kth")))

    def against_bounds(self, queries: DataFrame, body, schema: str) -> DataFrame:
        """Each group of queries beside each chunk of bounds: two rows of numbers for each block of vectors."""
        chunks = max(1, -(-self.blocks // CHUNK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
        left = queries.withColumn("c", every(chunks))
        right = self.index.select("block", "high", "low", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("long").alias("c")).withColumn("g", every(self.groups))
        return met(left, right, ("g", "c"), body, schema)

    def seeded(self) -> DataFrame:
        """The queries with their k-th scores in the best blocks (null if there are fewer)."""
        best = self.against_bounds(self.queries, best_blocks(SEEDS), "g long, query_id long, block long, bound long")
        by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = cut(best.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= SEEDS).select("g", "query_id", "block"))
        left = first.join(self.queries.drop("g"), "query_id")
        right = self.index.join(first.select("g", "block").distinct(), "block")
        found = met(left, right, ("g", "block"), search_blocks(self.k), OUT)
        kth = found.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(self.k - 1)).alias("kth"))
        return cut(self.queries.drop("kth").join(kth, "query_id", "left").select("g", "query_id", "v", "kth"))

    def survivors(self, queries: DataFrame) -> DataFrame:
        """The pairs of group g and block that have to meet."""
        return cut(self.against_bounds(queries, surviving, "g long, block long"))

    def found(self) -> DataFrame:
        queries = self.seeded()
        left = self.survivors(queries)
        ranges = max(1, -(-self.blocks // RANGE))
        part = F.pmod(F.xxhash64("block"), F.lit(ranges)).cast("long")
        pairs = left.withColumn("r", part)
        right = self.index.join(pairs, "block")
        own = queries.join(pairs.select("g", "r").distinct(), "g")
        return met(own, right, ("g", "r"), search_blocks(self.k), OUT)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query; is_query: over vec_id.

    The queries are a stated set: a task holds GROUP of them and RANGE blocks, whatever the table's size."""
    found = Search(vectors, is_query, vec_id, embedding, k, scale, block).found()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
