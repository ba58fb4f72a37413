"""The query pipeline: chunk retrieval, graph retrieval, and answers from both."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import encode
from graphloom.operators import extraction, graph, many, rank, vector
from graphloom.plans import context
from graphloom.sources.hybrid import HybridIndex
from graphloom.sources.shared import stored

#: A function of query, graph context and chunk context (columns) to the answer; the place of a hosted model.
Generator = Callable[[Column, Column, Column], Column]
NO_ANSWER = "No answer generated."


def results(points: DataFrame, found: DataFrame) -> DataFrame:
    """Scored ids (doc_id, score) as rows of a search: chunk_id, chunk_text, score and metadata, a map of the payload."""
    kept = points.join(F.broadcast(found.withColumnRenamed("doc_id", "id")), "id")  # a top-k
    payload = F.create_map(*[x for c in ("chunk_id", "content", "doc_id", "chunk_type") for x in (F.lit(c), F.col("id" if c == "chunk_id" else c))])
    return kept.select(F.col("id").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("chunk_text"), "score", payload.alias("metadata"))


def vector_of(points: DataFrame, query: str, dense=None) -> list[float]:
    return points.sparkSession.range(1).select((dense or encode.hashed())(F.lit(query)).alias("v")).first().v


def dense_list(points: DataFrame, query: str, k: int, threshold: float = 0.0, where: dict | None = None, dense=None) -> DataFrame:
    v = vector_of(points, query, dense)
    if not v:
        return points.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score")).filter("false")
    return vector.search(points, v, k, threshold=threshold, where=where, vector="dense", key="id").select(F.col("id").alias("doc_id"), "score")


def sparse_list(points: DataFrame, query: str, k: int, where: dict | None = None) -> DataFrame:
    """The k points of the largest dot product with the query's weights, which are a literal; points that share no term
    are not among them."""
    weights = points.sparkSession.range(1).select(encode.sparse(F.lit(query)).alias("w")).first().w
    score = F.lit(0.0)
    for term, weight in sorted(weights.items()):
        score += F.coalesce(F.try_element_at("sparse", F.lit(term)), F.lit(0.0)) * weight
    for c, v in (where or {}).items():
        points = points.filter(F.col(c) == v)
    return rank.best(points.select(F.col("id").alias("doc_id"), score.alias("score")), k).filter("score > 0")


def hybrid_list(points: DataFrame, query: str, k: int, threshold: float = 0.0, where: dict | None = None, dense=None) -> DataFrame:
    """Dense and sparse search, 2k of each, fused by reciprocal ranks; the threshold holds for the fused score."""
    fused = rank.rrf([dense_list(points, query, 2 * k, where=where, dense=dense), sparse_list(points, query, 2 * k, where)], k)
    return fused.filter(F.col("score") >= threshold) if threshold > 0 else fused


def hybrid_search(points: DataFrame, query: str, k: int = 5, threshold: float = 0.0, where: dict | None = None, dense=None) -> DataFrame:
    return results(points, hybrid_list(points, query, k, threshold, where, dense))


def semantic_search(points: DataFrame, query: str, k: int = 5, threshold: float = 0.0, where: dict | None = None, dense=None) -> DataFrame:
    return results(points, dense_list(points, query, k, threshold, where, dense))


def search(points: DataFrame, query: str, k: int = 5, threshold: float = 0.0, search_type: str = "hybrid", dense=None) -> DataFrame:
    """The chunks with their total and search_type on each row."""
    found = (hybrid_search if search_type == "hybrid" else semantic_search)(points, query, k, threshold, dense=dense)
    return found.withColumns({"total": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))), "search_type": F.lit(search_type)})  # a top-k


def search_many(index: HybridIndex, queries: DataFrame, k: int = 5, threshold: float = 0.0, search_type: str = "hybrid", dense=None, where: dict | None = None) -> DataFrame:
    """search() for a table of queries (query_id, query) in one pass over a stored index: query_id, rank, chunk_id, chunk_text,
    score, metadata, total (of the query's chunks) and search_type. Of the postings only the queries' terms are read, of these
    and of the cells only those whose bounds reach the query's best."""
    asked = stored(queries.select("query_id", "query", (dense or encode.hashed())(F.col("query")).alias("vector")), "queries")
    hybrid = search_type == "hybrid"
    condition = reduce(lambda a, x: a & (F.col(x[0]) == x[1]), (where or {}).items(), F.lit(True))
    near = many.best_vectors(index.vectors, index.cells, asked, 2 * k if hybrid else k, index.state["metric"], column="dense", key="id", where=condition if where else None).rows
    if hybrid:
        within = index.points.filter(condition).select(F.col("id").alias("doc_id")) if where else None
        same = many.sparse(index.postings, asked, 2 * k, within=within).rows
        near = many.fused([near, same], k, index.state["constant"], weights=index.state["weights"])
    found = near.filter(F.col("score") >= threshold) if threshold > 0 else near
    met = index.points.join(found.withColumnRenamed("doc_id", "id"), "id")
    payload = F.create_map(*[x for c in ("chunk_id", "content", "doc_id", "chunk_type") for x in (F.lit(c), F.col("id" if c == "chunk_id" else c))])
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))  # k rows of a query
    return met.select("query_id", "rank", F.col("id").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("chunk_text"), "score", payload.alias("metadata"), total.alias("total"), F.lit(search_type).alias("search_type"))


def retrieve(entities: DataFrame, edges: DataFrame, points: DataFrame, query: str, targets: list[str], excluded: list[str] = [], graph_limit: int = 10, k: int = 5, threshold: float = 0.0, dense=None) -> dict[str, DataFrame]:  # noqa: B006
    """The triples around the targets and the chunks for the query."""
    return {"graph": graph.cascade(entities, edges, targets, excluded, graph_limit), "chunk": hybrid_search(points, query, k, threshold, dense=dense)}


def _answer(query: str, graph_context: DataFrame | str, chunks: DataFrame, generator: Generator | None, search_type: str) -> DataFrame:
    chunk = context.chunk_context(chunks.select(F.col("chunk_id").alias("doc_id"), "score", F.col("chunk_text").alias("text"))).select(F.col("context").alias("chunk_context"))
    both = chunk.withColumn("graph_context", F.lit(graph_context)) if isinstance(graph_context, str) else chunk.join(graph_context.select(F.col("context").alias("graph_context")))  # one row each
    answer = generator(F.lit(query), F.col("graph_context"), F.col("chunk_context")) if generator else F.lit(NO_ANSWER)
    return both.select(F.coalesce(answer, F.lit(NO_ANSWER)).alias("answer"), "graph_context", "chunk_context", F.lit(search_type).alias("search_type"))


def respond(entities: DataFrame, edges: DataFrame, points: DataFrame, query: str, analysis: str | None = None, k: int = 5, threshold: float = 0.0, graph_limit: int = 10, generator: Generator | None = None, dense=None) -> DataFrame:
    """The whole pipeline: the query's analysis (JSON, as a model gives it; without, the query alone is searched), graph and
    hybrid chunk retrieval, contexts and the answer, in one row."""
    told = entities.sparkSession.range(1).select(extraction.analysis(F.lit(analysis), F.lit(query)).alias("a")).first().a
    found = retrieve(entities, edges, points, told.normalized_query, list(told.target_entities), list(told.excluded_entities), graph_limit, k, threshold, dense)
    return _answer(query, context.graph_context(found["graph"]), found["chunk"], generator, "full")


def respond_semantic(points: DataFrame, query: str, k: int = 5, threshold: float = 0.0, generator: Generator | None = None, dense=None) -> DataFrame:
    """An answer from dense search alone, without analysis and graph."""
    return _answer(query, "No graph context (Semantic Search mode).", semantic_search(points, query, k, threshold, dense=dense), generator, "semantic")


def respond_hybrid(points: DataFrame, query: str, k: int = 5, threshold: float = 0.0, generator: Generator | None = None, dense=None) -> DataFrame:
    return _answer(query, "No graph context (Hybrid Search mode).", hybrid_search(points, query, k, threshold, dense=dense), generator, "hybrid")
