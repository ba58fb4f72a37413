"""The index pipeline: chunks and what was extracted from them, to entities, edges and points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import encode
from graphloom.functions.text import clean_name
from graphloom.operators import chunker, extraction, graph
from graphloom.sources import index as indexes
from graphloom.sources import star
from graphloom.sources.order import arrange
from graphloom.sources.shared import fresh, stored

BATCH = 5
#: Words of a chunk, from which on it is oversized.
CHUNK = 2048


@dataclass
class Indexed:
    """nodes and relationships: what was extracted, cleaned and without repeats within a batch; entities and edges: the
    graph after them; points: the chunks as points of a collection."""

    nodes: DataFrame
    relationships: DataFrame
    entities: DataFrame
    edges: DataFrame
    points: DataFrame

    def counts(self) -> DataFrame:
        """One row: rows that matched an entity or edge (repeats included), and what there is now."""
        parts = {
            "n_nodes": graph.valid_nodes(self.nodes),
            "n_relationships": graph.between(graph.valid_edges(self.relationships), self.entities),
            "n_entities": self.entities, "n_edges": self.edges, "n_points": self.points,
        }
        every = None
        for name, df in parts.items():
            one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
            every = one if every is None else every.unionByName(one)
        return every.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in parts])


def points_of(chunks: DataFrame, dense=None) -> DataFrame:
    """Chunks as points: chunk_id (or a hash of the document and the place, where there is none), vectors and payload;
    those without text or without a vector are left out."""
    filled = chunks.filter(F.col("content").rlike(r"(?U)\S"))
    id_ = F.coalesce(F.col("chunk_id").cast("string"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("seq").cast("string")), 256))
    # vectors that are none are left out as they are exploded: a filter would move below and encode every text once more
    some = F.explode(F.filter(F.array((dense or encode.hashed())(F.col("content"))), lambda v: F.size(v) > 0))
    made = filled.select("*", some.alias("_dense"))
    return made.select(id_.alias("id"), F.col("_dense").alias("dense"), encode.sparse(F.col("content")).alias("sparse"), "content", F.col("doc_id").cast("string").alias("doc_id"), "chunk_type", "seq")


def index(chunks: DataFrame, entities: DataFrame, edges: DataFrame, batch: int = BATCH, clear: bool = False, dense=None) -> Indexed:
    """chunks: seq (their order over all documents), chunk_id, doc_id, chunk_type, content, payload. clear: from an empty
    graph. Repeats are dropped within batches of successive chunks, across batches by the upsert alone; a batch is given by
    seq, so a chunk that is skipped never holds back or loses the others of its batch."""
    if clear:
        entities, edges = entities.limit(0), edges.limit(0)
    found = extraction.usable(chunks)
    with_batch = lambda df: df.withColumn("batch", F.floor(F.col("chunk_seq") / batch)).drop("chunk_seq")
    nodes = graph.dedup_entities(with_batch(graph.clean_entities(extraction.nodes(found))), within=["batch"])
    cleaned = extraction.relationships(found).withColumns({c: clean_name(F.col(c)) for c in ("source", "target", "rel_type")})
    rels = graph.dedup_edges(with_batch(cleaned), within=["batch"])
    after = graph.upsert_nodes(entities, nodes)
    return Indexed(nodes, rels, after, graph.upsert_edges(edges, rels, after), points_of(found, dense))


def index_once(chunks: DataFrame, entities: DataFrame, edges: DataFrame, batch: int = BATCH, clear: bool = False, dense=None, collection: str | None = None) -> tuple[Indexed, dict[str, int]]:
    """index(), with every part written once and what comes after read from there, and its counts, as Indexed.counts() has
    them: rows of tables that have been written, which Parquet's footers tell. (Counts observed while writing would count
    again what a lost executor makes Spark do again.) collection: put the points there; n_points is then what it holds."""
    if clear:
        entities, edges = entities.limit(0), edges.limit(0)
    made = index(stored(chunks, "chunks"), entities, edges, batch, dense=dense)
    nodes, rels = stored(made.nodes, "nodes"), stored(made.relationships, "relationships")
    valid = stored(graph.valid_nodes(nodes).select("batch"), "valid")
    after = stored(graph.upsert_nodes(entities, nodes), "entities")
    taken = stored(graph.between(graph.valid_edges(rels), after), "taken")
    after_edges = stored(edges.select("source", "target", "rel_type").union(taken).distinct(), "edges")
    points = stored(made.points, "points")
    counts = {k: df.count() for k, df in {"n_nodes": valid, "n_relationships": taken, "n_entities": after, "n_edges": after_edges, "n_points": points}.items()}
    if collection:
        spark = chunks.sparkSession
        sized = points.select(F.size("dense").alias("n")).first()
        if sized:
            indexes.ensure(spark, collection, sized.n)
            indexes.put(spark, collection, points, "seq")
        counts["n_points"] = (indexes.info(spark, collection) or {"points_count": 0})["points_count"]
    return Indexed(nodes, rels, after, after_edges, points), counts


def chunked(documents: DataFrame, size: int = CHUNK, doc_id: str = "id", content: str = "content") -> DataFrame:
    """The chunks of documents that have text, in one order over all documents: seq, chunk_id (null: none is given), doc_id,
    chunk_type and content."""
    found = chunker.chunks(documents, doc_id, content, size).filter(F.col("content").isNotNull()).select("doc_id", "chunk", "chunk_type", "content")
    ordered = arrange(found, ["doc_id", "chunk"], fresh(documents.sparkSession, "chunks"))
    return ordered.numbered("seq").select("seq", F.lit(None).cast("long").alias("chunk_id"), "doc_id", "chunk_type", "content")


def index_keyword(docs: DataFrame, keyword: str | None, extractor: Callable[[Column], Column], entities: DataFrame, edges: DataFrame, most: int = 10, size: int = CHUNK, clear: bool = False, dense=None, collection: str | None = None) -> tuple[Indexed, dict[str, int]] | None:
    """From a keyword to an indexed graph in one call: the first `most` documents that hold it, their chunks, what the extractor
    (a function of the text to a payload, the place of a hosted model) finds in each, and index_once() of all; None without a keyword."""
    found = star.keyword_documents(docs, keyword, most)
    if found is None:
        return None
    chunks = chunked(found, size)
    return index_once(chunks.withColumn("payload", extractor(F.col("content"))), entities, edges, clear=clear, dense=dense, collection=collection)
