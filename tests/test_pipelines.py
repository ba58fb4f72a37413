"""Ranking, indexes, collections and both pipelines beyond what the queries show."""

import math
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.functions import encode
from graphloom.operators import extraction, graph, many, rank, vector
from graphloom.plans import indexing, retrieval
from graphloom.sources import index


def test_fusion_of_long_lists(spark):
    """Neighbouring ranks differ by less than six digits show, and are still told apart."""
    rows = [(i, float(i)) for i in range(1, 2001)]
    a = spark.createDataFrame(rows, "doc_id long, score double")
    assert [r.doc_id for r in rank.adaptive_rrf(a, a, 10).collect()] == list(range(2000, 1990, -1))
    assert [r.doc_id for r in rank.rrf([a, a], 10).collect()] == list(range(2000, 1990, -1))
    assert rank.adaptive_rrf(a, a, 10, least=1.0).count() == 0
    none = a.filter("false")
    e = [math.exp(math.log1p(x) - math.log1p(3)) for x in (3, 2, 1)]
    got = rank.adaptive_rrf(a.filter("score <= 3"), none, 3, strategy="log").collect()
    assert [r.score for r in got] == pytest.approx([x / sum(e) for x in e], abs=1e-6)
    assert rank.adaptive_rrf(none, none).count() == 0


def test_bm25_reads_texts_once_per_pass(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in rank.bm25(docs, "red", 5).collect()] == [2, 1]
    plan = rank.bm25(docs, "red fox dog", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue sea")], "doc_id long, text string")
    path = f"file://{tmp_path}/lexical"
    assert index.load_lexical(spark, path) is None and index.load_vectors(spark, path) is None
    index.save_lexical(docs, path)
    found = rank.bm25_stored(index.load_lexical(spark, path), "red sea none", 5)
    assert found.collect() == rank.bm25(docs, "red sea none", 5).collect()
    assert re.search(r"PartitionFilters: \[[^\]]*slot", found._jdf.queryExecution().executedPlan().toString())
    assert rank.bm25_stored(index.load_lexical(spark, path), "", 5).count() == 0


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, x string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "vec_id long, x string, seq long")
    assert sorted(map(tuple, vector.upsert(old, new, seq="seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_collection(spark):
    name = "chunks_of_a_test"
    index.drop(spark, name)
    assert not index.exists(spark, name) and index.info(spark, name) is None and index.drop(spark, name) is False
    index.create(spark, name, 4, "manhattan")
    made = spark.createDataFrame([("a", [1.0] * 4, {"x": 1.0}, "t", "1", "p", 1), ("a", [2.0] * 4, {"y": 1.0}, "u", "1", "p", 2), ("b", [0.5] * 4, {}, "v", "2", "p", 3)], f"{index.POINT}, seq long")
    assert index.put(spark, name, made, "seq") == 3
    told = index.info(spark, name)
    assert (told["points_count"], told["dimension"], told["metric"]) == (2, 4, "cosine")
    assert {r.id: r.content for r in spark.table(name).collect()} == {"a": "u", "b": "v"}
    index.clear(spark, name)
    assert index.info(spark, name)["points_count"] == 0 and index.drop(spark, name)


def test_extraction(spark):
    """Malformed answers and ones without a list are skipped with their chunk; missing fields are empty."""
    rows = [(1, "x", '{"nodes": [{"id": "A"}], "relationships": []}'), (2, "x", '{"nodes": ['), (3, "x", '{"nodes": []}'), (4, "  ", '{"nodes": [], "relationships": []}'), (5, "x", None), (6, "x", "[]")]
    found = extraction.usable(spark.createDataFrame(rows, "seq long, content string, payload string"))
    assert [r.seq for r in found.collect()] == [1]
    assert [tuple(r)[2:] for r in extraction.nodes(found).collect()] == [("A", "", "")]
    told = lambda answer: spark.range(1).select(extraction.analysis(F.lit(answer), F.lit("q")).alias("a")).first().a
    assert tuple(told('{"target_entities": ["a"]}')) == (["a"], [], "q") and tuple(told("no json")) == ([], [], "q") and tuple(told(None)) == ([], [], "q")
    assert spark.range(1).select(extraction.rendered("{{ a }}-{{b}}", {"a": "x", "b": F.lit("y")})).first()[0] == "x-y"


def test_fuzzy_by_token_index(spark, tmp_path):
    e = spark.createDataFrame([("Anna Berg", "p", "x", ["Entity"]), ("Ana", "p", None, ["Entity"]), ("Bob", "p", "x", ["Entity"])], "id string, entity_type string, entity_role string, labels array<string>")
    r = spark.createDataFrame([("Anna Berg", "Bob", "KNOWS"), ("Ana", "Bob", "KNOWS")], "source string, target string, rel_type string")
    path = f"file://{tmp_path}/tokens"
    assert index.load_tokens(spark, path) is None
    index.save_tokens(e, path)
    tokens = index.load_tokens(spark, path)
    for names in (["anna"], ["nana"], ["anna brg"], ["zz"], ["naa", "bbo", "ana"], ["", "an"]):
        assert graph.fuzzy(e, r, names, tokens=tokens).collect() == graph.fuzzy(e, r, names).collect()
    assert graph.near_tokens(tokens, ["", " "]).count() == 0


@pytest.mark.parametrize("literals", [0, 1000])
def test_near_tokens_against_every_token(spark, monkeypatch, literals):
    """All words of one to four letters of an alphabet of three: what the keys find is what comparing every token finds."""
    monkeypatch.setattr(graph, "LITERALS", literals)
    words = ["".join(w) for n in range(1, 5) for w in product("abc", repeat=n)]
    e = spark.createDataFrame([(w,) for w in words], "id string")
    postings = graph.token_index(e)
    for name in ("a", "ab", "acb", "abca", "cc bab"):
        want = {(r.id, r.s) for r in e.select("id", graph.fuzzy_score(F.col("id"), name).alias("s")).filter("s > 0").collect()}
        got = graph.near_tokens({"postings": postings, "keys": graph.deletion_keys(postings)}, [name])
        assert {(r.id, r.score) for r in got.filter("score > 0").collect()} == want


def rows_read(df):
    """Rows that the scans of an executed plan have given."""

    def walk(node):
        name = node.nodeName()
        own = node.metrics().apply("numOutputRows").value() if name.startswith("Scan") else 0
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        return own + sum(map(walk, inner + [children.apply(i) for i in range(children.length())]))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_token_index_skips(spark, tmp_path):
    """Of a million ids a search for one edit reads below a hundredth of the keys and of the postings."""
    n, path = 1_000_000, f"file://{tmp_path}/many"
    e = spark.range(n).select(F.concat(F.lit("id "), F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("id"))
    index.save_tokens(e, path)
    tokens = index.load_tokens(spark, path)
    name = spark.range(n).filter("id = 77").select(F.substring(F.md5(F.col("id").cast("string")), 1, 9)).first()[0]
    typo = name[:3] + name[4:]
    keys = tokens["keys"].filter(graph.among("key", graph.keys_of(typo)))
    assert keys.count() and rows_read(keys) < tokens["keys"].count() / 100
    found = graph.near_tokens(tokens, [typo])
    assert any(r.id == f"id {name}" and r.score == 1 - 1 / 8 for r in found.collect())
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString()
    assert rows_read(found) < tokens["postings"].count() / 100


def test_index_then_ask(spark):
    """Chunks of two documents to a graph and points, and answers from them by a generator given as a function."""
    rows = [
        (0, None, 1, "paragraph", "anna lives in bergen", '{"nodes": [{"id": "1. Anna", "entity_type": "Person"}, {"id": "Bergen", "entity_type": "City"}], "relationships": [{"source": "Anna", "target": "Bergen", "relationship_type": "lives in"}]}'),
        (1, None, 1, "paragraph", "nothing was extracted here", "broken"),
        (2, 77, 2, "paragraph", "bob visits anna", '{"nodes": [{"id": "Bob", "entity_type": "Person"}, {"id": "Anna", "entity_type": "Guest"}], "relationships": [{"source": "Bob", "target": "Anna", "relationship_type": "visits"}]}'),
    ]
    chunks = spark.createDataFrame(rows, "seq long, chunk_id long, doc_id long, chunk_type string, content string, payload string")
    empty = spark.createDataFrame([], "id string, entity_type string, entity_role string, labels array<string>"), spark.createDataFrame([], "source string, target string, rel_type string")
    made = indexing.index(chunks, *empty)
    assert {(r.id, r.entity_type, tuple(r.labels)) for r in made.entities.collect()} == {("Anna", "Guest", ("Entity", "GUEST", "PERSON")), ("Bergen", "City", ("Entity", "CITY")), ("Bob", "Person", ("Entity", "PERSON"))}
    assert {tuple(r) for r in made.edges.collect()} == {("Anna", "Bergen", "LIVES_IN"), ("Bob", "Anna", "VISITS")}
    assert tuple(made.counts().first()) == (4, 2, 3, 2, 2) and {r.id for r in made.points.collect()} >= {"77"}
    say = lambda q, g, c: F.concat_ws(" | ", q, g, c)
    full = retrieval.respond(made.entities, made.edges, made.points, "who is anna?", '{"target_entities": ["anna"], "normalized_query": "anna"}', generator=say).first()
    assert full.answer.startswith("who is anna? | 1. Anna (Entity) --[LIVES_IN]--> Bergen (Entity)") and "[Chunk 2]" in full.chunk_context
    bare = retrieval.respond(made.entities, made.edges, made.points, "").first()
    assert tuple(bare) == (retrieval.NO_ANSWER, "No graph relationships found.", "No relevant document chunks found.", "full")
    only = retrieval.respond_semantic(made.points, "bergen", k=1).first()
    assert only.chunk_context == "[Chunk 1]\nanna lives in bergen" and only.search_type == "semantic"


def test_encoders(spark):
    docs = spark.createDataFrame([("Red red fox",), ("",), (None,), ("the the",)], "t string")
    v = [r[0] for r in docs.select(encode.hashed(16)(F.col("t"))).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == v[2] == [] and max(v[3]) == 1.0
    assert [r[0] for r in docs.select(encode.sparse(F.col("t"))).collect()] == [{"red": pytest.approx(1 + math.log(2)), "fox": 1.0}, {}, {}, {}]


def test_cascade_reads_edges_only_where_entities_meet(spark):
    """Neither a name nor a token near one is there: the edges are read by the substring search alone."""
    e = spark.createDataFrame([("alpha#1", "t", "r", ["Entity"]), ("beta#2", "t", "r", ["Entity"])], "id string, entity_type string, entity_role string, labels array<string>")
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            read.add(1)
            yield batch

    r = spark.createDataFrame([("alpha#1", "beta#2", "R")], "source string, target string, rel_type string").coalesce(1).mapInPandas(seen, "source string, target string, rel_type string")
    found = graph.cascade(e, r, ["lpha#"])
    assert read.value == 0 and [x.target_id for x in found.collect()] == ["beta#2"]


def test_upsert_joins_ids_alone(spark):
    """Old rows are told apart by the new rows' ids; no row is chosen twice for that."""
    old = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, t string")
    new = spark.createDataFrame([(2, "c", 1), (2, None, 2), (3, "e", 1), (3, "d", 1)], "vec_id long, t string, seq int")
    both = vector.upsert(old, new, seq="seq")
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, None), (3, "e")]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_encoding_in_steps(spark):
    """Texts are counted some at a time; the vectors do not depend on how many."""
    docs = spark.createDataFrame([("aa bb aa",), ("",), (None,), ("cc",), ("dd ee ff dd",)], "t string").coalesce(1)
    whole, steps = ([r[0] for r in docs.select(encode.hashed(16, **o)(F.col("t"))).collect()] for o in ({}, {"step": 2}))
    assert whole == steps and [len(v) for v in steps] == [16, 0, 0, 16, 16]


def test_texts_are_counted_once(spark):
    """Each encoder stands once in the plan of points and of postings: no filter repeats it below. (F1, F2, F15, F22)"""
    docs = spark.createDataFrame([(1, "red fox red"), (2, "the of"), (3, "  "), (4, None), (5, "?!")], "doc_id long, text string")
    chunks = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id"), "doc_id", F.lit("paragraph").alias("chunk_type"), F.col("text").alias("content"))
    plans = [(points := indexing.points_of(chunks)), (counts := many.term_counts(docs))]
    told = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert [t.count("EvalPython [counted") for t in told] == [1, 0] and [t.count("EvalPython [_counts") for t in told] == [1, 1]
    assert {r.id: r.sparse for r in points.collect()} == {"1": {"red": pytest.approx(1 + math.log(2)), "fox": 1.0}, "2": {}}
    assert sorted((r.doc_id, r.dl, r.term, r.tf) for r in counts.collect()) == [(1, 3, "fox", 1), (1, 3, "red", 2)]
