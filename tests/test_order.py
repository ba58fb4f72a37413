"""Stored orders and pages, one-call indexing."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.plans import indexing
from graphloom.sources import index, order


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    rows = [(None, 1), (None, 2)] + [(f"k{i // 3:04}", i) for i in range(998)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long").repartition(3)
    return order.arrange(df, ["k", "i"], f"file://{tmp_path_factory.mktemp('order')}/t", 100), sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


@pytest.mark.parametrize("size", [1, 7, 250])
def test_pages(ordered, size):
    """Every page by the last key of the one before it; each reads the files it lies in."""
    table, want = ordered
    after, at = None, 0
    while at < (len(want) if size == 250 else 3 * size):
        got = [tuple(r) for r in table.page(after, size).collect()]
        assert got == want[at : at + size] and len(table.page_files(after, size)) <= size // 100 + 3
        after, at = got[-1], at + size
    assert table.page(want[-1], size).count() == 0
    assert table.files.count() >= 10 and table.files.agg(F.sum("rows")).first()[0] == len(want)


def test_places(ordered):
    table, want = ordered
    for at, size in ((0, 3), (95, 10), (990, 20), (2000, 5)):
        assert [tuple(r) for r in table.page_at(at, size).collect()] == want[at : at + size]
    assert [tuple(r)[:2] for r in table.numbered().orderBy("seq").collect()] == want
    assert [r.seq for r in table.numbered().orderBy("seq").collect()] == list(range(len(want)))


def test_empty_order(spark, tmp_path):
    table = order.arrange(spark.createDataFrame([], "k string"), ["k"], f"file://{tmp_path}/t")
    assert table.page(None, 5).count() == table.page(("a",), 5).count() == table.page_at(0, 5).count() == table.numbered().count() == 0


def told(content):
    words = F.split(content, " ")
    node = lambda i: F.struct(F.get(words, i).alias("id"), F.lit("word").alias("entity_type"), F.lit("").alias("entity_role"))
    rel = F.struct(F.get(words, 0).alias("source"), F.get(words, 1).alias("target"), F.lit("before").alias("relationship_type"))
    return F.to_json(F.struct(F.array(node(0), node(1)).alias("nodes"), F.array(rel).alias("relationships")))


def test_keyword_to_graph(spark):
    """One call from a keyword to a graph and a collection; the counts are those of the lazy form."""
    docs = spark.createDataFrame([(5, "# Head\nred fox runs\n# Next\nblue sea"), (6, "no word"), (7, "Red rose"), (8, None), (9, "red fox again"), (10, "red late")], "doc_id long, text string")
    empty = spark.createDataFrame([], "id string, entity_type string, entity_role string, labels array<string>"), spark.createDataFrame([], "source string, target string, rel_type string")
    name = f"keyword_{uuid.uuid4().hex}"
    made, counts = indexing.index_keyword(docs, "RED", told, *empty, most=3, collection=name)
    assert {tuple(r) for r in made.edges.collect()} == {("red", "fox", "BEFORE"), ("blue", "sea", "BEFORE"), ("Red", "rose", "BEFORE")}
    assert counts == {"n_nodes": 6, "n_relationships": 3, "n_entities": 6, "n_edges": 3, "n_points": 4} == made.counts().first().asDict()
    assert index.info(spark, name)["points_count"] == 4
    _, again = indexing.index_keyword(docs, "red", told, made.entities, made.edges, most=3, collection=name)
    assert again == counts  # the same points, nodes and edges once more
    _, cleared = indexing.index_keyword(docs, "sea", told, made.entities, made.edges, clear=True)
    assert cleared == {"n_nodes": 4, "n_relationships": 2, "n_entities": 4, "n_edges": 2, "n_points": 2}
    assert indexing.index_keyword(docs, None, told, *empty) is None
    assert indexing.index_keyword(docs, "nowhere", told, *empty)[1] == dict.fromkeys(counts, 0)
    index.drop(spark, name)
