import pytest

from graphloom.operators import graph
from graphloom.streaming.edges import edge_stream

NODE = "id string, entity_type string, note string"
EDGE = "source string, target string, rel_type string, Source_ string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store a partition: a start of two each is soon done."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


class Streams:
    """Folders of nodes and edges, which grow, and the stream over them."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        for name, schema in (("nodes", NODE), ("edges", EDGE)):
            spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}/part={self.n}")

    def add(self, name, rows):
        self.n += 1
        schema = NODE if name == "nodes" else EDGE
        self.spark.createDataFrame(rows, schema).write.parquet(f"{self.path}/{name}/part={self.n}")

    def run(self, splits=3, at_once=10_000):
        read = lambda name, schema: self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        query = edge_stream(read("nodes", NODE), read("edges", EDGE), f"{self.path}/table", f"{self.path}/state", splits, at_once)
        assert query.awaitTermination(120)
        return self.rows()

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.schema("source string, target string, rel_type string").parquet(f"{self.path}/table").collect())


def test_edges_wait_for_their_ends(spark, tmp_path):
    s = Streams(spark, tmp_path)
    s.add("edges", [("a", "b", "likes", "x"), ("a", "c", "likes", "x"), (" a ", "b", "likes", None), ("a", "a", "is", None), (None, "b", "likes", None), ("a", "b", "-", None)])
    s.add("nodes", [("a", "person", None), (None, "person", None), ("c", None, None)])
    assert s.run() == []  # b is unknown, and c has no type
    s.add("nodes", [(" b ", "person", None)])
    assert s.run() == [("a", "b", "LIKES")]
    s.add("edges", [("a", "b", "likes", "again"), ("b", "a", "likes", None), ("a", "b", "knows", None)])  # known ends: at once
    s.add("nodes", [("a", "person", "again"), ("b", "person", "again")])
    assert s.run() == [("a", "b", "KNOWS"), ("a", "b", "LIKES"), ("b", "a", "LIKES")]
    s.add("nodes", [("c", "person", None)])
    every = s.run()
    assert every == [("a", "b", "KNOWS"), ("a", "b", "LIKES"), ("a", "c", "LIKES"), ("b", "a", "LIKES")]

    # the last batch is run again, as after a driver that was lost before it could say that it was done
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert s.run() == every


def test_a_hub_and_any_order(spark, tmp_path):
    """A hub's edges wait, more than leave the state at once; the result is upsert_edges() of all that came."""
    edges = [("hub", f"n{i}", "to", None) for i in range(600)] + [(f"n{i}", "hub", "of", None) for i in range(30)]
    nodes = [(f"n{i}", "leaf", None) for i in range(0, 600, 2)]
    s = Streams(spark, tmp_path)
    s.add("edges", edges)
    s.add("nodes", nodes)
    assert s.run(1, 50) == []
    s.add("nodes", [("hub", "hub", None)])
    found = s.run(1, 50)
    entities = spark.createDataFrame([("hub",), *[(n,) for n, _, _ in nodes]], "id string")
    empty = spark.createDataFrame([], "source string, target string, rel_type string")
    assert found == sorted(tuple(r) for r in graph.upsert_edges(empty, spark.createDataFrame(edges, EDGE), entities).collect())
    assert len(found) == 300 + 15


def test_nothing_comes(spark, tmp_path):
    s = Streams(spark, tmp_path)
    assert s.run() == []
