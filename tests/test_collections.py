"""Points put into collections: what is exchanged for that, and which rows are left."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.operators import vector
from graphloom.sources import index

POINTS = f"{index.POINT}, seq long"


def sent(spark):
    """Bytes that all stages so far have written for exchanges."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def name(spark):
    found = f"chunks_{uuid.uuid4().hex}"
    index.create(spark, found, 4)
    yield found
    index.drop(spark, found)


def test_ids_alone_are_exchanged(spark, name, tmp_path):
    """points filled in, filled in again and filled in anew by a part: no text, no vector goes through an exchange."""
    text = random.Random(1).randbytes(1 << 20).hex()  # no codec makes it much smaller
    rows = [(str(i), [1.0 * i] * 4, {"x": 1.0}, text[i * 2000 : i * 2000 + 2000], "1", "p", i) for i in range(1000)]
    spark.createDataFrame(rows, POINTS).repartition(3).write.parquet(f"{tmp_path}/points")
    made = spark.read.parquet(f"{tmp_path}/points")
    before = sent(spark)
    assert [index.put(spark, name, made.filter(f"seq < {n}"), "seq") for n in (1000, 1000, 300)] == [1000, 1000, 300]
    assert 0 < sent(spark) - before < 200_000  # the texts have two million characters
    assert {r.id: r.content for r in spark.table(name).select("id", "content").collect()} == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("most", [0, 2, 1 << 18])
@pytest.mark.parametrize("new", [[], ["e"], ["a"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "a", "e", "e", "e"], ["a", "b", "c", "c", "f"], [None], [None, None, "a"], ["a", "b", "c", "d", None, "d"]])
def test_put_is_the_upsert(spark, name, new, most, monkeypatch):
    """whichever way rows meet ids, and with ids that are none, what is left is what vector.upsert() leaves."""
    monkeypatch.setattr(index, "SENT", most)
    row = lambda id_, i: (id_, [float(i)] * 4, {"x": float(i), "a": 1.0}, f"{id_} {i}", "1", "p", -i)
    old = spark.createDataFrame([row(x, i) for i, x in enumerate(["a", "b", "c", "d", None])], POINTS)
    now = spark.createDataFrame([row(x, 10 + i) for i, x in enumerate(new)], POINTS)
    flat = lambda df: df.withColumn("sparse", F.array_sort(F.map_entries("sparse")))
    want = vector.upsert(flat(old).drop("seq"), flat(now), "id", "seq")
    index.put(spark, name, old, "seq")
    assert index.put(spark, name, now, "seq") == len(new)
    assert sorted(map(repr, flat(spark.table(name)).collect())) == sorted(map(repr, want.collect()))


def test_repeats_without_an_order(spark, name):
    """without seq the greatest of an id's points by their other columns stays; a loser's vector is checked, too."""
    row = lambda id_, x, c: (id_, [x] * 4, {}, c, "1", "p")
    index.put(spark, name, spark.createDataFrame([row("a", 1.0, "z"), row("a", 2.0, "a"), row("a", 2.0, "b"), row("b", 0.0, "c")], index.POINT))
    assert sorted((r.id, r.content) for r in spark.table(name).collect()) == [("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        index.put(spark, name, spark.createDataFrame([row("a", 1.0, "z"), row("a", float("nan"), "a")], index.POINT))
    assert index.info(spark, name)["points_count"] == 2


def test_collections_are_packed(spark, name):
    """a collection's files are of the smaller codec, which its replacement by put() keeps."""
    index.put(spark, name, spark.createDataFrame([("a", [1.0] * 4, {}, "t", "1", "p")], index.POINT))
    files = spark.table(name).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
