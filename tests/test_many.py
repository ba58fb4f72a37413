"""Many queries at once: equal to the scan for each query, and what is skipped is counted. The stored hybrid index."""

import math
import random
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.operators import many, rank, vector
from graphloom.plans import indexing, retrieval
from graphloom.sources import hybrid, index, snapshot

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def texts(spark):
    """Ids far apart, words that come in some ranges of documents only, empty and null texts."""
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        pool = WORDS[:10] + WORDS[10 + i // 50 * 6 : 16 + i // 50 * 6]
        rows.append((i * 1000003, " ".join(rnd.choices(pool, k=rnd.randrange(1, 40)))))
    return spark.createDataFrame([*rows, (-5, None), (-4, ""), (-3, "the of")], "doc_id long, text string")


@pytest.fixture(scope="module")
def lexical(spark, texts, tmp_path_factory):
    kept, many.BLOCK_BITS = many.BLOCK_BITS, 3
    path = f"file://{tmp_path_factory.mktemp('many')}/lexical"
    index.save_lexical(texts, path)
    many.BLOCK_BITS = kept
    return index.load_lexical(spark, path)


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seeds", [1, 8])
def test_bm25_many(spark, texts, lexical, seeds):
    rnd = random.Random(4)
    asked = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 6)))) for i in range(12)] + [(100, ""), (101, None), (102, "none of these"), (103, "W1 w1  W2")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = lists(many.bm25(lexical, queries, 7, seeds).rows.collect())
    for i, q in asked:
        want = [(k + 1, r.doc_id, r.score) for k, r in enumerate(rank.bm25(texts, q or "", 7).collect())]
        assert got.get(i, []) == want
        assert [(r.doc_id, r.score) for r in rank.bm25_stored(lexical, q or "", 7).collect()] == [x[1:] for x in want]


def test_scores_do_not_hang_on_the_order(spark):
    """copies whose score lies at the end of a step of the 12 digits, in many blocks, come by their ids."""
    rnd = random.Random(6)
    weights = [rnd.random() for _ in range(30)]
    edge = Fraction(round(sum(map(Fraction, weights)) * 10**12) + Fraction(1, 2), 10**12) + Fraction(1, 4)
    weights.append(float(edge - sum(map(Fraction, weights))))
    rows = [(f"t{j}", b, 1, w, [(b, w)]) for j, w in enumerate(weights) for b in range(64)]
    postings = spark.createDataFrame(rows, "term string, block long, n long, top double, entries array<struct<doc_id:long,weight:double>>")
    asked = spark.createDataFrame([(1, f"t{j}", 1.0) for j in range(len(weights))], "query_id int, term string, weight double")
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # a large index's terms meet in other tasks for each block
    kept = {k: spark.conf.get(k) for k in confs}
    try:
        [spark.conf.set(k, v) for k, v in confs.items()]
        found = sorted((r["rank"], r.doc_id) for r in many.best_postings(postings, asked, 64).rows.collect())
    finally:
        [spark.conf.set(k, v) for k, v in kept.items()]
    assert found == [(i + 1, i) for i in range(64)]


def test_total_is_exact(spark):
    rnd = random.Random(7)
    xs = [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-3, 4) for _ in range(500)]
    rows = [(k, x) for k in range(8) for x in rnd.sample(xs, len(xs))] + [(8, None), (9, float("inf")), (9, 1.0), (10, 2.5), (10, None)]
    got = dict(spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(rank.total(F.col("x"))).collect())
    assert {got[k] for k in range(8)} == {math.fsum(xs)} and got[8] is None and got[9] == math.inf and got[10] == 2.5


def test_blocks_are_skipped(spark, texts, lexical):
    """A word of one range of documents beside a common one: blocks of other ranges cannot reach the best."""
    queries = spark.createDataFrame([(1, "w0 w20 w21 w22 w23")], "query_id long, query string")
    found = many.bm25(lexical, queries, 3, seeds=2)
    blocks = lexical["postings"].filter("term = 'w0'").select("block").distinct().count()
    assert blocks >= 50 and found.first.count() + found.rest.count() < blocks / 3
    assert "PushedFilters: [" in (plan := many.of_terms(lexical["postings"], many.asked(queries))._jdf.queryExecution().executedPlan().toString()) and "term" in plan.split("PushedFilters")[1]


def test_terms_beyond_the_literals(spark, lexical, monkeypatch):
    queries = spark.createDataFrame([(1, "w0 w20 w21")], "query_id long, query string")
    want = many.bm25(lexical, queries, 5).rows.collect()
    monkeypatch.setattr(many, "LITERALS", 1)
    assert many.bm25(lexical, queries, 5).rows.collect() == want


@pytest.fixture(scope="module")
def points(spark):
    """Vectors around twenty middles, ties, and what is no vector."""
    rnd = np.random.default_rng(5)
    middles = rnd.normal(size=(20, 8)) * 10
    rows = [(i, (middles[i % 20] + rnd.normal(size=8) * 0.1).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, [0.0] * 8)]
    odd = [(3000, None), (3001, [float("nan")] * 8), (3002, [1.0] * 3), (3003, [float("inf")] * 8), (3004, [1.0] * 7 + [None])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "inverse"])
def test_vectors_many(spark, points, metric):
    table, cells = many.celled(points, 8)
    asked = points.filter("vec_id % 150 = 0 or vec_id >= 2000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = many.best_vectors(table, cells, asked, 9, metric, seeds=1)
    got = lists(found.rows.collect())
    sound = [r for r in asked.collect() if r.query_id < 3000]
    assert set(got) == {r.query_id for r in sound}
    for r in sound:
        assert got[r.query_id] == [(k + 1, x.vec_id, x.score) for k, x in enumerate(vector.search(points, r.vector, 9, metric).collect())]
    if metric != "dot":
        zero = F.col("query_id") != 2000  # the zero vector is at the same angle to all
        assert found.rest.filter(zero).count() < 0.3 * cells.count() * (len(sound) - 1)


@pytest.mark.parametrize("metric", ["cosine", "inverse"])
def test_steps_of_points_and_queries(spark, points, metric, monkeypatch):
    """Cells and queries beyond a step's size are dealt over several; of a large group of copies a step gives k rows."""
    monkeypatch.setattr(many, "POINTS", 16)
    monkeypatch.setattr(many, "ASKED", 2)
    copies = points.unionByName(spark.createDataFrame([(5000 + i, [1.0] * 8) for i in range(200)], points.schema))
    table, cells = many.celled(copies, 8)
    asked = copies.filter("(vec_id % 150 = 0 and vec_id < 3000) or vec_id = 5100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = lists(many.best_vectors(table, cells, asked, 9, metric).rows.collect())
    for r in asked.collect():
        assert found[r.query_id] == [(k + 1, x.vec_id, x.score) for k, x in enumerate(vector.search(copies, r.vector, 9, metric).collect())]
    same = pa.table({"doc_id": list(range(300, 0, -1)), "v": [[1.0, 2.0]] * 300})
    step = many.nearest_of(metric, 9, 2)(same, pa.table({"query_id": [1], "vector": [[1.0, 0.0]], "bar": pa.array([None], pa.float64())}))
    assert sorted(step["doc_id"].to_pylist()) == list(range(1, 10))


def test_no_vectors(spark, points):
    table, cells = many.celled(points.filter("vec_id >= 3000"), 8)
    asked = points.limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert many.best_vectors(table, cells, asked, 3).rows.count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_search_leaves_out_what_is_no_vector(points, metric):
    got = [r.vec_id for r in vector.search(points, [1.0] * 8, 1000, metric).collect()]
    assert len(got) == 606 and max(got) == 2000


def test_filters_without_values(points):
    assert vector.delete_where(points, {}).count() == 0 and vector.delete_where(points, {"vec_id": 5}).count() == points.count() - 1
    with pytest.raises(ValueError):
        rank.rrf([])


def as_points(spark, rows):
    chunks = spark.createDataFrame([(i, i, i % 3, "p", t) for i, t in rows], "seq long, chunk_id long, doc_id long, chunk_type string, content string")
    return indexing.points_of(chunks)


def test_hybrid_index(spark, texts, tmp_path):
    path = f"file://{tmp_path}/hybrid"
    assert hybrid.load(spark, path) is None
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    points = as_points(spark, rows)
    assert hybrid.save(points, path, 256)["doc_count"] == points.count()
    stored = hybrid.load(spark, path)
    queries = spark.createDataFrame([(1, "w1 w20"), (2, "w55"), (3, "none")], "query_id long, query string")
    for kind in ("hybrid", "semantic"):
        got = retrieval.search_many(stored, queries, 5, search_type=kind).collect()
        for q in queries.collect():
            want = retrieval.search(points, q.query, 5, search_type=kind).select("chunk_id", "score", "total").collect()
            assert sorted((r.chunk_id, r.score, r.total) for r in got if r.query_id == q.query_id) == sorted(map(tuple, want))
    some = retrieval.search_many(stored, queries, 5, where={"doc_id": "1"}).collect()
    for q in queries.collect():
        want = retrieval.hybrid_search(points, q.query, 5, where={"doc_id": "1"}).select("chunk_id", "score").collect()
        assert sorted((r.chunk_id, r.score) for r in some if r.query_id == q.query_id) == sorted(map(tuple, want))


def test_hybrid_save_broken_off(spark, tmp_path):
    """A save that fails midway leaves the index before it; the next whole one takes its place."""
    path = f"file://{tmp_path}/hybrid"
    hybrid.save(as_points(spark, [(1, "red fox")]), path, 256)
    broken = as_points(spark, [(2, "blue sea")]).withColumn("sparse", F.when(F.length("content") > 99, F.col("sparse")).otherwise(F.raise_error(F.lit("lost")).cast("map<string,double>")))
    with pytest.raises(PySparkException):
        hybrid.save(broken, path, 256)
    assert [r.id for r in hybrid.load(spark, path).points.collect()] == ["1"]
    hybrid.save(as_points(spark, [(3, "blue sky")]), path, 256, constant=60.0)
    now = hybrid.load(spark, path)
    assert [r.id for r in now.points.collect()] == ["3"] and now.state["constant"] == 60.0


def test_put_checks_and_settles(spark):
    name = f"chunks_{uuid.uuid4().hex}"
    index.drop(spark, name)
    index.create(spark, name, 4)
    row = lambda id_, v: spark.createDataFrame([(id_, v, {}, "t", "1", "p")], index.POINT)
    index.put(spark, name, row("a", [1.0] * 4))
    for wrong in ([1.0] * 2, None, [float("nan")] * 4):
        with pytest.raises(ValueError):
            index.put(spark, name, row("b", wrong))
    assert index.info(spark, name)["points_count"] == 1 and len([t for t in spark.catalog.listTables() if t.name.startswith(name)]) == 1
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__before")  # a call that was broken off between its renames
    assert index.exists(spark, name) and index.info(spark, name)["points_count"] == 1
    index.drop(spark, name)
    with pytest.raises(ValueError):
        index.put(spark, name, row("a", [1.0] * 4))


NAMES = ["a\nb", 'q"uo"te', "back\\slash", '\\"', "comma, x", " lead", "cr\rx", "crlf\r\ny", "tab\tz", "#hash", "'s", "plain", "\\", "ends\\", "a\\\nb", '""', '"']


def test_snapshot_of_odd_names(spark, tmp_path):
    e = spark.createDataFrame([(n, "T\nx" if i % 2 else "", n, ["Entity", "A"]) for i, n in enumerate(NAMES)], "id string, entity_type string, entity_role string, labels array<string>")
    r = spark.createDataFrame([(a, b, "R\n1") for a, b in zip(NAMES, NAMES[1:], strict=False)], "source string, target string, rel_type string")
    path = f"file://{tmp_path}/snapshot"
    assert snapshot.backup(e, r, path) == {"node_count": len(NAMES), "relationship_count": len(NAMES) - 1}
    assert sorted(map(tuple, snapshot.restore_nodes(spark, path).select("id", "entity_type", "entity_role").collect())) == sorted(map(tuple, e.select("id", "entity_type", "entity_role").collect()))
    assert sorted(map(tuple, snapshot.restore_edges(spark, path, e).collect())) == sorted(map(tuple, r.collect()))


def test_restore_with_rejects(spark, tmp_path):
    e = spark.createDataFrame([("a", "t", "r", ["Entity", "T"]), ("b", "t", "r", ["Entity", "T"])], "id string, entity_type string, entity_role string, labels array<string>")
    r = spark.createDataFrame([("a", "b", "R")], "source string, target string, rel_type string")
    path = f"file://{tmp_path}/snapshot"
    snapshot.backup(e, r, path)
    (tmp_path / "snapshot/nodes/more.csv").write_text('id,labels,entity_type,entity_role\nnew,Entity;B,t,r\nonly,two\n,Entity,t,r\ntoo,many,f,g,h\n"a",Entity;C,zt,zr\n')
    (tmp_path / "snapshot/relationships/more.csv").write_text("source,target,type\nnew,a,X\nnew,nobody,X\nnew,,X\nbad\n")
    got = snapshot.restore(spark, path)
    assert tuple(got.counts().first()) == (4, 2, 6) and got.metadata["node_count"] == 2
    assert sorted((x.part, x.reason) for x in got.rejects.collect()) == [("nodes", "broken record")] * 2 + [("nodes", "no id"), ("relationships", "a field is missing"), ("relationships", "an end is not in the graph"), ("relationships", "broken record")]
    assert {(x.id, x.entity_type, tuple(sorted(x.labels))) for x in got.entities.collect()} >= {("a", "zt", ("C", "Entity", "T")), ("new", "t", ("B", "Entity"))}
    old = spark.createDataFrame([("a", "old", "", ["Entity", "OLD"]), ("nobody", "o", "", ["Entity"])], e.schema)
    onto = snapshot.restore(spark, path, old, r.limit(0), clear=False)
    assert tuple(onto.counts().first()) == (4, 3, 5) and {x.id for x in onto.entities.collect()} == {"a", "b", "new", "nobody"}
    (tmp_path / "snapshot/metadata").rename(tmp_path / "snapshot/gone")
    assert snapshot.metadata(spark, path) == {}
