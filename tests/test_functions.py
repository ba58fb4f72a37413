import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import chunker, graph, rank
from graphloom.streaming.indexing import upsert_stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, clean", [
    ("1. Anna", "Anna"), ("  - * Anna", "Anna"), ("(a) Anna (queen)", "Anna"), ('"_Anna_"', "Anna"), ("Anna....", "Anna"), (None, ""), ("", ""),
    ("Anna (I) Maria", "Anna (I) Maria"), (" Anna ", "Anna"), ("* [Anna] ...", "Anna]"),
])
def test_clean(spark, raw, clean):
    assert one(spark, text.clean_name, raw) == clean


@pytest.mark.parametrize("numeral, value", [("XIV", 14), ("IX", 9), ("C", None), ("XXXXXXXXXXX", None), ("I", 1)])
def test_roman(spark, numeral, value):
    assert one(spark, text.roman_value, numeral) == value


def test_color(spark):
    import hashlib

    h = int(hashlib.md5(b"Person").hexdigest(), 16)
    hue, s, light = h % 360, (60 + h % 20) / 100, (45 + h % 20) / 100
    c = (1 - abs(2 * light - 1)) * s
    x, m = c * (1 - abs((hue / 60) % 2 - 1)), light - c / 2
    rgb = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][hue // 60]
    assert one(spark, text.color_of, "Person") == "#" + "".join(f"{int((v + m) * 255):02X}" for v in rgb)


@pytest.mark.parametrize("line, kind, pattern", [
    ("# A", "heading", "markdown_1"), ("Issue #5 is open", "heading", "markdown_1"), ("##", "text", None), ("########## x", "text", None),
    ("1.1 Title", "text", None), ("1.1. Title", "heading", "decimal"), ("IV) Title", "heading", "roman"), ("B. Title", "heading", "uppercase_alphabetical"),
    ("Appendix B", "special", None), ("NOTES", "special", None), ("Tài liệu tham khảo", "special", None), ("| a | b |", "row", None), ("\t ", "blank", None),
    ("Chương II. Mở đầu", "heading", "chuong"), ("c) x", "heading", "alphabetical"), ("plain", "text", None),
])
def test_lines(spark, line, kind, pattern):
    docs = spark.createDataFrame([(1, line)], "doc_id long, content string")
    row = chunker.lines(docs).first()
    assert (row.kind, row.pattern if kind == "heading" else None) == (kind, pattern)


def chunks_of(spark, content, size=2048):
    docs = spark.createDataFrame([(1, content)], "doc_id long, content string")
    return chunker.chunks(docs, size=size).orderBy("chunk").collect()


def test_chunks(spark):
    got = chunks_of(spark, "intro\n\nmore\n\n\n# A\n### B\ntext\n| a |\n\n| # b |\n### C\nlast\nAppendix A\nafter")
    assert [(c.chunk_type, c.level, list(c.hierarchy), c.content) for c in got] == [
        ("paragraph", 1, [], "intro\n\nmore"),
        ("section", 1, ["A"], None),
        ("subsection", 3, ["A", "B"], None),
        ("table", 4, ["A", "B"], "text\n\n| a |\n| # b |"),
        ("subsection", 3, ["A", "B", "C"], None),
        ("paragraph", 4, ["A", "B", "C"], "last"),
        ("section", 1, ["Phụ lục"], None),
        ("paragraph", 1, ["Phụ lục"], "after"),
    ]


def test_split(spark):
    docs = spark.createDataFrame([(1, "# T\n" + " ".join(f"w{i}" for i in range(30)))], "doc_id long, content string")
    got = chunker.split_oversized(chunker.chunks(docs, size=8), 8).filter("chunk_type = 'recursive_split'").orderBy("sub").collect()
    assert " ".join(r.content for r in got).split() == [f"w{i}" for i in range(30)]
    assert all(len(r.content.split()) <= 8 for r in got) and got[0].parent == "T_0"


def small_graph(spark):
    e = spark.createDataFrame([("A", "t", "r1", ["Entity", "T"]), ("B", "t", None, ["Entity", "T"]), ("C", "t", "r2", ["Entity", "T"])], "id string, entity_type string, entity_role string, labels array<string>")
    r = spark.createDataFrame([("A", "B", "X"), ("C", "A", "Y"), ("A", "A", "S")], "source string, target string, rel_type string")
    return e, r


def test_expand(spark):
    e, r = small_graph(spark)
    got = {(x.source_id, x.relationship, x.target_id) for x in graph.exact(e, r, ["a"]).collect()}
    assert got == {("A", "X", "B"), ("A", "Y", "C"), ("A", "S", "A")}
    assert {x.target_id for x in graph.exact(e, r, ["a"], ["R2"]).collect()} == {"A", "B"}
    assert graph.cascade(e, r, []).count() == 0


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "doc_id long, score double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "doc_id long, score double")
    assert rank.rrf([a, b]).collect() == rank.rrf([b, a]).collect()


def test_stream(spark, tmp_path):
    """Two batches: the second one changes one entity, adds one, and leaves the other buckets' files as they are."""
    ddl = "id string, entity_type string, entity_role string, seq long"
    first = spark.createDataFrame([("A", "king", "x", 1), ("A", "queen", "y", 2), ("", "t", "", 3), ("B", "king", "z", 4), ("D", "king", "z", 5)], ddl)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: upsert_stream(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    stream()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*")}
    spark.createDataFrame([("A", "king", "w", 6), ("C", "pawn", None, 7)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    got = {r.id: (r.entity_type, r.entity_role, r.labels) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"A": ("king", "w", ["Entity", "KING", "QUEEN"]), "B": ("king", "z", ["Entity", "KING"]), "C": ("pawn", "", ["Entity", "PAWN"]), "D": ("king", "z", ["Entity", "KING"])}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*")}
    assert sum(after.get(p) == t for p, t in before.items()) == 2


def test_spread(spark):
    from graphloom.sources.star import spread

    one = spark.range(100).coalesce(1)
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() == 4 and sorted(r.id for r in dealt.collect()) == list(range(100))
    many = spark.range(0, 100, 1, 6)
    assert spread(many, "id") is many
    assert spread(spark.range(0), "id").count() == 0
