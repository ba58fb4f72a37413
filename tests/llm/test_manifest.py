"""Operators 11 to 13: against plain versions, by round trips, on pages of other kinds, and their defined cases."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle, main_text, manifest
from graphloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "One two  three\n", "en", "a", 15), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "No Id", None, "b", 5),
    (5, "<P> is here", "fr", "b", 11), (6, " \t\n", "fr", "b", 3), (7, "ÄÖ Ü é 😀 z", "en", "a", 9), (7, "ÄÖ Ü é 😀 z", "en", "a", 9), (8, "Word " * 30000, "de", "a", 150000),
]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """With columns of clashing names."""
    return spark.createDataFrame(ROWS, DDL).withColumns({"n": F.lit("x"), "Output": F.lit(1), "path": F.lit(2), "i": F.lit(3), "a.b": F.lit(4), "t": F.lit(5)})


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in own) for r in df.collect()) == sorted(found.fetchall())


def test_wavelet():
    rnd = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        x = rnd.integers(0, 4, size, dtype=np.uint8)
        tree = fill_middle.Wavelet(x, 2)
        for s in range(4):
            want = np.concatenate([[0], np.cumsum(x == s)])
            assert (tree.rank(s, np.arange(size + 1)) == want).all()
            count = np.arange(1, want[-1] + 1)
            zero = np.zeros(len(count), np.int64)
            assert (tree.find(s, count, zero, zero + size) == np.flatnonzero(x == s)).all()


@pytest.mark.parametrize("slice_", [7, 1 << 22])
def test_cuts(slice_, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(fill_middle, "SLICE", slice_)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \t\n é😀") for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", " ", "a", "a ", " a"]
    h = [[rnd.randrange(1 << 32) for _ in texts] for _ in range(2)]
    got = fill_middle._cuts(pd.Series(texts), pd.Series(h[0]), pd.Series(h[1]))
    for i, x in enumerate(texts):
        units = UNIT.findall(x)
        a, b = sorted(y[i] % (len(units) + 1) for y in h)
        assert tuple(got.iloc[i]) == (len(units), len("".join(units[:a])), len("".join(units[:b])))
    assert len(fill_middle._cuts(pd.Series([], dtype=str), pd.Series([], dtype=int), pd.Series([], dtype=int))) == 0


@pytest.mark.parametrize("spm", [0, 80, 100])
def test_round_trip(spark, docs, spm):
    done = fill_middle.transform(docs, rate=100, spm=spm).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "path", "i", "a.b", "t", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    rows = done.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        t = r.text or ""
        assert r.again == t and r.n == len(UNIT.findall(t)) and (r.form == "plain") == (t == "" or "<P>" in t)
        if r.form == "plain":
            assert r.output == t and r.prefix_chars is None and r.middle_chars is None
        else:
            p, m, s = t[: r.prefix_chars], t[r.prefix_chars : r.prefix_chars + r.middle_chars], t[r.prefix_chars + r.middle_chars :]
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert {r.form for r in rows} - {"plain"} == ({"psm"} if spm == 0 else {"spm"} if spm == 100 else {r.form for r in rows} - {"plain"})
    assert fill_middle.transform(docs.filter("false")).count() == 0


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return joined(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in values])


def climbed(nodes):
    """The root, and each leaf's siblings level by level."""
    under, out = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        for k, below in enumerate(under):
            run = range(k // 8 * 8, min(k // 8 * 8 + 8, len(nodes)))
            for leaf in below:
                out[leaf].append((nodes[run[0] : k], nodes[k + 1 : run[-1] + 1]))
        starts = range(0, len(nodes), 8)
        nodes, under = [joined(*nodes[k : k + 8]) for k in starts], [sum(under[k : k + 8], []) for k in starts]
    return nodes[0], out


def by_force(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(((r[0] is not None, r[0] or 0, leaf_of(r)), r) for r in rows if r[2] == x) for x in langs}
    subs = {x: climbed([k[2] for k, _ in trees[x]]) for x in langs}
    root, tops = climbed([subs[x][0] for x in langs]) if rows else ("", [])
    for x, top in zip(langs, tops, strict=True):
        for (key, r), path in zip(trees[x], subs[x][1], strict=True):
            lower = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = leaf_of((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])) if lower else r)
            for before, after in path + top:
                at = joined(*before, at, *after)
            yield r[0], key[2], subs[x][0], root, joined(*[h for b, a in path + top for h in (*b, *a)]), at, at == root


def query(docs):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(third, F.translate("text", manifest.UPPER, manifest.LOWER)).otherwise(F.col("text"))
    return manifest.manifest(docs, tampered=lowered).drop("path")


NULLS = lambda r: tuple((x is not None, x or 0) if i == 0 else x for i, x in enumerate(r))


def test_manifest(spark, docs):
    got = query(docs).collect()
    want = list(by_force([(i, s, la, n, t) for i, t, la, s, n in ROWS]))
    assert sorted(map(NULLS, got)) == sorted(map(NULLS, want)) and len(got) == len(ROWS)
    assert all(r.verified for r in manifest.manifest(docs).collect())
    assert query(docs.filter("false")).count() == 0
    assert query(docs.filter("doc_id = 5")).first().root == leaf_of((5, "b", "fr", 11, "<P> is here"))


@pytest.mark.parametrize("sizes", [(8, 9), (64, 65, 1), (512, 513), (4097,), (3, *[1] * 70)])
def test_manifest_heights(spark, sizes):
    """Trees at and just above full levels and groups, one large language beside small ones, more languages than a run holds."""
    rows = [(i, f"A{i}", f"l{k:03}", "s", i % 5) for k, n in enumerate(sizes) for i in range(k * 10000, k * 10000 + n)]
    got = query(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(map(tuple, got)) == sorted(by_force([(i, s, la, n, t) for i, t, la, s, n in rows]))
    assert len({r.root for r in got}) == 1 and any(not r.verified for r in got)


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.train(spark)


def test_tree_learns_its_table(tree):
    def says(node, x):
        while isinstance(node, list):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    rows = main_text.labelled()
    assert len(rows) > 100 and all(says(tree, x) == y for y, x in rows)


def test_pages(spark):
    """The article element of the tables' pages, by a pattern."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op12_main_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


WEB = {
    "names": (
        "<body class='has-sidebar'><div id=page><div class='site-header'><a href=/>Site</a> tagline words here</div><div class='menu-main'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>"
        "<div class='entry-content'><h1>Title of it</h1><p>First para with <a href=q>a link</a> inside it and more.<p>Second &lt;b&gt; para.<br>Line &amp; two&nbsp;x"
        "<div class='advert'>Buy now! This is a long advert text with many words in it to fool the classifier</div><pre>code  here</pre></div>"
        "<div class='comments-area'><p>A reader wrote a very long comment here with many words, indeed it is long enough to look like text.</div>"
        "<script>if (a<b) document.write('<p>x</p>')</script><!-- <p>hidden</p> --></div></body>",
        "Title of it First para with a link inside it and more. Second <b> para. Line & two x code here",
    ),
    "form around": ("<form id=aspnetForm><article><p>Text in article one.</p><form class=newsletter><p>Sign up now for our letter</p><input></form><p>More</p></article></form><p>foot", "Text in article one. More"),
    "no elements": ("<p>" + "word " * 60 + "</p><p>Short.</p><p>" + "word " * 40 + "</p>", " ".join(["word"] * 60 + ["Short."] + ["word"] * 40)),
    "comments": ("<main><h1>T</h1><p>" + "a b c d " * 10 + "</p><div><h3>3 Comments</h3><p>" + "x y z " * 20 + "</p></div></main>", "T " + " ".join(["a b c d"] * 10)),
    "cut off": ("<article><p>abc def</p><p>gh <b", "abc def gh"),
    "aside": ("<article><p>one</p><aside><p>" + "no " * 50 + "</p></aside><p>two</p></article><aside>three</aside>", "one two"),
    "references": ("<article>a < b and c > d &lt; <i>it</i>al<b>ic</b> <x-y>x</x-y> &#x41;&#66;&eacute;&nosuch; &amp;amp;</article>", "a < b and c > d < italic x ABé&nosuch; &amp;"),
    "hidden": ("<article><p style='display: none'>no</p><p hidden>no</p><p title=\"a > b\">yes</p></article>", "yes"),
    "long": ("<article>" + "<p>one &amp; two</p>" * 20000 + "</article>", " ".join(["one & two"] * 20000)),
    "unclosed": ("<article><p>one<script>var x = '</p>';", "one"),
    "no text": ("<nav><a href=x>y</a></nav>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


def test_kinds_of_pages(spark, tree):
    rows = [(None if k == "null" else i, k, page) for i, (k, (page, _)) in enumerate(WEB.items())]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string").withColumns({"text": F.lit("x"), "b": F.lit(1), "row": F.lit(2), "c.d": F.lit(3)})
    got = main_text.extract(pages, tree)
    assert got.columns == ["page_id", "url", "b", "row", "c.d", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(WEB) + 2 and all((r.text, r.n_chars) == (WEB[r.url][1], len(WEB[r.url][1])) for r in rows)
    assert main_text.extract(pages.filter("false"), tree).count() == 0


def test_quoted_columns(spark):
    """Columns with dots in their names, and clashes in another case."""
    from graphloom.llm import mixing, packing, quality, repeated_words, secret_scan
    from graphloom.llm.queries import vocabulary

    docs = spark.createDataFrame([(1, "a b c " * 20, "s"), (None, None, None)], "`d.id` long, `t.x` string, `s.y` string").withColumn("Copy", F.lit(1))
    assert mixing.mix(docs, doc_id="d.id", text="t.x", source="s.y", copy="copy").columns == ["d.id", "t.x", "s.y", "copy", "mix_key"]
    assert mixing.mix(docs, doc_id="d.id", text="t.x", source="s.y", copy="Copy").columns == ["d.id", "t.x", "s.y", "Copy", "mix_key"]
    assert quality.judge(docs, text="t.x", host="s.y").count() == 2
    assert packing.pack(docs, vocabulary(), doc_id="d.id", text="t.x").count() >= 2
    assert secret_scan.scan(docs, text="t.x").count() == 2
    assert repeated_words.dedup(docs, doc_id="d.id", text="t.x").count() == 2


def test_topk_sparse_ids(spark):
    """Ids far apart fill blocks all the same."""
    from graphloom.llm import topk

    frame = spark.createDataFrame([(i * 1000, [float(i % 7), float(i % 11)]) for i in range(2048)], "vec_id long, embedding array<double>")
    search = topk.Search(frame, F.col("vec_id") == 0, "vec_id", "embedding", 10, 1024, 128)
    assert search.blocks == 16 and search.index.filter(F.length("ids") != 8 * 128).count() == 0
