"""The chunker against a plain line-by-line version, over random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunker

#: text, kind, pattern, heading text
PALETTE = [
    ("plain words here", "text", None, None), ("more of them, and more", "text", None, None), ("", "blank", None, None), ("  ", "blank", None, None), ("", "blank", None, None),
    ("| a | b |", "row", None, None), ("| # c | d |", "heading", "markdown_1", "c | d |"), ("# One", "heading", "markdown_1", "One"), ("### Three", "heading", "markdown_3", "Three"),
    ("1. First", "heading", "arabic", "1. First"), ("1.2. Second", "heading", "decimal", "1.2. Second"), ("IV. Fourth", "heading", "roman", "IV. Fourth"), ("b) letter", "heading", "alphabetical", "b. letter"),
    ("A. Upper.", "heading", "uppercase_alphabetical", "A. Upper."), ("Appendix B", "special", "appendix", None), ("notes", "special", "footnote", None), ("References", "special", "reference", None),
]
IS_ROW = {"| a | b |", "| # c | d |"}


def elements(lines):
    i, out = 0, []
    while i < len(lines):
        text, kind, pattern, title = lines[i]
        i += 1
        if kind in ("special", "heading"):
            out.append((kind, text, pattern, title))
        elif kind == "row":
            rows = [text]
            while i < len(lines) and (lines[i][0] in IS_ROW or lines[i][1] == "blank"):
                rows += [lines[i][0]] if lines[i][0] in IS_ROW else []
                i += 1
            out.append(("table", "\n".join(rows), None, None))
        elif kind == "text":
            held = [text]
            while i < len(lines) and (lines[i][1] == "text" or (lines[i][1] == "blank" and not (i + 1 < len(lines) and lines[i + 1][1] == "blank"))):
                held.append(lines[i][0])
                i += 1
            out.append(("paragraph", "\n".join(held), None, None))
    return out


def plain_chunks(lines, size):
    found = elements(lines)
    names = {k: v for k, _, v in chunker.SPECIAL}
    marks = [p for k, _, p, _ in found if k == "heading"]
    top = max((int(p.split("_")[1]) for p in marks if p.startswith("markdown_")), default=0)
    level = {p: top + 1 + i for i, p in enumerate(x for x in chunker.HIERARCHY if x in marks)} | {p: int(p.split("_")[1]) for p in marks if p.startswith("markdown_")}
    out, pending, heading, special, stack = [], [], None, None, []

    def chunk(kind, lev, hierarchy, content, n, table):
        tokens = len((content or "").split())
        out.append((kind, lev, hierarchy, content, n, table, tokens, tokens > size))

    def flush(shown):
        if pending:
            table = any(k == "table" for k, _ in pending)
            under = heading[1] if heading else []
            chunk("table" if table else "paragraph", heading[0] + 1 if heading else 1, ([names[shown]] if shown else []) + under, "\n\n".join(x for _, x in pending), len(pending), table)
            pending.clear()

    for kind, text, pattern, title in found:
        if kind == "special":
            flush(None)
            special, heading, stack = pattern, None, []
            chunk("section", 1, [names[pattern]], None, 1, False)
        elif kind == "heading":
            flush(special)
            stack = [*stack[: level[pattern] - 1], title]
            heading = (level[pattern], stack)
            chunk("section" if level[pattern] == 1 else "subsection", level[pattern], ([names[special]] if special else []) + stack, None, 1, False)
        else:
            pending.append((kind, text))
    flush(special)
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    return [[rng.choice(PALETTE) for _ in range(rng.randint(1, 30))] for _ in range(150)]


def test_chunks_against_plain(spark, cases):
    docs = spark.createDataFrame([(i, "\n".join(x[0] for x in lines)) for i, lines in enumerate(cases)], "doc_id long, content string")
    got: dict = {}
    for r in chunker.chunks(docs, size=8).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_type, r.level, list(r.hierarchy), r.content, r.element_count, r.contains_table, r.tokens, r.is_oversized))
    for i, lines in enumerate(cases):
        assert got.get(i, []) == plain_chunks(lines, 8), lines


def test_tree_summary_and_export(spark, cases):
    docs = spark.createDataFrame([(i, "\n".join(x[0] for x in lines)) for i, lines in enumerate(cases)], "doc_id long, content string")
    found = chunker.chunks(docs, size=8)
    tree = {(r.doc_id, r.path): r.n_chunks for r in chunker.structure_tree(found).collect()}
    summary = {r.doc_id: (r.n_chunks, r.n_oversized, r.max_depth) for r in chunker.structure_summary(found).collect()}
    shown: dict = {}
    for r in chunker.export(found).collect():
        shown.setdefault(r.doc_id, {})[r.chunk] = (json.loads(r.json), r.total_chunks)
    want: dict = {}
    for i, lines in enumerate(cases):
        plain = plain_chunks(lines, 8)
        for c in plain:
            for k in range(1, len(c[2]) + 1):
                want[i, " > ".join(c[2][:k])] = want.get((i, " > ".join(c[2][:k])), 0) + 1
        if plain:
            assert summary[i] == (len(plain), sum(c[-1] for c in plain), max(len(c[2]) for c in plain))
        for n, c in enumerate(plain):
            assert shown[i][n] == ({"chunk_id": n, "level": c[1], "chunk_type": c[0], "section_hierarchy": c[2], "is_oversized": c[-1], "parent_chunk_id": None, "content": c[3]}, len(plain))
    assert tree == want


def test_split_text():
    text = ". ".join(" ".join(f"s{i}w{k}" for k in range(1 + i % 7)) for i in range(40))
    for size in (3, 5, 20):
        pieces = chunker.split_text(text, size)
        assert " ".join(" ".join(pieces).replace(".", " ").split()) == " ".join(text.replace(".", " ").split())
        assert all(len(p.split()) <= size + p.count(". ") for p in pieces)
    lap = chunker.split_text(" ".join(f"w{i}" for i in range(30)), 10, 4)
    assert lap[0].split() == [f"w{i}" for i in range(10)] and lap[1].split()[:4] == lap[0].split()[-4:]
    assert chunker.split_text("", 5) == [] and chunker.split_text(" \n ", 5) == [] and chunker.split_text("abc", 1) == ["abc"]


def test_split_by_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "# T\n" + "unbelievably long-winded sentences, again. " * 30)], "doc_id long, content string")
    found = chunker.chunks(docs, size=40, count=chunker.tokens_by(path))
    count = chunker.counter_of(path)
    assert [r.tokens for r in found.filter("content IS NOT NULL").collect()] == [count(r.content) for r in found.filter("content IS NOT NULL").collect()]
    pieces = chunker.split_oversized(found, 40, overlap=5, tokenizer=path).filter("chunk_type = 'recursive_split'").orderBy("sub").collect()
    assert len(pieces) > 3 and all(count(r.content) <= 40 and r.level == 3 and r.parent == f"T_{r.sub}" for r in pieces)


def test_many_headings(spark):
    """A document of a hundred thousand headings, of levels that jump, in linear time: as a fold over its lines has them."""
    n = 100_000
    levels = [(i * 7919) % 6 + 1 if i % 5 else 1 for i in range(n)]
    lines = [f"{'#' * d} H{i}" for i, d in enumerate(levels)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:50]))], "doc_id long, content string")
    stack, want = [], []
    for i, d in enumerate(levels):
        stack = [*stack[: d - 1], f"H{i}"]
        want.append(" > ".join(stack))
    got = chunker.chunks(docs).select("doc_id", "chunk", F.array_join("hierarchy", " > ").alias("h")).orderBy("doc_id", "chunk").collect()
    assert [r.h for r in got] == want + want[:50]
