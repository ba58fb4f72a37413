"""Operator 8: retrieval by bands over raw windows, its recall and its defined cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import licenses
from graphloom.llm.queries import ORACLES


def by_sql(docs):
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas())
        return {r[0]: r[1:] for r in db.execute(ORACLES["op8_licenses"]).fetchall()}


@pytest.fixture(scope="module")
def worn(spark):
    """Every template, worn down about to the least containment, at every kind of place among other words."""
    rnd, rows = random.Random(8), []
    for name, text in licenses.TEMPLATES.items():
        words = licenses.template_words(text)
        for change in range(0, 4):
            for before in (0, 1, len(words) // 2, len(words), 3 * len(words) + 1):
                own = list(words)
                for _ in range(change * len(words) // 100 + (change > 0)):
                    own[rnd.randrange(len(own))] = "other"
                around = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
                rows.append((len(rows), " ".join(around(before) + own + around(rnd.randrange(4 * len(words))))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(docs):
    return {r.doc_id: (",".join(r.licenses), r.n_windows, pytest.approx(r.containment)) for r in licenses.scan(docs).collect()}


def test_recall(worn):
    """Everything that containment alone finds is retrieved by the bands."""
    want = by_sql(worn)
    assert found(worn) == want and sum(bool(x[0]) for x in want.values()) > 0.3 * len(want)


def test_bands_retrieve(worn, monkeypatch):
    """Retrieval is by bands: with one band for each class most worn templates are lost."""
    whole = licenses.kinds(licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "kinds", lambda *_: [licenses.Kind(k.number, k.k, k.span, 1, k.templates) for k in whole])
    few, all_ = (sum(bool(x[0]) for x in y.values()) for y in (found(worn), by_sql(worn)))
    assert 0 < few < 0.9 * all_


def test_windows_are_signed_whole(spark):
    """A window's shingles are all of its words', not the templates' alone."""
    docs = spark.createDataFrame([(1, "one two three all rights reserved four five six seven")], "row long, text string")
    kind = next(k for k in licenses.kinds(licenses.TEMPLATES) if "rights-reserved" in k.templates)
    words = F.array_remove(F.split("text", " "), "")
    got = docs.select(F.explode(licenses.met_windows(words, kind)).alias("x")).select("x.*").collect()
    assert {r.window: r.g for r in got} == {1: ["all rights reserved", "rights reserved four", "reserved four five", "four five six"], 0: ["one two three", "two three all", "three all rights", "all rights reserved"]}


def test_cases(spark):
    text = "Header. All rights reserved. " + "word " * 30000 + licenses.TEMPLATES["mit-full"]
    rows = [(1, text), (1, text), (1, "All rights reserved."), (None, "Released under the MIT License."), (2, None), (3, ""), (4, "rights"), (5, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame(rows, "`a.b` long, `c.d` string").withColumns({"row": F.lit(1), "class": F.lit(2), "Licenses": F.lit(3)})
    got = licenses.scan(docs, "a.b", "c.d")
    assert got.columns == ["a.b", "row", "class", "licenses", "n_windows", "containment"]
    told = sorted((r["a.b"] or 0, ",".join(r.licenses)) for r in got.collect())
    assert told == [(0, "mit"), (1, "mit-full,mit-permission,rights-reserved"), (1, "mit-full,mit-permission,rights-reserved"), (1, "rights-reserved"), (2, ""), (3, ""), (4, ""), (5, "apache-2.0,cc-by-nc-4.0")]
    assert licenses.scan(docs.filter("false"), "a.b", "c.d").count() == 0
