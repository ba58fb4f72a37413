"""Operator 3 with more languages than one model holds."""

import random

import pytest

from graphloom.llm import language


def test_branches():
    for n, fan in ((1, 3), (3, 3), (4, 3), (9, 3), (10, 3), (40, 3), (1500, 32)):
        labels = [f"l{i:04}" for i in range(n)]
        nodes = language.branches(labels, fan)
        assert all(1 <= len(classes) <= fan for classes in nodes.values()) and sorted(x for part in nodes[""] for x in part) == labels
        leaves = [part[0] for classes in nodes.values() for part in classes if len(part) == 1]
        assert sorted(leaves) == labels
        assert set(nodes) == {""} | {f"{node}/{k}" for node, classes in nodes.items() for k, part in enumerate(classes) if len(part) > 1}


@pytest.mark.parametrize("fan", [3, 32])
def test_many_languages(spark, fan):
    """Twenty languages, of words of their own letters: none is left out, with one model or a tree of them."""
    rng = random.Random(6)
    alphabets = [[chr(97 + (3 * k + i) % 26) + chr(97 + (7 * k + 2 * i) % 26) + chr(0x430 + (k * 5 + i) % 32) for i in range(4)] for k in range(20)]
    rows = [(i, " ".join(rng.choices(alphabets[i % 20], k=12)), f"lang{i % 20:02}") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame.filter("doc_id < 600"), fan=fan)
    assert bool(model["below"]) == (fan == 3)
    got = language.predict(frame.filter("doc_id >= 600"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got) and all(0 < r.score <= 1 for r in got)
    assert len({r.lang_pred for r in got}) == 20
