"""Steps over large tables are dealt over as many tasks as their rows ask for, with the same rows."""

import pytest

from graphloom.plans import registry
from graphloom.sources import star

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["edge_scan", "graph_expand", "backup_restore_edges"])
def test_edges_are_dealt_by_rows(spark, name, monkeypatch):
    """F13, F14, F16: 6000 line items are twelve tasks of 500 rows, and nothing is sent to every task but small tables."""
    whole = registry.QUERIES[name](spark, SF).collect()
    monkeypatch.setattr(star, "TASK_ROWS", 500)
    dealt = registry.QUERIES[name](spark, SF)
    told = dealt._jdf.queryExecution().executedPlan().toString()
    n = 12 if name != "backup_restore_edges" else -(-star.edges(spark, SF).count() // 500)
    for key in ("source", "target") if name != "graph_expand" else ("s", "t"):
        assert f"{n}), REPARTITION_BY_NUM" in told.split(f"Exchange hashpartitioning({key}#", 1)[1].split("\n")[0]
    got = dealt.collect()
    assert got == whole if name == "edge_scan" else sorted(got) == sorted(whole)


@pytest.mark.parametrize("name, sorts", [("graph_expand", 0), ("edge_scan", 1)])
def test_edges_pass_unsorted(spark, name, sorts, monkeypatch):
    """F14, F16: joins hold the ends, not the edges, and a count by source stays where the triples lie."""
    monkeypatch.setattr(star, "TASK_ROWS", 500)
    told = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert told.count("Sort [") == sorts and "SortMergeJoin" not in told and "hashpartitioning(source_id#" not in told


@pytest.mark.parametrize("rows", [7_200_000, 36_000_000, 216_000_000])
def test_rows_of_a_task_do_not_grow(rows):
    """F13, F14, F16: half a million or so at any size."""
    assert 1 << 18 <= rows / star.tasks_for(rows) <= 1 << 19


@pytest.mark.parametrize("name", ["structural_chunks", "structure_tree", "chunk_export", "recursive_split"])
def test_documents_are_dealt_by_rows(spark, name, monkeypatch):
    """200 documents are four tasks of 50, which keep them to the end; each chunk is cut once."""
    monkeypatch.setattr(star, "TASK_DOCS", 1000)
    whole = registry.QUERIES[name](spark, SF).collect()
    monkeypatch.setattr(star, "TASK_DOCS", 50)
    dealt = registry.QUERIES[name](spark, SF)
    told = dealt._jdf.queryExecution().executedPlan().toString()
    assert "4), REPARTITION_BY_NUM" in told and told.count("Exchange hash") == 1
    assert told.count("EvalPython [pieces") == (name == "recursive_split")
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, whole))
