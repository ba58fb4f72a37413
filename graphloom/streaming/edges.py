"""Edges as a stream: an edge waits in state until both its ends have come as nodes, in whatever order they come."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions.text import strip
from graphloom.operators.graph import valid_edges, valid_nodes

COLUMNS = ["source", "target", "rel_type"]
EDGE = "source string, target string, rel_type string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A node's edges are dealt to so many groups, so that a hub's are not one task's work; a node goes to each of them.
SPLITS = 16
#: Waiting edges leave the state so many at a time.
AT_ONCE = 10_000


class Waiting(StatefulProcessor):
    """The edges at one end: kept while the node is unknown, all given out when it comes, passed on from then on."""

    def __init__(self, at_once: int = AT_ONCE) -> None:
        self.at_once = at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")
        self.edges = handle.getListState("edges", EDGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = self.known.exists()
        for frame in rows:
            node = frame["source"].isna()
            if node.any() and not known:
                known = True
                self.known.update((True,))
                if self.edges.exists():
                    held = iter(self.edges.get())
                    while some := list(islice(held, self.at_once)):
                        yield pd.DataFrame(some, columns=COLUMNS)
                    self.edges.clear()
            edges = frame.loc[~node, COLUMNS]
            if known:
                yield edges
            elif len(edges):
                self.edges.appendList(list(edges.itertuples(index=False, name=None)))

    def close(self) -> None:
        pass


def _met(nodes: DataFrame, edges: DataFrame, end: str, other: str, splits: int, at_once: int) -> DataFrame:
    """The edges whose `end` has come as a node."""
    part = F.pmod(F.xxhash64(other, "rel_type"), F.lit(splits)).cast("int").alias("part")
    none = [F.lit(None).cast("string").alias(c) for c in COLUMNS]
    told = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), *none)
    both = edges.select(F.col(end).alias("id"), part, *COLUMNS).union(told)
    return both.groupBy("id", "part").transformWithStateInPandas(Waiting(at_once), outputStructType=EDGE, outputMode="Append", timeMode="None")


def edge_stream(nodes: DataFrame, edges: DataFrame, table_path: str, checkpoint: str, splits: int = SPLITS, at_once: int = AT_ONCE) -> StreamingQuery:
    """Streams of nodes (id, entity_type) and edges (source, target, rel_type), to a table of edges as upsert_edges() makes
    it: valid ones, each once, whose ends are valid nodes. Nodes and edges may come in any order and again and again:
    equal edges are told by state, and the file sink takes a batch that is run again once. State has the edges seen
    (a row each) and those that wait; edges whose ends are known pass. The session's state is set to RocksDB, which
    keeps it on disk. A table's earlier entities must come through nodes once. Stops once what is there has been read.

    Invalid and null nodes or edges are left out; streams without rows give an empty table; other columns are not read."""
    nodes.sparkSession.conf.set(PROVIDER, ROCKSDB)
    ids = valid_nodes(nodes).select(strip(F.col("id")).alias("id"))
    once = valid_edges(edges).dropDuplicates(COLUMNS)
    both = _met(ids, _met(ids, once, "source", "target", splits, at_once), "target", "source", splits, at_once)
    return both.writeStream.format("parquet").outputMode("append").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
