"""Operator 13, Merkle dataset manifest: a tree of digests over the rows of each language, with a proof for every row.

Time-forward processing: a node's label is its tree, level and place. Nodes send their digests to their parents as
messages, and a queue that is ordered by label hands each parent all of its messages at once, in order; parents come after
their children, so every label is taken once. The queue is Spark's sorted shuffle, which spills and is dealt by label: one
round serves the labels of STRIDE levels, whose messages meet in one row for each FAN ** STRIDE nodes, and leaves 1 node
of these for the next round. Then the sweep is run in reverse: from the root down, every group of nodes sends the nodes
below it what their proofs end with (the siblings from there to the root), until the leaves have them.

A row's leaf is the digest of its columns. Leaves ascend by id (nulls first, equal ids by leaf) within their language;
runs of FAN nodes become the digest of their concatenation while more than one node remains, so a lone leaf is the
language's root, and the languages' roots, in order, are the leaves of one last tree. The proof of a leaf is the siblings
in its run (those before and those after it), level by level to the root.

Scale: rows of 4 digests travel, not texts; they are sorted once by range and gathered once, by 512; every later round
handles a 512th of the one before. A language with a third of all rows, or all, is many groups like any other, and a proof
reaches a group of 512 leaves as one message.

Defined cases: a null value counts as `-`, and a null language is a language of its own (the first); tampering leaves rows
with a null id or null text as they are; repeated rows are leaves of their own; an empty table gives an empty result; texts
are whole, however long; further columns are not part of a leaf and are not carried, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, placed, stored

FAN, STRIDE = 8, 3
GROUP = FAN**STRIDE
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One level of a proof: the digests before and after a node in its run.
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """The digest of the concatenation, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values, each with its length in bytes before it."""

    def part(x: Column) -> Column:
        told = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))

    return digest(*map(part, values))


def _runs(nodes: Column) -> Column:
    """The digests of successive runs of FAN digests."""
    run = lambda k: digest(F.array_join(F.slice(nodes, k * FAN + 1, F.lit(FAN)), ""))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), run)


def _levels(nodes: Column, height: Column) -> Column:
    """The levels above the group's nodes as an array of arrays of digests, itself first, at most STRIDE more."""
    none = F.array().cast("array<string>")
    above = lambda x, level: F.when(height >= level, _runs(x)).otherwise(none)
    one = lambda a: let(above(a, 1), lambda b: let(above(b, 2), lambda c: F.array(a, b, c, above(c, 3))))
    return let(nodes, one)


def _path(levels: Column, height: Column, j: Column) -> Column:
    """The levels of a proof inside a group, for its j-th node."""
    out = []
    for level in range(STRIDE):
        at = F.floor(j / FAN**level).cast("int")
        begin = (F.floor(at / FAN) * FAN).cast("int")
        here = F.get(levels, F.lit(level))
        side = F.struct(
            F.array_join(F.slice(here, begin + 1, at - begin), "").alias("l"),
            F.array_join(F.slice(here, at + 2, F.greatest(begin + (FAN - 1) - at, F.lit(0))), "").alias("r"),
        )
        out.append(F.when(height > level, side))
    return F.filter(F.array(*out), lambda x: x.isNotNull()).cast(PATH)


def grouped(nodes: DataFrame, tree: str, carried: list[str]) -> DataFrame:
    """One round up. nodes: tree, i, n (the nodes of the tree on this level), digest and carried columns. Per group of
    GROUP nodes: tree, i (the group's own place), n (groups of the tree), height (levels inside), levels, members and digest."""
    order = F.struct("i", "digest", *carried)
    rows = nodes.withColumn("g", F.floor(F.col("i") / GROUP)).groupBy(tree, "g", "n").agg(F.array_sort(F.collect_list(order)).alias("members"))
    height = F.lit(0)
    for level in range(STRIDE):
        height += (F.col("n") > FAN**level).cast("int")
    rows = rows.withColumn("height", height).withColumn("levels", _levels(F.transform("members", lambda x: x["digest"]), F.col("height")))
    top = F.get(F.get(F.col("levels"), F.col("height")), F.lit(0))
    return rows.select(tree, F.col("g").alias("i"), F.ceil(F.col("n") / GROUP).alias("n"), "height", "levels", "members", top.alias("digest"))


def proofs(nodes: DataFrame, tree: str, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The roots (tree, digest) of trees of placed nodes, and their groups (as grouped(), with tree, path and top): path is
    what every proof of the group ends with, top the tree's root. Both sweeps run over stored tables."""
    rounds = [stored(grouped(nodes, tree, carried))]
    while rounds[-1].agg(F.max("n")).first()[0] not in (None, 1):  # a 512th of the groups remains each time
        rounds.append(stored(grouped(rounds[-1].select(tree, "i", "n", "digest"), tree, [])))
    roots = rounds[-1].select(tree, "digest")
    down = rounds.pop().withColumns({"path": F.array().cast(PATH), "top": F.col("digest")})
    while rounds:
        sent = F.transform("members", lambda x, j: F.struct(x["i"].alias("i"), F.concat(_path(F.col("levels"), F.col("height"), j), F.col("path")).alias("path")))
        told = down.select(F.col(tree).alias("t"), "top", F.explode(sent).alias("m")).select("t", "top", F.col("m.i").alias("p"), F.col("m.path").alias("path"))
        below = rounds.pop()
        down = below.join(told, below[tree].eqNullSafe(told["t"]) & (below["i"] == told["p"])).drop("t", "p")
    return roots, down


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """Per row of docs its id (the first of columns), leaf, subroot (of its lang), root, path (levels of siblings from the
    leaf to the root), proof_sha256 and folded_root, which is worked out from the leaf of `tampered` (a column that takes
    the text's place; by default the text itself), the leaf's siblings and nothing else; verified: whether it is the root."""
    doc_id, text = columns[0], columns[-1]
    values = [F.col(f"`{c}`") for c in columns]
    other = leaf([*values[:-1], tampered]) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col("`lang`").alias("lang"), leaf(values).alias("digest"), other.alias("other"))
    leaves = stored(leaves.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))))  # the sort's sample is then of these
    roots, groups = proofs(placed(leaves, "lang", ["id", "digest"]), "lang", ["id", "other"])
    one = F.lit(0).alias("tree")
    subroots = placed(roots.select(one, "lang", "digest"), "tree", ["lang"])
    _, top = proofs(subroots, "tree", ["lang"])
    ways = F.transform("members", lambda x, j: F.struct(x["lang"].alias("l"), F.concat(_path(F.col("levels"), F.col("height"), j), F.col("path")).alias("upper")))
    upper = top.select(F.col("top").alias("root"), F.explode(ways).alias("m")).select("root", F.col("m.l").alias("l"), "m.upper")
    joined = groups.withColumn("subroot", F.col("top")).join(upper, groups["lang"].eqNullSafe(upper["l"]))
    ends = F.concat(F.col("path"), F.col("upper"))
    each = joined.select("subroot", "root", "levels", "height", ends.alias("ends"), F.posexplode("members").alias("j", "m"))
    rows = each.select("subroot", "root", "m.id", "m.digest", "m.other", F.concat(_path(F.col("levels"), F.col("height"), F.col("j")), F.col("ends")).alias("path"))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    folded = F.aggregate("path", F.coalesce("other", "digest"), lambda a, x: digest(x["l"], a, x["r"]))
    return rows.select(
        F.col("id").alias(doc_id), F.col("digest").alias("leaf"), "subroot", "root", "path", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
