"""Operator 5, MinHash near-dedup with DartMinHash signatures.

A document is the set of its shingles of five words (all its words, if it has fewer); how often a shingle occurs does not
count, neither for candidates nor for links. DartMinHash throws darts at the region of each element (of weight 1):
ranks are cut into levels by powers of four, in each region and level a hashed Poisson number of darts falls
with hashed ranks and coordinates, and each coordinate of the signature keeps its dart of least rank. Darts depend on
the element and level alone, so two sets agree in a coordinate with the probability of their Jaccard similarity. Levels are thrown from the lowest that can matter for the weight (fewer than 0.001 darts lie below it)
until every coordinate has its dart.

Signatures are cut into BANDS bands of ROWS coordinates. The first document of a band's bucket (the least id) is its
centre; it is compared with each other member on the whole sets of 64-bit shingle hashes, and pairs of SIMILARITY or more are links.
Members of a bucket that stay in another class than its centre are then compared with a further centre, for ROUNDS
rounds in all, the first centre taken out and the buckets reduced to those that still hold several classes. In what
is left then, all members of different classes are compared, so no two documents that share a bucket stay untried: pair
by pair in buckets of up to PAIRED members; larger buckets are sorted by class and cut into blocks of BLOCK shingles, and
two blocks at a time are multiplied as 0-1 matrices, unless both hold one and the same class alone.
Classes are the connected components of the links, found by least-label steps in Spark. Equal texts are one
representative throughout.

Defined cases: null and empty texts are equal texts of no words, one class. In classes(), rows with one id are one row of
the result (the text of the least MD5 counts), and null ids are left out. keep_one() takes each row as a document of its
own: of a class it keeps the row of the least id (of several texts with that id, that of the least MD5; of equal rows of
id and text, one, and which of their other columns is left open); rows with a null id stay. Ties in ids are thus settled
by texts; an empty table gives an empty result; texts are whole, however long; other columns are not carried by classes()
and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BYTES, Rolling, mixed
from .common import cut, free_name, stored, text_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
ROUNDS = 2
PAIRED = 32
BLOCK = 200_000
LEAST = 800  # shingles that a document counts as at least: a block holds 250 documents at most
MEAN = 50  # Poisson numbers of a larger mean are sums
SLICE = 4096  # columns of a matrix at a time


def shingles(text: bytes) -> np.ndarray:
    """Hashes of a text's shingles, in order, with repeats."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    clean = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(clean == 32)
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return Rolling(BYTES[clean]).of(starts[: len(ends) - k + 1], ends[k - 1 :])


def level_counts(seed: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers by inversion at hashed uniform numbers (mean above MEAN: sums of Poisson numbers of smaller ones)."""
    if mean > MEAN:
        parts = int(np.ceil(mean / MEAN))
        return sum(level_counts(mixed(seed + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), mean / parts) for k in range(parts))
    u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    count, p, j = np.zeros(len(u), np.int64), np.exp(-mean), 0
    more, cdf = np.flatnonzero(u >= p), p
    while len(more):
        count[more] += 1
        j += 1
        p *= mean / j
        cdf += p
        more = more[u[more] >= cdf] if p > 0 else more[:0]
    return count


def dart_signatures(units: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """The names of the earliest darts, n x size, for n weighted sets given as hashed unit regions with their owners
    (ascending). Sets without units get zeros."""
    rank, name = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    total = np.bincount(owner, minlength=n)
    first = np.floor(np.log2(0.001 / np.maximum(total * size, 1)) / 2).astype(np.int64)
    done = total == 0
    level = int(first[~done].min()) if not done.all() else 0
    while not done.all():
        low, high = 4.0 ** (level - 1), 4.0**level
        at = np.flatnonzero((~done & (first <= level))[owner])
        if len(at):
            own = owner[at]
            seed = mixed(units[at] ^ BYTES[level % 256])
            count = level_counts(seed, (high - low) * size)
            region, own = np.repeat(seed, count), np.repeat(own, count)
            turn = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(region + np.uint64(0xBF58476D1CE4E5B9) * (turn + 1).astype(np.uint64))
            spot = own * size + (dart % np.uint64(size)).astype(np.int64)
            r = low + (high - low) * ((mixed(dart) >> np.uint64(11)).astype(np.float64) / 2.0**53)
            empty = ~np.isfinite(rank[spot])
            spot, r, dart = spot[empty], r[empty], dart[empty]
            order = np.argsort(-r, kind="stable")
            rank[spot[order]], name[spot[order]] = r[order], dart[order]
            done |= np.isfinite(rank.reshape(n, size)).all(axis=1)
        level += 1
    return name.reshape(n, size)


def set_units(h: np.ndarray) -> np.ndarray:
    """The unit regions of a text's shingles, one for each distinct one: similarities() judges the same set."""
    return mixed(np.unique(h))


def signer(bands: int, rows: int):
    """A mapInArrow function: (doc_id, h, text) to (doc_id, h, bands)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, hs, units):
            owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
            names = dart_signatures(np.concatenate(units), owner, len(units), bands * rows).reshape(len(units), bands, rows)
            key = np.zeros((len(units), bands), np.uint64)
            for k in range(rows):
                key = mixed(key + names[:, :, k])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs), pa.array(key.view(np.int64).tolist(), schema.types[2])], schema=schema)

        for batch in batches:
            ids, hs, units, size = [], [], [], 0
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                hs.append(h)
                units.append(set_units(shingles(t)))
                size += len(units[-1])
                if size > 150_000:
                    yield flush(ids, hs, units)
                    ids, hs, units, size = [], [], [], 0
            if ids:
                yield flush(ids, hs, units)

    return sign


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, the set of 64-bit shingle hashes, sorted)."""
    for batch in batches:
        sets = [np.unique(shingles(t)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "s"])


def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to (a, b, similarity)."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(len(p) + len(q) - both, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def block_links(similarity: float):
    """An applyInArrow function: the documents of two blocks (side 0 and 1) or of one (side 0 alone) with label and set
    to the pairs (a, b, similarity) of different labels and enough similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def link(table: pa.Table) -> pa.Table:
        side, rep, label = (np.array(table[c]) for c in ("side", "rep", "label"))
        sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
        size = np.array([len(x) for x in sets])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        _, slot, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        twice = count > 1  # what one document has alone is in no intersection
        owner = np.repeat(np.arange(len(sets)), size)[twice[slot]]
        slot = (np.cumsum(twice) - 1)[slot[twice[slot]]]
        order = np.argsort(slot, kind="stable")
        owner, slot = owner[order], slot[order]
        both = np.zeros((len(left), len(right)))
        for first in range(0, int(twice.sum()), SLICE):
            own = slice(*np.searchsorted(slot, [first, first + SLICE]))
            m = np.zeros((len(sets), SLICE), np.float32)
            m[owner[own], slot[own] - first] = 1
            both += m[left] @ m[right].T
        found = both / np.maximum(size[left][:, None] + size[right] - both, 1)
        x, y = np.nonzero((found >= similarity) & (label[left][:, None] != label[right]))
        a, b = rep[left[x]], rep[right[y]]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found[x, y])], schema=schema)

    return link


def compared_blocks(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, similarity) between the members (band, key, rep, label) of different labels of each bucket."""
    sized = large.join(sets.select(F.col("doc_id").alias("rep"), (F.length("s") / 8).alias("n")), "rep")
    so_far = Window.partitionBy("band", "key").orderBy("label", "rep").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(sized.select("band", "key", "rep", "label", F.floor(F.sum(F.greatest("n", F.lit(LEAST))).over(so_far) / BLOCK).alias("block")))
    blocks = placed.groupBy("band", "key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = blocks.select("band", "key", F.col("block").alias("i"), "lo"), blocks.select("band", "key", F.col("block").alias("j"), "hi")
    two = cut(left.join(right, ["band", "key"]).filter("i <= j AND lo <> hi").select("band", "key", "i", "j"))
    put = lambda side, at: placed.join(two.filter("i < j OR " + str(side == 0)), ["band", "key"]).filter(F.col("block") == F.col(at)).select("band", "key", "i", "j", F.lit(side).alias("side"), "rep", "label")
    rows = put(0, "i").union(put(1, "j")).join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep")
    return rows.groupBy("band", "key", "i", "j").applyInArrow(block_links(similarity), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node and label, the least node of its component."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", each_text: bool = False, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, broadcast_rows: int = 200_000, paired: int = PAIRED) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h: the text's MD5, n: how many), one for an id or (each_text) for an id and text, and the distinct texts: h,
    first (the least id), and label, which texts of a class share.

    Texts are read to sign them, and the texts of documents that meet in a bucket again to compare them. The names of the
    latter are broadcast up to broadcast_rows of them (counted first) and joined by shuffle beyond."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text")).filter("doc_id IS NOT NULL")
    signed = stored(plain.select("doc_id", F.md5("text").alias("h"), "text").mapInArrow(signer(bands, rows), "doc_id long, h string, bands array<long>"))
    ids = cut(signed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")) if each_text else signed.groupBy("doc_id").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")))
    repeated = not ids.filter("n > 1").isEmpty()
    reps = ids.groupBy("h").agg(F.min("doc_id").alias("first"))
    if each_text:  # a text whose least id has other texts too is named by its MD5, below all ids
        several = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
        own = F.conv(F.substring("h", 1, 15), 16, 10).cast("long") - F.lit((1 << 63) - 1)
        reps = reps.join(several.withColumnRenamed("doc_id", "first"), "first", "left").select("h", "first", F.when(F.col("texts").isNull(), F.col("first")).otherwise(own).alias("rep"))
    else:
        reps = reps.withColumn("rep", F.col("first"))
    reps = cut(reps)
    own = signed.join(reps.withColumnRenamed("first", "doc_id"), ["h", "doc_id"]).select("rep", "bands")
    spread = own.select("rep", F.posexplode("bands").alias("band", "key")).dropDuplicates(["rep", "band"])
    shared = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter("n > 1").drop("n")
    members = stored(spread.join(shared, ["band", "key"]))
    labels, links = None, None

    def labelled() -> DataFrame:
        """The members with their classes so far; after the first round without each bucket's first, compared with all."""
        if labels is None:
            return members.withColumn("label", F.col("rep"))
        return members.filter("rep <> first").join(labels, members["rep"] == labels["node"], "left").select("band", "key", "rep", F.coalesce("label", "rep").alias("label"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = wanted.withColumnRenamed("doc_id", "rep").join(reps, "rep").select(F.col("first").alias("doc_id"), "h", "rep")
        texts = plain.withColumn("h", F.md5("text")).join(F.broadcast(keys) if wanted.count() <= broadcast_rows else keys, ["doc_id", "h"])
        sets = texts.select(F.col("rep").alias("doc_id"), "text").mapInArrow(shingle_sets, "doc_id long, s binary")
        return stored(sets.dropDuplicates(["doc_id"]) if repeated else sets)  # joined as they are stored, so that a centre with many pairs can be split

    def scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        found = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(similarities, "a long, b long, similarity double")
        return found.filter(F.col("similarity") >= similarity)

    for turn in range(rounds):
        now = labelled()
        order = F.struct(F.col("rep").alias("o"), "rep", "label") if labels is None else F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), "rep", "label")
        centres = now.groupBy("band", "key").agg(F.min(order).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        pairs = now.join(centres, ["band", "key"]).filter("label <> c.label").select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"))
        pairs = cut(pairs.distinct())
        if pairs.isEmpty():
            break
        found = cut(scored(pairs, sets_of(cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))))
        links = found if links is None else links.union(found)
        labels = components(links)
    else:
        now = labelled()
        mixed_ones = now.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band", "key", "n")
        left = cut(now.join(mixed_ones, ["band", "key"]))
        if not left.isEmpty():
            sets = sets_of(cut(left.select(F.col("rep").alias("doc_id")).distinct()))
            small = left.filter(F.col("n") <= paired).select("band", "key", "rep", "label")
            other = small.select("band", "key", F.col("rep").alias("b"), F.col("label").alias("other"))
            pairs = cut(small.join(other, ["band", "key"]).filter("rep < b AND label <> other").select(F.col("rep").alias("a"), "b").distinct())
            found = [cut(scored(pairs, sets))]
            large = left.filter(F.col("n") > paired).select("band", "key", "rep", "label")
            if not large.isEmpty():
                found.append(cut(compared_blocks(large, sets, similarity)))
            if any(not x.isEmpty() for x in found):
                for x in found:
                    links = x if links is None else links.union(x)
                labels = components(links)
    if labels is None:
        return ids, reps.select("h", "first", F.col("rep").alias("label"))
    return ids, reps.join(labels, reps["rep"] == labels["node"], "left").select("h", "first", F.coalesce("label", "rep").alias("label"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per id: doc_id and class_id, the least id of its class. options: those of text_classes()."""
    ids, texts = text_classes(docs, doc_id, text, **options)
    return ids.join(texts, "h").select("doc_id", F.col("label").alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """docs with one row of each class, that of the least id. The rows that go are broadcast, by id and MD5, up to
    broadcast_rows of them (counted first) and joined by shuffle beyond."""
    ids, texts = text_classes(docs, doc_id, text, each_text=True, **options)
    i, h = free_name(docs, "id"), free_name(docs, "md5")
    stays = texts.groupBy("label").agg(F.min(F.struct("first", "h")).alias("k")).select(F.col("k.first").alias("doc_id"), F.col("k.h").alias("h"))
    gone = cut(ids.join(stays, ["doc_id", "h"], "left_anti").select(F.col("doc_id").alias(i), F.col("h").alias(h)))
    repeated = cut(ids.filter("n > 1").join(stays, ["doc_id", "h"], "left_semi").select(F.col("doc_id").alias(i), F.col("h").alias(h)))

    def same(other: DataFrame) -> tuple:
        few = other.count() <= broadcast_rows
        return F.broadcast(other) if few else other, (F.col(f"`{doc_id}`").cast("long") == F.col(i)) & (F.md5(text_of(F.col(f"`{text}`"))) == F.col(h))

    kept = docs.join(*same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    others, some = kept.join(*same(repeated), "left_anti"), kept.join(*same(repeated))
    return others.unionByName(some.dropDuplicates([i, h]).drop(i, h))
