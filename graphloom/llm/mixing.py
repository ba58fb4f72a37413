"""Operator 6, mixing sources to target weights by Poisson replication.

A source's mean repetition rate is weight * size / rows of the source. Each document's number of copies is a Poisson
number with that mean, got by inverting the distribution at a uniform number that is hashed from seed and id, so a
rerun gives the same copies. Documents are exploded by their counts and shuffled globally by a hashed key.

Defined cases: a null source is a source of its own; a source without a weight gets no copies; rows with the same id
(repeated rows, or null ids) are seeded by id and text and so get equal counts if they are equal; null and empty texts
count as rows, and texts are kept whole; equal mix keys (of repeated rows) may come in any order; an empty table gives
an empty result; added columns are `copy` (from 0) and `mix_key`, for which other names can be given; other columns are
carried, but those of these two names give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: A mean above this is split into equal parts with a seed each; exp(-mean) must not vanish.
MOST_AT_ONCE = 256.0


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (52 bits) hashed from the parts."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The least n whose cumulated probability passes u, of a Poisson distribution whose mean is at most MOST_AT_ONCE."""
    last = (mean + 12.0 * F.sqrt(mean) + 20.0).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + (u >= acc["cdf"]).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])


def copies(mean: Column, *parts: Column) -> Column:
    """How often a document with that mean rate is taken."""
    pieces = F.greatest(F.ceil(mean / MOST_AT_ONCE).cast("int"), F.lit(1))
    return F.aggregate(
        F.sequence(F.lit(0), pieces - 1),
        F.lit(0),
        lambda a, i: a + poisson(mean / pieces, uniform(*parts, i)),
    )


def rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, size: float | None) -> DataFrame:
    """Per source key its mean rate. weights: share of the result by source, all equal if None; size: rows wanted,
    those of docs if None. The aggregate has a row per source and is joined by Spark's own choice."""
    counted = cut(docs.groupBy(source_key(source).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    n_sources, n_rows = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = float(n_rows if size is None else size)
    if weights is None:
        share: Column = F.lit(1.0 / max(n_sources, 1))
    else:
        whole = float(sum(weights.values())) or 1.0
        listed = [x for k, w in weights.items() for x in (F.lit("-" if k is None else f"={k}"), F.lit(w / whole))]
        share = F.coalesce(F.try_element_at(F.create_map(*listed), F.col("key")), F.lit(0.0)) if listed else F.lit(0.0)
    return counted.select("key", (share * total / F.col("n")).alias("rate"))


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("-"))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = 0,
    doc_id: str = "doc_id", source: str = "source", text: str = "text", broadcast_rows: int = 10_000, copy: str = "copy", mix_key: str = "mix_key",
) -> DataFrame:
    """docs, each row as many times as drawn, in a global random order, with the columns copy and mix_key (or of other names).

    The rates of up to broadcast_rows sources are broadcast (their number is counted first), more are joined by
    shuffle. Texts are shuffled once, by ranges of the hashed key, which no source or document can make uneven."""
    key, rate, n = (free_name(docs, x) for x in ("source", "rate", "n"))
    table = cut(rates(docs, source, weights, size)).select(F.col("key").alias(key), F.col("rate").alias(rate))
    few = table.count() <= broadcast_rows
    drawn = docs.withColumn(key, source_key(source)).join(F.broadcast(table) if few else table, key)
    id_ = F.col(f"`{doc_id}`")
    seeds = [F.lit(seed), id_, F.when(id_.isNull(), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))]
    drawn = drawn.withColumn(n, F.when(F.col(rate) > 0, copies(F.col(rate), *seeds)).otherwise(0)).filter(F.col(n) > 0)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (copy.lower(), mix_key.lower())]
    out = drawn.select(*kept, *[x.alias(f"{n}_{i}") for i, x in enumerate(seeds)], F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    seeds = [F.col(f"{n}_{i}") for i in range(len(seeds))]
    order = F.md5(F.concat_ws("|", F.lit("order"), *[F.coalesce(x.cast("string"), F.lit("-")) for x in seeds], F.col(copy)))
    return out.select(*kept, copy, order.alias(mix_key)).repartitionByRange(mix_key).sortWithinPartitions(mix_key)
