"""Lexical ranking, score normalization and rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens

K1, B = 1.5, 0.75
#: Common words that the index leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def total(x: Column) -> Column:
    """The sum of a group's numbers, the same in whatever order they come, so that texts of equal weights score alike: multiples
    of 2 ** -20 and, of what is left, of 2 ** -56 are summed apart, and below 2 ** 33 these sums are exact."""
    coarse = F.rint(x * 2.0**20) * 2.0**-20
    fine = F.rint((x - coarse) * 2.0**56) * 2.0**-56
    return F.sum(coarse) + F.nanvl(F.sum(fine), F.lit(0.0))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf, dl: counted within each document first, so no term gathers in one task."""
    words = F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(STOP_WORDS))
    each = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")).withColumn("dl", F.size("w").cast("long"))
    return each.select("doc_id", "dl", F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_docs and avgdl in one row."""
    words = F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(STOP_WORDS))
    return docs.select(F.size(words).cast("double").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, query: str, k: int = 5, least: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best documents for the query's terms. Only the query's terms are counted, inside each document's row, so
    the corpus is not shuffled; document frequencies and lengths are one aggregate row."""
    terms = [t for t in dict.fromkeys(w.lower() for w in query.split()) if t not in STOP_WORDS]
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).filter("false")
    words = F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(STOP_WORDS))
    counted = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")).select("doc_id", F.size("w").alias("dl"), *[F.size(F.filter("w", (lambda t: lambda x: x == t)(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    s = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]).first()
    if not s["n"]:
        return counted.select("doc_id", F.lit(0.0).alias("score")).filter("false")
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = s[f"df{i}"], F.col(f"tf{i}")
        score += F.log(F.lit(1 + (s["n"] - df + 0.5) / (df + 0.5))) * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(s["avgdl"] or 1.0)))
    return best(counted.select("doc_id", score.alias("score")), k).filter((F.col("score") > 0) & (F.col("score") >= least))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties to smaller ids, rounded to 6 digits only when they have been ranked (by 12 digits, as sums
    in another order may differ in the last ones). Filters come after, so that the expression of the score is not computed
    once more below the sort."""
    return scored.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "doc_id").limit(k).withColumn("score", F.round("score", 6))


def bm25_stored(index: dict, query: str, k: int = 5, least: float = 0.0) -> DataFrame:
    """As bm25(), from a stored index (sources.index.load_lexical): of the postings only the folders and pages of the query's
    terms are read. Document frequencies are sums over the blocks' heads, and the terms' blocks are summed by document."""
    from graphloom.sources.index import of_terms

    terms = [t for t in dict.fromkeys(w.lower() for w in query.split()) if t not in STOP_WORDS]
    rows = of_terms(index["postings"], terms)
    found = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row per term of the query
    idf = F.lit(0.0)
    for t, df in found.items():
        idf = F.when(F.col("term") == t, F.lit(math.log(1 + (index["n_docs"] - df + 0.5) / (df + 0.5)))).otherwise(idf)
    each = rows.select(idf.alias("idf"), F.explode("entries").alias("e"))
    return best(each.groupBy(F.col("e.doc_id").alias("doc_id")).agg(total(F.col("idf") * F.col("e.weight")).alias("score")), k).filter((F.col("score") > 0) & (F.col("score") >= least))


def sparse_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, term, weight: 1 + ln(tf)."""
    return postings(docs).select("doc_id", "term", F.round(1 + F.log(F.col("tf").cast("double")), 6).alias("weight"))


def sparse_search(docs: DataFrame, query: dict[str, float], k: int = 5) -> DataFrame:
    """The k documents of the largest dot product with the query's weights."""
    weight = F.element_at(F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))]), F.col("term"))
    hits = sparse_vectors(docs).filter(F.col("term").isin(list(query)))
    return best(hits.groupBy("doc_id").agg(total(weight * F.col("weight")).alias("score")), k)


def ranked(scored: DataFrame) -> DataFrame:
    """A short list (doc_id, score) with ranks from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def rrf(lists: list[DataFrame], k: int = 5, constant: float = 2.0, base: int = 0, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum over lists of weight / (constant + position), positions from base; at least one list."""
    if not lists:
        raise ValueError("rank fusion needs a list at least")
    out = None
    for i, one in enumerate(lists):
        part = ranked(one).select("doc_id", (F.lit((weights or [1.0] * len(lists))[i]) / (F.lit(constant) + F.col("rank") - 1 + base)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return best(out.groupBy("doc_id").agg(total(F.col("s")).alias("score")), k)


def strategy_of(name: str) -> Column:
    """A lexical score as the strategy bm25 (as it is), log or sqrt has it."""
    return {"log": F.log1p("score"), "sqrt": F.sqrt("score")}.get(name, F.col("score"))


def adaptive_rrf(lexical: DataFrame, dense: DataFrame, k: int = 5, constant: float = 60.0, least: float = 0.0, strategy: str = "bm25") -> DataFrame:
    """Fusion of two short lists whose constant grows with the longer one; with one list empty, the other's softmax. Scores
    below `least` go before the k best are taken. The lists are numbered and put together in one pass, so each search
    runs once."""
    lists = [lexical.withColumn("score", strategy_of(strategy)), dense]
    every = None
    for i, one in enumerate(lists):
        part = ranked(one).select(F.lit(i).alias("list"), "doc_id", "rank", normalized("softmax").alias("softmax"))
        every = part if every is None else every.unionByName(part)
    whole = Window.partitionBy(F.lit(0))
    sizes = [F.count(F.when(F.col("list") == i, 1)).over(whole) for i in range(2)]
    share = F.when(F.least(*sizes) == 0, F.col("softmax")).otherwise(0.5 / (F.lit(constant) * F.sqrt(F.greatest(*sizes)) + F.col("rank")))
    fused = every.withColumn("s", share).groupBy("doc_id").agg(F.sum("s").alias("score"))
    return best(fused.filter(F.col("score") >= least), k)


def normalized(method: str, score: str = "score") -> Column:
    """minmax, zscore, softmax, log or sqrt of a short list's scores; lists without spread give 1."""
    s, w = F.col(score).cast("double"), Window.partitionBy(F.lit(0))
    if method == "minmax":
        low, high = F.min(s).over(w), F.max(s).over(w)
        return F.when(high == low, 1.0).otherwise((s - low) / (high - low))
    if method == "zscore":
        sd = F.stddev_pop(s).over(w)
        return F.when(sd == 0, 1.0).otherwise((s - F.avg(s).over(w)) / sd)
    if method == "softmax":
        e = F.exp(s - F.max(s).over(w))
        return e / F.sum(e).over(w)
    return F.log1p(s) if method == "log" else F.sqrt(s)
