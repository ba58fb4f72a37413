"""Operator 7, quality rules: document rules, then host-level verdicts with an empirical beta prior.

Base rules look at one document. Host rules add up the documents of each host (`source`) that fail any rule, shrink
the host's failure rate towards the corpus with a beta prior fitted to all hosts by the method of moments, and reject
a host whose shrunk rate passes `max_rate`. In a rejected host only documents without any failed rule are kept.

Defined cases: null text counts as empty (it fails n_words < 10); a null host is a host of its own; documents are
judged row by row, so repeated rows and repeated ids each get their own row; a host at max_rate exactly is kept; an empty
table gives an empty result; texts are whole, however long; further columns are carried by judge(), but those named like
one of its new columns (NEW) give way to it; reject() keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, let, stored, text_of, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Further rules, counted for hosts only: share of symbols and of repeated lines, and the mean length of words.
SOFT_SYMBOL_PERCENT = 10
SOFT_DUP_LINE_PERCENT = 30
SOFT_WORD_CHARS = (2, 15)
MAX_HOST_RATE = 0.5
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "host_rate", "kept")


def repeated_words(words: Column) -> Column:
    """How many words lie in a WINDOW-word window that occurs twice or more in the array (the first one included)."""

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(t: Column) -> Column:
            twice = F.filter(t, lambda x, k: (F.get(t, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(t, k - 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return let(let(tagged, positions), total)

    def windows(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.size(h) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
        )

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), count))


def measures(text: Column) -> Column:
    """A struct with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text."""

    def all_of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), all_of)


def host_key(host: str) -> Column:
    """The host as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`")), F.lit(""))


def failed(m: str) -> tuple[Column, Column]:
    """Whether the measures in struct column m break a base rule, and whether they break a further one."""
    n, chars = F.col(f"{m}.n_words"), F.col(f"{m}.word_chars")
    base = (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    soft = (
        (100 * F.col(f"{m}.n_symbols") > SOFT_SYMBOL_PERCENT * chars)
        | (100 * F.col(f"{m}.lines.dup") > SOFT_DUP_LINE_PERCENT * F.col(f"{m}.lines.n"))
        | (chars < SOFT_WORD_CHARS[0] * n)
        | (chars > SOFT_WORD_CHARS[1] * n)
    )
    return base, soft


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta of a beta prior for the hosts' failure rates: the mean is the corpus's, the precision follows
    from the weighted variance between hosts. One row reaches the driver."""
    n, bad, squares = (float(x or 0) for x in hosts.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first())
    if not n or bad in (0.0, n):
        return 0.5, 0.5
    mean = bad / n
    variance = max(squares / n - mean * mean, 1e-9)
    precision = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e4)
    return mean * precision, (1 - mean) * precision


def host_rates(rated: DataFrame, key: str, any_failed: Column) -> DataFrame:
    """Per host key the failure rate, shrunk towards the corpus: columns key and rate."""
    hosts = cut(rated.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(any_failed.cast("long")).alias("bad")))
    alpha, beta = beta_prior(hosts)
    return hosts.select(key, ((F.col("bad") + alpha) / (F.col("n") + (alpha + beta))).alias("rate"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without its text, and per row: the measures, base_failed, soft_failed, host_rate (shrunk) and kept.

    One pass over the texts; what follows works on a row of numbers per document. The host table is aggregated with
    partial sums and joined by Spark's own choice, so one large host is split like any skewed join."""
    rest = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in NEW]
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    rated = docs.select(*carried, host_key(host).alias("host"), measures(text_of(F.col(f"`{text}`"))).alias("m"))
    base, soft = failed("m")
    rated = cut(rated.select("*", base.alias("base"), soft.alias("soft")))
    hosts = host_rates(rated, "host", F.col("base") | F.col("soft"))
    return rated.join(hosts, "host").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        F.col("base").alias("base_failed"),
        F.col("soft").alias("soft_failed"),
        F.round("rate", 6).alias("host_rate"),
        (~F.col("base") & ~(F.col("soft") & (F.col("rate") > max_rate))).alias("kept"),
    )


def reject(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, broadcast_rows: int = 100_000) -> DataFrame:
    """The kept rows of docs, with docs' columns. Texts are measured once; rows are stored with what they
    failed, so that no text is shuffled: rejected hosts are broadcast where they are at most broadcast_rows, and
    joined by shuffle beyond."""
    m, key, b, s = (free_name(docs, x) for x in ("m", "host", "base", "soft"))
    base, soft = failed(m)
    measured = docs.withColumns({key: host_key(host), m: measures(text_of(F.col(f"`{text}`")))}).withColumns({b: base, s: soft}).drop(m)
    rated = stored(measured)
    rates = host_rates(rated.select(key, (F.col(b) | F.col(s)).alias("bad_row")), key, F.col("bad_row"))
    rejected = cut(rates.filter(F.col("rate") > max_rate).select(F.col(key).alias(f"{key}_r")))
    few = rejected.count() <= broadcast_rows
    return rated.filter(~F.col(b)).join(F.broadcast(rejected) if few else rejected, F.col(s) & (F.col(key) == F.col(f"{key}_r")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
