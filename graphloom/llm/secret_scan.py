"""Operator 2, secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Base spans come from three patterns. The method adds `random` spans: runs of token characters, whose encoding (hex,
base32, alphanumeric, base64) is inferred from the characters they hold. Under that encoding's alphabet a token is tested
for randomness: chi-squared uniformity, a runs test (codes of the lower against the upper half of the alphabet) and a
lag-one serial correlation, as z scores, whose largest gives the battery's p-value (three times the normal tail's bound).
Length classes are powers of two. In each, over the whole corpus, a Benjamini-Hochberg step on the battery's p-values
says which tokens are not random: these are the class's ordinary text, and from them the rate is estimated at which text
changes between small letters, capitals, digits and marks. The tokens that the battery leaves get the binomial tail bound
of their own number of changes at that rate as the p-value of being text, and a second Benjamini-Hochberg step reports
those that are not. p-values are rounded up to a grid, so the steps work on tables of counts of bounded size.
A random token of one kind of characters alone has no change and cannot be told from a word, so it is not reported.

Defined cases: spans count code points, the end excluded. Null text counts as empty; rows are scanned one by one (repeated
rows and ids each give their row); ties between spans go by start, then in the order of the kinds; an empty table gives
an empty result; texts are scanned whole, in time that grows little more than with their length and matches; other
columns are carried, but those named like a new column (spans) give way to it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, let, stored, text_of

#: Kind, pattern, group whose length counts, least length; in this order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters or more
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings, narrowest first: name, what a token of it looks like, its characters in order.
DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", CAPITAL + "234567"),
    ("small36", "^[a-z0-9]+$", DIGITS + SMALL),
    ("capital36", "^[A-Z0-9]+$", DIGITS + CAPITAL),
    ("alnum62", "^[A-Za-z0-9]+$", DIGITS + CAPITAL + SMALL),
    ("base64", "", CAPITAL + SMALL + DIGITS + "+/-_"),
)
TEXT_CHANGE_RATE, PRIOR = 0.1, 200.0  # the text's rate of changes before any token was seen, and how many places it counts for
LEAST_RATE, MOST_RATE = 0.01, 0.5
FDR_TEXT = 0.01  # among the tokens taken for text, at most so many random ones
FDR = 1e-3  # among those reported, at most so much text
GRID = 4  # steps of -log2 p
MAX_BIN = 4096
SLICE = 256


def laid(steps: Column) -> Column:
    """Structs gap, len, v to s, e, v: each begins a gap after the one before. In parts of SLICE, whose arrays grow one by
    one, and which are then shifted; a text's matches thus cost little more than their number."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        return F.struct((s + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["len"]).alias("e"), x["v"].alias("v")))).alias("out"))

    def shifted(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(parts, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = lambda o: lambda y: F.struct((y["s"] + o).alias("s"), (y["e"] + o).alias("e"), y["v"].alias("v"))
        return F.flatten(F.zip_with(parts, offsets, lambda x, o: F.transform(x["out"], moved(o))))

    parts = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / SLICE).cast("int")), lambda j: F.aggregate(F.slice(steps, j * SLICE + 1, F.lit(SLICE)), start, step))
    return F.when(F.size(steps) > 0, let(parts, shifted)).otherwise(start["out"])


def located(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches of the pattern, short ones dropped: structs s, k, e, kind, v in order."""

    def place(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        steps = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda gap, f: F.struct(F.length(gap).alias("gap"), F.length(f["m"]).alias("len"), f["v"].alias("v")))
        placed = let(steps, laid)
        return F.transform(
            F.filter(placed, lambda x: F.length(x["v"]) >= least),
            lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,kind:string,v:string>>"))


def encoding_of(token: Column) -> Column:
    """The alphabet of the narrowest encoding that the token fits."""
    out = F.lit(ENCODINGS[-1][2])
    for _, pattern, alphabet in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def changes(token: Column) -> Column:
    """How often a token goes from small letters, capitals, digits or marks to another of these."""
    return F.length(F.regexp_replace(token, "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+", "x")) - 1


def text_bin(n: Column, t: Column, q: Column) -> Column:
    """floor(GRID * -log2 p) of the tail bound for t or more changes in a token of length n of text that changes at rate q."""
    rate = t / (n - 1)
    kl = rate * F.ln(rate / q) + F.when(rate < 1, (1 - rate) * F.ln((1 - rate) / (1 - q))).otherwise(0.0)
    return F.when(rate > q, F.least(F.lit(MAX_BIN), F.floor((n - 1) * kl * (GRID / math.log(2))).cast("int"))).otherwise(0)


def battery(codes: Column, m: Column) -> Column:
    """The largest z score, without sign, of codes (1 to m) in the chi-squared, runs and serial-correlation tests; 99 where
    a test cannot be made, as the codes do not vary."""
    n = F.size(codes).cast("double")
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)))
    chi = squares * m / n - n
    spread = 2.0 / (9.0 * (m - 1))
    z_chi = (F.pow(chi / (m - 1), F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread)
    low = F.size(F.filter(codes, lambda x: 2 * x <= m)).cast("double")
    runs = 1.0 + F.size(F.filter(codes, lambda x, i: (i > 0) & ((2 * x <= m) != (2 * F.get(codes, i - 1) <= m)))).cast("double")
    expected = 2.0 * low * (n - low) / n
    z_runs = F.when((low > 0) & (low < n), (runs - expected - 1.0) / F.sqrt(F.greatest(expected * (expected - 1.0) / (n - 1.0), F.lit(1e-9)))).otherwise(F.lit(99.0))

    def serial(mean: Column) -> Column:
        own = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lagged = F.aggregate(F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, x: a + x)
        return F.when(own > 0, lagged / own * F.sqrt(n)).otherwise(F.lit(99.0))

    z_serial = let(F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n, serial)
    return F.greatest(F.abs(z_chi), F.abs(z_runs), F.abs(z_serial))


def random_bin(z: Column) -> Column:
    """floor(GRID * -log2 p) of the battery's p-value 3 * 2 * exp(-z * z / 2)."""
    return F.least(F.lit(MAX_BIN), F.floor(F.greatest(F.lit(0.0), (z * z / 2.0 - math.log(6.0)) * (GRID / math.log(2)))).cast("int"))


def token_facts(token: Column) -> Column:
    """n (length without padding), t (changes) and z (random_bin under the inferred encoding) of a token."""

    def judged(body: Column) -> Column:
        z = let(encoding_of(token), lambda a: let(F.transform(F.split(body, ""), lambda c: F.instr(a, c).cast("double")), lambda x: battery(x, F.length(a).cast("double"))))
        return F.struct(F.length(body).alias("n"), changes(body).alias("t"), F.when(F.length(body) >= 20, random_bin(z)).otherwise(MAX_BIN).alias("z"))

    return let(F.regexp_replace(token, "=+$", ""), judged)


def scanned(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the column out: structs base (spans of KINDS by start and kind) and tokens (s, e, length class c,
    and f: n, t and z of token_facts)."""
    t = text_of(F.col(f"`{text}`"))
    base = F.array_sort(F.concat(*[located(t, p, g, least, kind, k) for k, (kind, p, g, least) in enumerate(KINDS)]))
    tokens = F.transform(
        located(t, TOKEN, 0, 20, "random", len(KINDS)),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.floor(F.log2(F.length(x["v"]).cast("double"))).cast("int").alias("c"), token_facts(x["v"]).alias("f")),
    )
    return docs.withColumn(out, F.struct(base.alias("base"), tokens.alias("tokens")))


def passing(counts: DataFrame, bin_: str, fdr: float) -> DataFrame:
    """Per length class c the least bin that Benjamini-Hochberg lets pass, of counts n by c and bin; m: all tokens of c."""
    by_class = Window.partitionBy("c").orderBy(F.desc(bin_))
    ranked = counts.withColumn("r", F.sum("n").over(by_class))
    # 2^(-bin / GRID) <= fdr * r / m
    ok = (F.col(bin_) > 0) & (F.pow(F.lit(2.0), F.col(bin_) / F.lit(-float(GRID))) <= fdr * F.col("r") / F.col("m"))
    return ranked.filter(ok).groupBy("c").agg(F.min(bin_).alias("bar"))


def thresholds(found: DataFrame, column: str) -> dict[int, tuple[int, float, int]]:
    """Per length class: from which z bin on a token is text, the text's rate of changes, and from which bin on a token that
    is not text is reported. Two passes over the table of tokens; its counts have a row per class and bin (at most 32 x
    MAX_BIN), of which the driver gets a row per class."""
    tokens = found.select(F.explode(f"{column}.tokens").alias("t")).select("t.c", "t.f.*")
    by_class = Window.partitionBy("c")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("t").cast("double").alias("changes"), F.sum(F.col("n") - 1).cast("double").alias("places")]
    counts = cut(tokens.groupBy("c", "z").agg(*sums).withColumn("m", F.sum("n").over(by_class)))
    bars = {r.c: r.bar for r in passing(counts, "z", FDR_TEXT).collect()}
    is_text = F.col("z") >= chosen(F.col("c"), bars, MAX_BIN + 1)
    rate = (F.sum(F.when(is_text, F.col("changes")).otherwise(0.0)) + TEXT_CHANGE_RATE * PRIOR) / (F.sum(F.when(is_text, F.col("places")).otherwise(0.0)) + PRIOR)
    told = counts.groupBy("c").agg(F.max("m").alias("m"), F.round(F.greatest(F.least(rate, F.lit(MOST_RATE)), F.lit(LEAST_RATE)), 6).alias("q")).collect()
    rates, sizes = {r.c: r.q for r in told}, {r.c: r.m for r in told}
    left = tokens.filter(~is_text).withColumn("b", text_bin(F.col("n"), F.col("t"), chosen(F.col("c"), rates, TEXT_CHANGE_RATE)))
    reported = left.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("m", chosen(F.col("c"), sizes, 0))
    least = {r.c: r.bar for r in passing(reported, "b", FDR).collect()}
    return {int(c): (int(bars.get(c, MAX_BIN + 1)), float(q), int(least.get(c, MAX_BIN + 1))) for c, q in rates.items()}


def chosen(c: Column, values: dict, other: float) -> Column:
    return reduce(lambda out, x: F.when(c == x[0], F.lit(x[1])).otherwise(out), sorted(values.items()), F.lit(other))


def all_spans(column: str, bars: dict[int, tuple[int, float, int]]) -> Column:
    """Base spans and the tokens that pass the bars and touch no base span, by start and kind: structs s, k, e, kind."""
    base = F.transform(F.col(f"{column}.base"), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    text, rate, least = ({c: x[i] for c, x in bars.items()} for i in range(3))
    random = lambda t: (t["f"]["z"] < chosen(t["c"], text, 0)) & (text_bin(t["f"]["n"], t["f"]["t"], chosen(t["c"], rate, TEXT_CHANGE_RATE)) >= chosen(t["c"], least, MAX_BIN + 1))
    free = lambda t: ~F.exists(F.col(f"{column}.base"), lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"]))
    added = F.transform(
        F.filter(F.col(f"{column}.tokens"), lambda t: random(t) & free(t)),
        lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).alias("k"), t["e"].alias("e"), F.lit("random").alias("kind")),
    )
    return F.array_sort(F.concat(base, added))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with `spans` (structs s, k, e, kind). Texts are scanned once; what was found is kept in
    the shared folder while the bars are set."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "spans")]
    carried = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("text"))
    own = free_name(docs, "found")
    found = stored(scanned(carried, "text", own).drop("text"))
    bars = thresholds(found, own)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], all_spans(own, bars).alias("spans"))


def marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of spans that overlap replaced by the mark. Pieces are cut from its array of characters."""

    def replaced(chars: Column, own: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            piece = F.array(F.array_join(F.slice(chars, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), ""), F.lit(mark))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(own, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.array_join(F.slice(chars, acc["at"] + 1, F.size(chars)), "")))

    return let(F.split(text, ""), lambda chars: replaced(chars, spans))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mark (spans that overlap: by one); null texts stay null. Texts are
    scanned once: what was found is stored beside them, and read again once the bars are set; texts are not shuffled."""
    c = free_name(docs, "found")
    found = stored(scanned(docs, text, c))
    spans = all_spans(c, thresholds(found.select(c), c))
    own = free_name(docs, "spans")
    return found.withColumn(own, spans).withColumn(text, F.when(F.size(own) > 0, marked(text_of(F.col(f"`{text}`")), F.col(own), mark)).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{x}`") for x in docs.columns])
