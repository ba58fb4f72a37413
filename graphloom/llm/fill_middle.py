"""Operator 11, fill-in-middle: two cuts between the units of a text, and its parts in another order behind marks.

A unit is a run of white space with the word after it, or the white space at the end of the text. Every character has one
of four classes: whether it is white space, and whether the character before it is. A wavelet matrix over the classes of
many texts at once answers how many characters of a class stand before a place (rank): word starts and the class of the
last character add up to a text's units, and bisection on the ranks of "white space after a word" finds where a word
ends, which is where a cut falls. All texts of a slice are asked together, so nothing runs character by character.

Where the cuts fall, and the form, come from hashes of the id alone, so a document run again comes out the same.

Defined cases: null text counts as empty, and an empty text is plain, as is one that holds a mark; a null id hashes as the
empty string; rows are transformed one by one, so ties, repeated rows and repeated ids change nothing for each other;
an empty table gives an empty result; texts are whole, however long (a slice of SLICE characters at least one text);
further columns are carried, but those named like one of the new columns (NEW) give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
RATE, SPM, SEED = 50, 80, 42
#: Characters whose wavelet matrix is built at once.
SLICE = 1 << 22
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
WORD_START, WORD_END = 0b01, 0b10  # classes: this character is white space, the one before it is


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, the bits as words with their running counts; the
    symbols are then parted by that bit, zeros first, in order."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = ((symbols >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((b, words, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How many of the first `places` symbols are this one."""
        low, high = np.zeros(1, np.int64), places.astype(np.int64)
        for b, words, before, zeros in self.levels:
            ones = lambda p: before[p >> 6] + np.bitwise_count(words[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))  # noqa: B023, E731
            low, high = (zeros + ones(low), zeros + ones(high)) if symbol >> b & 1 else (low - ones(low), high - ones(high))
        return high - low

    def find(self, symbol: int, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the count-th (from 1) of this symbol, known to lie from low to before high: bisection on ranks."""
        low, high = low.copy(), high.copy()  # rank(low) < count <= rank(high)
        while np.any(high - low > 1):
            middle = (low + high) >> 1
            few = self.rank(symbol, middle) < count
            low, high = np.where(few, middle, low), np.where(few, high, middle)
        return low


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its units n, and the characters before the smaller and the larger of first % (n + 1) and second % (n + 1)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    begins, filled = ends - lengths, lengths > 0
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    after = np.concatenate([[True], space[:-1]]) if len(space) else space
    after[begins[filled]] = True
    tree = Wavelet(space.astype(np.uint8) << 1 | after, 2)
    trailing = np.zeros(len(texts), bool)
    trailing[filled] = space[ends[filled] - 1]
    n = tree.rank(WORD_START, ends) - tree.rank(WORD_START, begins) + trailing
    ended = tree.rank(WORD_END, begins)

    def place(units: np.ndarray) -> np.ndarray:
        out = np.where(units == n, lengths, 0)
        inner = (units > 0) & (units < n)
        out[inner] = tree.find(WORD_END, ended[inner] + units[inner], begins[inner], ends[inner]) - begins[inner]
        return out

    one, two = first % (n + 1), second % (n + 1)
    return n, place(np.minimum(one, two)), place(np.maximum(one, two))


def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    held, out, at = texts.tolist(), [], 0
    while at < len(held):
        to, size = at + 1, len(held[at])
        while to < len(held) and size + len(held[to]) <= SLICE:
            size, to = size + len(held[to]), to + 1
        out.append(np.stack(cuts(held[at:to], first.to_numpy()[at:to], second.to_numpy()[at:to]), axis=1))
        at = to
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3), np.int64), columns=["n", "a", "b"])


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made from, by its form: what stands between the marks, in the first order again."""
    p, s, m = marks
    after = lambda x, mark: F.substr(x, F.instr(x, mark) + len(mark))
    between = lambda x, a, b: F.substring_index(after(x, a), b, 1)
    psm = F.concat(between(output, p, s), after(output, m), between(output, s, m))
    spm = F.concat(between(output, p, m), after(output, m), between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: Sequence[str] = MARKS) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.

    rate: per cent of documents that are cut; spm: per cent of these whose suffix comes first. Texts go to Python once, to
    be cut; only the counts come back, and outputs are put together in the JVM."""
    own = text_of(F.col(f"`{text}`"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    hashed = docs.select(row, own.alias("t"), digest.alias("d")).select("row", "t", *[group(i) for i in range(4)])
    cut = hashed.withColumn("x", F.pandas_udf(_cuts, "struct<n:long,a:long,b:long>")("t", "h0", "h1"))
    held = F.lit(False)
    for mark in marks:
        held |= F.contains("t", F.lit(mark))
    plain = (F.col("t") == "") | held | (F.col("h2") % 100 >= rate)
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm"))
    part = lambda begin, end: F.substr(F.col("t"), (begin + 1).cast("int"), (end - begin).cast("int"))
    prefix, middle = part(F.lit(0), F.col("x.a")), part(F.col("x.a"), F.col("x.b"))
    suffix = F.substr(F.col("t"), (F.col("x.b") + 1).cast("int"))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    some = lambda x: F.when(F.col("form") != "plain", x)
    return formed.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in NEW],
        F.col("x.n").alias("n"), "form", some(F.col("x.a")).alias("prefix_chars"), some(F.col("x.b") - F.col("x.a")).alias("middle_chars"), output.alias("output"),
    )
