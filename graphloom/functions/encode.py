"""Offline encoders: hashed dense vectors and weighted sparse ones, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def dense(text: Column, dim: int = 32) -> Column:
    """The L2-normalized hashed bag of words of a text; an empty array for a blank one."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  body's value is computed once
    slots = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dim)))
    counted = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    scaled = lambda c: once(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.when(n > 0, F.transform(c, lambda x: F.round(x / n, 6))).otherwise(F.array().cast("array<double>")))
    return once(slots, lambda s: once(counted(s), scaled))


@lru_cache(maxsize=1 << 16)
def _hash(token: str) -> int:
    return int.from_bytes(md5(token.encode(), usedforsecurity=False).digest()[:4], "big")


def hashed(dim: int = 256, step: int = 256) -> Callable[[Column], Column]:
    """An encoder of texts: the L2-normalized counts of their tokens in dim hashed slots; an empty array where there is no
    token. It takes the place of a model, and any function of a column to an array of double can take its place. Tokens are
    found in the JVM; `step` texts are then counted at once, each different token of theirs hashed once, and a batch's
    vectors are held once."""

    @F.arrow_udf("array<double>")
    def counted(words: pa.Array) -> pa.Array:
        sizes, out = pc.list_value_length(words).to_numpy(), np.zeros((len(words), dim))
        for i in range(0, len(words), step):
            part, n, told = out[i : i + step], sizes[i : i + step], words.slice(i, step).flatten().dictionary_encode()
            if n.sum():
                slots = np.array([_hash(t) % dim for t in told.dictionary.to_pylist()])
                at = np.repeat(np.arange(len(n)) * dim, n)
                at += slots[told.indices.to_numpy()]
                part[:] = np.bincount(at, minlength=part.size).reshape(part.shape)
                part /= np.maximum(np.sqrt((part * part).sum(axis=1, keepdims=True)), 1.0)
        ends = np.cumsum(np.where(sizes > 0, dim, 0), dtype=np.int32)
        kept = out if (sizes > 0).all() else out[sizes > 0]
        return pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), pa.array(kept.reshape(-1)))

    return lambda text: counted(tokens(F.coalesce(text, F.lit(""))))


#: Texts whose tokens are counted at once.
COUNTED = 1024


def _counts(words: pa.Array) -> pa.Array:
    from graphloom.operators.rank import STOP_WORDS

    def some(part: pa.Array) -> pa.Array:
        told = part.flatten().dictionary_encode()
        order = pc.sort_indices(told.dictionary).to_numpy()
        terms = told.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        kept = ~pc.is_in(terms, value_set=pa.array(STOP_WORDS, terms.type)).to_numpy(zero_copy_only=False)
        term = place[told.indices.to_numpy()]
        key = (np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy()) * len(order) + term)[kept[term]]
        key.sort()  # equal tokens of a text stand together
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n, key = np.diff(first, append=len(key)).astype(np.int32), key[first]
        ends = np.searchsorted(key, np.arange(len(part) + 1) * len(order)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([terms.take(pa.array(key % max(1, len(order)))), pa.array(n)], ["t", "n"]))

    parts = [some(words.slice(i, COUNTED)) for i in range(0, len(words), COUNTED)]
    told = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32())])))
    del parts
    pa.default_memory_pool().release_unused()  # a worker waits with what it holds while other stages run
    return told


def counted(text: Column) -> Column:
    """The tokens of a text without the index's common words, each once with its count: an array of t and n, by t."""
    return F.arrow_udf(_counts, "array<struct<t:string,n:int>>")(tokens(F.coalesce(text, F.lit(""))))


def sparse(text: Column) -> Column:
    """Weights 1 + ln(count) by token, without the index's common words."""
    return F.map_from_entries(F.transform(counted(text), lambda x: F.struct(x["t"].alias("t"), (1 + F.log(x["n"].cast("double"))).alias("w"))))
