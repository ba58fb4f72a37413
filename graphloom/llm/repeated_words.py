"""Operator 4, substring dedup over words with difference-cover anchors.

A window of `window` words repeats if its words also start anywhere else. Anchors are shorter windows, hashed only at
places of a document that lie in COVER modulo PERIOD. COVER is a difference cover: whatever the two places of a repeat,
some offset below PERIOD puts both into COVER, so a repeat shares an aligned anchor of window - PERIOD + 1 words. A block
sends the hashes of its anchors, and those that come again anywhere come back. Around the shared anchors the match is then
extended on the words themselves: the runs of windows that hold a shared anchor go, as texts, to buckets by their least
anchor hash (see blocks.py), where each window is looked up among all others, word for word. Hashes decide nothing.

Defined cases: null and empty texts have no words and keep their row; rows with equal ids are separate documents, so
repeated rows are each other's repeats; a null id is a document like others; ties cannot arise, as all copies of a window
go; an empty table gives an empty result; texts are whole, however long; other columns are not carried, so their names
clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BYTES, HOT, KEYS, MOST, OTHER, PIECE, ROW_DDL, Chosen, Rolling, Runs, Units, among, answered, beside, bucket_count, covered, dealt, exchanged, key_rows, on_blocks, packed, shared, sieve, told
from .common import stored

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Words(Units):
    """The words of a block. place: of each word in its document; bounds: first word of each document."""

    def __init__(self, row: dict):
        super().__init__(row)
        joined = np.zeros(len(self.raw) + len(self.lens), np.uint8)  # documents end with a space
        gap = np.zeros(len(joined), bool)
        gap[self.ends + np.arange(len(self.lens))] = True
        joined[~gap] = np.frombuffer(self.raw, np.uint8)
        joined[gap] = 32
        space = (joined == 32) | ((joined >= 9) & (joined <= 13))
        joined[space] = 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.concatenate([[0], edge]) if len(space) and not space[0] else edge
        self.start, self.stop = edge[::2], edge[1::2]
        self.hash = np.zeros(len(self.start), np.uint64)
        for a in range(0, len(joined), PIECE):  # words that start in a piece
            i, j = np.searchsorted(self.start, [a, a + PIECE])
            if i < j:
                first, last = int(self.start[i]), int(self.stop[j - 1])
                self.hash[i:j] = Rolling(BYTES[joined[first:last]]).of(self.start[i:j] - first, self.stop[i:j] - first)
        self.texts = (self.raw[a:b] for a, b in zip((self.ends - self.lens).tolist(), self.ends.tolist(), strict=True))
        self.doc = np.searchsorted(self.ends + np.arange(len(self.lens)), self.start, side="right").astype(np.int32)
        first = np.searchsorted(self.doc, np.arange(len(self.lens)))
        self.place = np.arange(len(self.start)) - first[self.doc]
        self.bounds = np.append(first, len(self.start))
        self.joined = joined.tobytes()

    def hashes(self, a: int, b: int) -> np.ndarray:
        return self.hash[a:b]

    def text(self, a: int, b: int) -> bytes:
        """The words from a to b, each with one space behind."""
        x = self.joined[self.start[a] : self.stop[b - 1]]
        return (b" ".join(x.split()) if b"  " in x else x) + b" "


def meet(window: int):
    """A function for a bucket: for each snippet the windows that come again anywhere."""

    def body(table: pa.Table) -> pa.Table:
        (_, windows, key, _, again), texts, sizes = told(table)
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        many = np.bincount(which, weights=1.0 + again) > 1
        n, least = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        n[which], least[which] = windows, key
        mask = ((1 << n) - 1) * many
        distinct = list(number)
        order = np.argsort(least, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(least[order])) + 1):  # equal windows have equal keys
            if len(some) == 1 and (many[some[0]] or n[some[0]] < 2):
                continue
            first: dict[bytes, tuple[int, int]] = {}
            for s in some.tolist():
                text = distinct[s]
                ends = [0, *(np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1).tolist()]
                for k in range(int(n[s])):
                    x = text[ends[k] : ends[k + window]]
                    if x in first:
                        mask[s] |= 1 << k
                        t, j = first[x]
                        mask[t] |= 1 << j
                    else:
                        first[x] = (s, k)
        return answered(table, sizes, mask[which].astype(np.uint32))

    return body


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: bool = True, hot: int = HOT) -> DataFrame:
    """Per document n_words, n_removed, the kept words joined by a space (keep), and their SHA-256."""
    if window < PERIOD + 3:
        raise ValueError(f"windows have {PERIOD + 3} words at least")
    anchor = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)
    blocks = packed(docs, doc_id, text)
    buckets = bucket_count(blocks)

    def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
        m = max(0, len(w.doc) - anchor + 1)
        at = np.flatnonzero((w.doc[:m] == w.doc[anchor - 1 : anchor - 1 + m]) & in_cover[w.place[:m] % PERIOD])
        return at, Rolling(w.hash).windows(anchor)[at]

    def send_anchors(row: dict) -> Iterator[pa.RecordBatch]:
        key = np.sort(dealt(anchors(Words(row))[1], buckets))
        weight = np.ones(len(key), np.int64)
        weight[1:][key[1:] == key[:-1]] |= 0x8000
        yield from key_rows(row["block"], OTHER, key, weight)

    def runs_of(row: dict) -> Runs:
        return Runs(Words(row), window, anchor)

    def send_keys(row: dict, back: list[dict]) -> Iterator[pa.RecordBatch]:
        if not back:
            return
        runs = Runs(Words(row), window, anchor, moving=True)
        at, h = anchors(runs.units)
        at = at[among(dealt(h, buckets), shared(back, OTHER)[0])[0]]
        hit = np.zeros(len(runs.units.doc) + PERIOD, bool)
        hit[at] = True
        near = np.append(0, np.cumsum(covered(hit[::-1], PERIOD)[::-1]))  # windows that hold a shared anchor start up to PERIOD - 1 before it
        some = np.flatnonzero(near[runs.lo + runs.n] > near[runs.lo])
        yield from key_rows(row["block"], KEYS, dealt(runs.hash[some], buckets), runs.key_weights(some, False))

    def remove(runs: Runs, chosen: Chosen, back: list[dict]) -> Iterator[pa.RecordBatch]:
        w, masks, at = runs.units, chosen.masks(back), 0
        starts = np.zeros(len(w.doc), bool)
        for r, members, head in chosen.sets:
            k = int(head.sum())
            mask = masks[at : at + k][np.cumsum(head) - 1]
            at += k
            for j in range(MOST):
                starts[r.lo[members[(mask >> np.uint32(j)) & np.uint32(1) == 1]] + j] = True
        kept_word = ~covered(starts, window)
        columns: list[list] = [[], [], [], [], []]
        for i, t in enumerate(w.texts):
            a, b = w.bounds[i], w.bounds[i + 1]
            n = int(kept_word[a:b].sum())
            kept = b" ".join(t.split() if n == b - a else compress(t.split(), kept_word[a:b].tolist()))
            for c, x in zip(columns, (w.ids[i], b - a, b - a - n, hashlib.sha256(kept).hexdigest(), kept.decode() if keep else None), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

    met = stored(sieve(on_blocks(blocks, send_anchors, ROW_DDL)))
    keys = stored(sieve(beside(blocks, met, send_keys, ROW_DDL), hot))
    out = exchanged(blocks, keys, runs_of, meet(window), remove, DDL, buckets, True, hot)
    return out if keep else out.drop("kept")
