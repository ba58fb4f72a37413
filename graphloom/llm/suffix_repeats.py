"""Operator 10, suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

Equal strings of `length` bytes have the same minimizer (the least hash of their GRAM-byte parts), so the runs of strings
under one minimizer are dealt to buckets by it (see blocks.py: the sieve, the split of hot minimizers by the bytes
around them, and the exchange of snippets). A bucket sorts the suffixes of its distinct snippets, computes the common
prefixes of neighbours and scans them with a stack: each interval of the tree with a prefix of `length` or more whose
left extensions differ (or are unknown, at the start of a snippet), and each leaf that occurs several times, is a
maximal repeat with all its occurrences and its least document. A snippet gets back which of its strings lie in a repeat
whose least document is below its own; documents of its block with the same snippet and a larger id lose all of it.
Snippets have 80 bytes at most, so a longer repeat is a chain of overlapping ones. groups() gives the repeats themselves.

Defined cases: null and empty texts keep their row with nothing removed; a null id is neither smaller nor larger than
another, so such rows take no part and keep their text; rows with equal ids (repeated rows) remove nothing from each
other; ties cannot arise, as only smaller ids remove; an empty table gives an empty result; texts are whole, however
long; other columns are not carried, so their names clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTES, HOT, KEYS, MASKS, MOST, ROW_DDL, Chosen, Rolling, Runs, Units, answered, bucket_count, covered, dealt, exchanged, key_rows, on_blocks, opened, packed, ragged, sieve, squeezed, told
from .common import stored

LENGTH = 50
GRAM = 20
DEPTH = LENGTH + MOST - 1
PARTS = 32  # a bucket's suffix array is built in so many parts, by the key again, one after another

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def runs_of(row: dict) -> Runs:
    units = Units(row)
    units.able = np.array([i is not None for i in units.ids], bool)
    return Runs(units, LENGTH, GRAM)


def intervals(lcp: list[int], left: list[int], least: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """The maximal repeats of a stretch of the suffix array: (prefix, first, last, least document).

    lcp[i] is the common prefix of suffixes i and i + 1. The stack holds open intervals: prefix, first suffix, left
    extension (-1 once two differ or one is unknown), least document."""
    stack: list[list[int]] = []
    for i in range(len(left)):
        here = lcp[i - 1] if i else 0
        carry = None
        while stack and stack[-1][0] > here:
            top = stack.pop()
            if carry:
                top[2] = top[2] if top[2] == carry[2] else -1
                top[3] = min(top[3], carry[3])
            if top[0] >= length and top[2] < 0:
                yield top[0], top[1], i - 1, top[3]
            carry = top
        if i and here >= length:
            if stack and stack[-1][0] == here:
                if carry:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == carry[2] else -1
                    stack[-1][3] = min(stack[-1][3], carry[3])
            else:
                first = carry or [0, i - 1, left[i - 1], least[i - 1]]
                stack.append([here, first[1], first[2], first[3]])
        if stack:  # suffix i belongs to the top interval at least
            stack[-1][2] = stack[-1][2] if stack[-1][2] == left[i] else -1
            stack[-1][3] = min(stack[-1][3], least[i])
    carry = None
    while stack:
        top = stack.pop()
        if carry:
            top[2] = top[2] if top[2] == carry[2] else -1
            top[3] = min(top[3], carry[3])
        if top[0] >= length and top[2] < 0:
            yield top[0], top[1], len(left) - 1, top[3]
        carry = top


def repeats(texts: list[bytes], least: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeats of distinct snippets: (prefix, first, last, least document), each a column, and the suffix array
    (snippet and offset) that first and last point into. many: which snippets occur several times."""
    lens = np.array([len(t) for t in texts])
    raw = b"".join(texts)
    text = np.frombuffer(raw + bytes(DEPTH + 8), np.uint8)
    base = np.cumsum(lens) - lens
    count = lens - LENGTH + 1
    snippet = np.repeat(np.arange(len(lens)), count)
    offset = ragged(np.zeros(len(lens), np.int64), count)
    at = base[snippet] + offset
    once = Rolling(BYTES[text[: len(raw)]]).windows(LENGTH)[at]  # a suffix whose first bytes occur once is in no repeat
    order = np.argsort(once)
    same = once[order[1:]] == once[order[:-1]]
    keep = many[snippet] & (offset == 0)
    keep[order[1:][same]] = keep[order[:-1][same]] = True
    snippet, offset, at = snippet[keep], offset[keep], at[keep]
    room = lens[snippet] - offset

    def key(k: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(8):
            out = (out << np.uint64(8)) | np.where(room > k + j, text[np.minimum(at + k + j, len(text) - 1)], 0).astype(np.uint64)
        return out

    keys = [key(k) for k in range(0, DEPTH, 8)]
    order = np.lexsort(keys[::-1])
    snippet, offset, room, at = snippet[order], offset[order], room[order], at[order]
    lcp, open_ = np.zeros(max(0, len(order) - 1), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        x = k[1:] ^ k[:-1]
        lcp += np.where(open_, sum((x < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(8)), 0)
        open_ &= x == 0
    lcp = np.minimum(lcp, np.minimum(room[1:], room[:-1]))
    left = np.where(offset == 0, -1, text[np.maximum(at - 1, 0)].astype(np.int64))
    mins = least[snippet]
    leaf = np.flatnonzero(many[snippet] & (left < 0))
    joined = np.concatenate([[False], lcp >= LENGTH, [False]])
    begin, end = np.flatnonzero(joined[1:] & ~joined[:-1]), np.flatnonzero(~joined[1:] & joined[:-1])
    found: list[tuple[int, int, int, int]] = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        found += [(p, a + i, a + j, m) for p, i, j, m in intervals(lcp[a:b].tolist(), left[a : b + 1].tolist(), mins[a : b + 1].tolist(), LENGTH)]
    inner = np.array(found, np.int64).reshape(-1, 4)
    every = np.concatenate([inner, np.stack([room[leaf], leaf, leaf, mins[leaf]], axis=1)])
    return every, snippet, offset, room


def tree(table: pa.Table):
    """A bucket's snippets, each distinct text once, and per part the repeats among them."""
    (_, _, key, owner, again), texts, sizes = told(table)
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    low, many = np.full(len(number), np.iinfo(np.int64).max), np.bincount(which, weights=1 + again) > 1
    np.minimum.at(low, which, owner)
    part = np.zeros(len(number), np.int64)
    part[which] = key % PARTS
    distinct = list(number)

    def parts():
        for p in range(PARTS):
            own = np.flatnonzero(part == p)
            if len(own):
                yield own, repeats([distinct[i] for i in own.tolist()], low[own], many[own])

    return which, owner, low, np.array([len(t) for t in distinct], np.int64), sizes, parts()


def bits(n: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint64)


def meet(table: pa.Table) -> pa.Table:
    """A bucket: for each snippet the windows that lie in a repeat with a smaller document."""
    which, owner, low, lens, sizes, parts = tree(table)
    mask = np.zeros(len(low), np.uint64)  # for the snippet's least document; all of it for others
    whole = np.zeros(len(low), bool)
    for own, (every, snippet, offset, room) in parts:
        prefix, first, last, least = every.T
        leaf = (first == last) & (offset[first] == 0) & (prefix == room[first])
        whole[own[snippet[first[leaf]]]] = True
        at = np.repeat(np.arange(len(every)), last - first + 1)
        i = ragged(first, last - first + 1)
        s = own[snippet[i]]
        some = least[at] < low[s]
        s, o, n = s[some], offset[i[some]], prefix[at[some]] - LENGTH + 1
        np.bitwise_or.at(mask, s, bits(n) << o.astype(np.uint64))
    out = np.where((owner > low[which]) & whole[which], bits(lens - LENGTH + 1)[which], mask[which])
    return answered(table, sizes, out.astype(np.uint32))


def remover(keep: bool):
    def remove(runs: Runs, chosen: Chosen, back: list[dict]) -> Iterator[pa.RecordBatch]:
        units, masks, at = runs.units, chosen.masks(back), 0
        starts = np.zeros(len(units.raw), bool)
        for r, members, head in chosen.sets:
            k = int(head.sum())
            group = np.cumsum(head) - 1
            number = units.number[r.doc[members]]
            mask = np.where(number > number[head][group], bits(r.n[members]), masks[at : at + k].astype(np.uint64)[group]) if k else np.zeros(0, np.uint64)
            at += k
            for j in range(MOST):
                starts[r.lo[members[(mask >> np.uint64(j)) & np.uint64(1) == 1]] + j] = True
        gone = covered(starts, LENGTH)
        text = np.frombuffer(units.raw, np.uint8)
        columns: list[list] = [[] for _ in OUT]
        for d, (e, n) in enumerate(zip(units.ends.tolist(), units.lens.tolist(), strict=True)):
            g = gone[e - n : e]
            lost = int(g.sum())
            kept = text[e - n : e][~g].tobytes() if lost else units.raw[e - n : e]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if lost else 0
            for c, x in zip(columns, (units.ids[d], n, lost, spans, hashlib.sha256(kept).hexdigest(), kept if keep else None), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

    return remove


def _sifted(docs: DataFrame, doc_id: str, text: str, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """The blocks, the minimizers that two documents share, and the number of buckets."""
    blocks = packed(docs, doc_id, text)
    buckets = bucket_count(blocks)

    def send_keys(row: dict) -> Iterator[pa.RecordBatch]:
        runs = runs_of(row)
        yield from key_rows(row["block"], KEYS, dealt(runs.hash, buckets), runs.key_weights(np.arange(len(runs.lo)), True))

    return blocks, stored(sieve(on_blocks(blocks, send_keys, ROW_DDL), hot)), buckets


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True, hot: int = HOT) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, the kept bytes (keep) and their SHA-256."""
    blocks, keys, buckets = _sifted(docs, doc_id, text, hot)
    out = exchanged(blocks, keys, runs_of, meet, remover(keep), DDL, buckets, False, hot)
    return out if keep else out.drop("kept")


def list_groups(table: pa.Table) -> pa.Table:
    """A bucket: for each row of snippets its occurrences in repeats: repeat (bucket << 32 | number), snippet, offset, length."""
    which, _, _, _, sizes, parts = tree(table)
    bucket, found, n = table["bucket"][0].as_py(), [], 0
    for own, (every, snippet, offset, _) in parts:
        prefix, first, last, _ = every.T
        at, i = np.repeat(np.arange(len(every)), last - first + 1), ragged(first, last - first + 1)
        found.append(np.stack([own[snippet[i]], (bucket << 32) + n + at, offset[i], prefix[at]]))
        n += len(every)
    every = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    every = every[:, np.argsort(every[0], kind="stable")]
    bounds = np.searchsorted(every[0], np.arange(which.max(initial=0) + 2))
    ends, data = np.cumsum([0, *sizes]).tolist(), []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        k = bounds[which[a:b] + 1] - bounds[which[a:b]]
        data.append(squeezed(np.concatenate([np.repeat(np.arange(b - a), k)[None], every[1:, ragged(bounds[which[a:b]], k)]])))
    return table.select(["block", "kind", "bucket"]).append_column("data", pa.array(data, pa.binary())).append_column("more", pa.nulls(len(data), pa.binary())).append_column("text", pa.nulls(len(data), pa.binary()))


GROUPS = pa.schema([("repeat", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The maximal repeat groups with all occurrences: repeat (a group's number), length, doc_id, start (bytes). A group's
    rows come from many tasks, so no task holds all of a large one's. A repeat of more than 80 bytes is a chain of groups."""
    blocks, keys, buckets = _sifted(docs, doc_id, text, hot)

    def place(runs: Runs, chosen: Chosen, back: list[dict]) -> Iterator[pa.RecordBatch]:
        units, key = runs.units, chosen.key[chosen.order]
        heads = np.concatenate([np.flatnonzero(head) + n for (_, _, head), n in zip(chosen.sets, (0, len(chosen.sets[0][1])), strict=True)])
        lo = np.concatenate([r.lo[at] for r, at, _ in chosen.sets])
        size = np.diff(np.append(heads, len(lo)))
        columns = [np.zeros(0, np.int64)] * 4
        for r in (r for r in back if r["kind"] == MASKS):
            snippet, repeat, offset, length = opened(r["data"], np.int64).reshape(4, -1)
            snippet = chosen.order[np.searchsorted(key, np.uint64(r["bucket"] << 32)) + snippet]
            n = size[snippet]
            at = lo[ragged(heads[snippet], n)] + np.repeat(offset, n)
            doc = units.doc[at]
            for c, x in enumerate((np.repeat(repeat, n), np.repeat(length, n), units.number[doc], at - (units.ends - units.lens)[doc])):
                columns[c] = np.concatenate([columns[c], x])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=GROUPS)

    return exchanged(blocks, keys, runs_of, list_groups, place, "repeat long, length long, doc_id long, start long", buckets, False, hot)
