"""Blocks of documents and exchanges between them, for the operators on repeated passages.

Documents are packed into blocks of a few MB in the order of the scan and written to the shared folder once. What blocks
have in common is found in three exchanges, each keyed by content and each with at most one row for a block and a bucket:

1. sieve(): a block sends the keys of its runs, 32 bits each within their bucket; those that count as shared come back.
   A run is up to MOST successive windows whose least part hash is the same; equal windows have equal keys. A key that
   more than `hot` different texts of runs have is marked hot.
2. Hot keys are split by the bytes around them: their runs are cut into groups of GROUP windows, whose key is the hash of
   all that these windows have in common, and are sieved again. So the texts that differ beside a very common passage,
   as many as there are documents, do not gather under one key.
3. snippets(): the texts of the runs that are left, each distinct one of a block once. A bucket compares them byte by byte
   and sends back 32 bits for each: which of its windows go.

Hashes only bring texts together; what is removed is decided on the texts. Rows grow with blocks times buckets, but
never past the number of keys: at 30 GB of Parquet 6 thousand blocks meet as many buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
PIECE = 1 << 20  # windows that are hashed at a time
MOST = 31
GROUP = 4
HOT = 4096

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("blob", pa.binary())])
BLOCK_DDL = "block long, ids array<long>, lens array<long>, blob binary"
#: What goes between blocks and buckets. kind: KEYS, SPLIT (keys of hot ones), MASKS, or a number of the operator's own.
ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary()), ("more", pa.binary()), ("text", pa.binary())])
ROW_DDL = "block long, kind int, bucket long, data binary, more binary, text binary"
KEYS, SPLIT, MASKS, OTHER = range(4)


def packed(docs: DataFrame, doc_id: str, text: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of docs: ids, UTF-8 lengths and the compressed texts; null text counts as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            nonlocal n, size, ids, texts
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) | n], pa.int64()), pa.array([ids], BLOCK.types[1]), pa.array([[len(t) for t in texts]], BLOCK.types[2]), pa.array([squeezed(b"".join(texts))], pa.binary())], schema=BLOCK)
            n, size, ids, texts = n + 1, 0, [], []
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= limit:
                    yield flush()
        if ids:
            yield flush()

    return stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(pack, BLOCK_DDL))


def bucket_count(blocks: DataFrame) -> int:
    """So many that a bucket gets the keys of BUCKET_BYTES of text; a few more where blocks are many and small."""
    n, size = blocks.select(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = min(n // 2, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(max(16, size // BUCKET_BYTES, few))


def squeezed(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def opened(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit numbers: a polynomial modulo 2**64 in prefix sums."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    up = down = np.ones(1, np.uint64)  # powers of the two, as far as they were needed

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling.up) <= n:
            Rolling.up, Rolling.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, PIECE + 64), x, np.uint64))) for x in (self.BASE, self.INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Rolling.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all ranges of length n."""
        m = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:-n]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)


#: A random number for each byte value.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """Which units lie in a window, from the marks of windows' starts (as long as the units)."""
    so_far = np.cumsum(starts, dtype=np.int32)
    out = so_far.copy()
    out[window:] -= so_far[:-window]
    return out > 0


def dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of hashes: the bucket in the upper 32 bits, 32 bits of the hash below."""
    return (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed steps, byte by byte."""
    return squeezed(np.ascontiguousarray(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _numbers(x: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(opened(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def rows_of(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)


def key_rows(block: int, kind: int, keys: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that bring a block's keys (with repeats, of the weights given) to their buckets. A weight is the number of
    different texts with the key, plus 1 << 15 if the key counts as shared by this block alone."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    own = np.bitwise_or.reduceat(weight, head) & 0x8000
    count = np.minimum(np.add.reduceat((weight & 0x7FFF).astype(np.int64), head), 0x7FFF)
    keys = keys[head]
    to = (keys >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(to, return_index=True)
    columns: list[list] = [[] for _ in ROW]
    for b, i, j in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        for c, x in zip(columns, (block, kind, b, _planes(keys[i:j].astype(np.uint32)), squeezed((own[i:j] | count[i:j]).astype("<u2")), None), strict=True):
            c.append(x)
    yield rows_of(columns)


def sieve(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Back to each block the keys it sent that are shared: marked, or sent by another block too. more: bits of the hot ones."""

    def meet(table: pa.Table) -> pa.Table:
        keys = [_numbers(x) for x in table["data"].to_pylist()]
        both, weight = np.concatenate(keys), np.concatenate([opened(x, "<u2") for x in table["more"].to_pylist()])
        order = np.argsort(both, kind="stable")
        ranked, w = both[order], weight[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size = np.diff(np.append(head, len(ranked)))
        yes = (size > 1) | (np.bitwise_or.reduceat(w, head) >= 0x8000)
        many = np.add.reduceat((w & 0x7FFF).astype(np.int64), head) > hot
        flags = np.empty(len(both), np.uint8)
        flags[order] = np.repeat(yes + 2 * many.astype(np.uint8), size)
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        columns: list[list] = [[] for _ in ROW]
        for block, kind, bucket, k, a, b in zip(*(table[c].to_pylist() for c in ("block", "kind", "bucket")), keys, ends[:-1], ends[1:], strict=True):
            f = flags[a:b]
            at = f & 1 == 1
            if at.any():
                for c, x in zip(columns, (block, kind, bucket, _planes(k[at]), np.packbits(f[at] > 1).tobytes() if (f[at] > 1).any() else None, None), strict=True):
                    c.append(x)
        return pa.Table.from_batches([rows_of(columns)])

    return rows.groupBy("bucket").applyInArrow(meet, ROW_DDL)


def shared(back: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that came back, ascending, and which of them are hot."""
    keys, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for row in sorted((r for r in back if r["kind"] == kind), key=lambda r: r["bucket"]):
        k = _numbers(row["data"]).astype(np.uint64) | np.uint64(row["bucket"] << 32)
        keys.append(k)
        hot.append(np.unpackbits(np.frombuffer(row["more"], np.uint8), count=len(k)).astype(bool) if row["more"] else np.zeros(len(k), bool))
    return np.concatenate(keys), np.concatenate(hot)


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the ascending known ones, and where (0 if not)."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


class Units:
    """What a block's windows are made of: bytes or words. ids and lens of its documents, the number of each unit's
    document, and hashes of units; text(a, b) is the text of the units a to b."""

    def __init__(self, row: dict):
        self.ids, self.lens, self.raw = row["ids"], np.array(row["lens"], np.int64), opened(row["blob"])
        self.ends = np.cumsum(self.lens)
        self.number = np.array([0 if i is None else i for i in self.ids], np.int64)
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.able = np.ones(len(self.lens), bool)  # documents that take part

    def hashes(self, a: int, b: int) -> np.ndarray:
        return BYTES[np.frombuffer(self.raw[a:b], np.uint8)]

    def text(self, a: int, b: int) -> bytes:
        return self.raw[a:b]


class Runs:
    """Runs of a block's windows: first window lo, their number n, key, name (a hash of the text), document, and (moving)
    whether the least part moves within the run, as it does where two of its windows are equal."""

    def __init__(self, units: Units, window: int, gram: int, moving: bool = False):
        self.units, self.window, self.gram, self.moving = units, window, gram, moving
        self._joined([self._piece(a, b, r) for a, b, r in self._pieces()])

    def _joined(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        kinds = (np.int64, np.int64, np.uint64, np.uint64, bool)
        self.lo, self.n, self.hash, self.name, self.moves = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(kinds))
        self.doc = self.units.doc[self.lo]

    def _place(self, gram: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where in the windows at start the part of hash key first is."""
        place = np.full(len(start), -1)
        for k in range(self.window - self.gram + 1):
            place[(place < 0) & (gram[start + k] == key)] = k
        return place

    def _pieces(self) -> Iterator[tuple[int, int, Rolling]]:
        m = len(self.units.doc) - self.window + 1
        for a in range(0, m, PIECE):
            b = min(a + PIECE, m)
            yield a, b, Rolling(self.units.hashes(a, b + self.window - 1))

    def _piece(self, a: int, b: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
        gram, width, rest = rolling.windows(self.gram), 1, self.window - self.gram + 1
        least = gram
        while 2 * width <= rest:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest > width:
            least = np.minimum(least[: width - rest], least[rest - width :])
        doc = self.units.doc
        start = a + np.flatnonzero((doc[a:b] == doc[a + self.window - 1 : b + self.window - 1]) & self.units.able[doc[a:b]])
        key, owner = least[start - a], doc[start]
        lo, n, key, name = self._cut(start, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]), key, a, rolling)
        if not self.moving:
            return lo, n, key, name, np.zeros(len(lo), bool)
        first, last = self._place(gram, key, lo - a), self._place(gram, key, lo - a + n - 1)
        return lo, n, key, name, last + n - 1 != first

    def _cut(self, start: np.ndarray, other: np.ndarray, key: np.ndarray, a: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
        """Runs of successive starts without a change in between, of MOST at most."""
        if not len(start):
            return start, start, key, key
        first = np.flatnonzero(np.concatenate([[True], other | (start[1:] != start[:-1] + 1)]))
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        first = np.flatnonzero(place % MOST == 0)
        lo, n = start[first], np.diff(np.append(first, len(start)))
        return lo, n, key[first], rolling.of(lo - a, lo - a + n + self.window - 1)

    def split(self, which: np.ndarray) -> Runs:
        """The runs named cut into groups of up to GROUP windows, keyed by all that a group's windows share."""
        out = object.__new__(Runs)
        out.units, out.window, out.gram = self.units, self.window, self.gram
        parts = []
        for a, b, rolling in self._pieces() if len(which) else ():
            own = which[(self.lo[which] >= a) & (self.lo[which] < b)]
            if not len(own):
                continue
            start, key = ragged(self.lo[own], self.n[own]), np.repeat(self.hash[own], self.n[own])
            core = start + self._place(rolling.windows(self.gram), key, start - a) % GROUP
            key = rolling.of(core - a, core - a + self.window - GROUP + 1)
            lo, n, key, name = self._cut(start, (core[1:] != core[:-1]) | (key[1:] != key[:-1]), key, a, rolling)
            parts.append((lo, n, key, name, np.zeros(len(lo), bool)))
        out._joined(parts)
        return out

    def texts(self, at: np.ndarray) -> list[bytes]:
        text, w = self.units.text, self.window - 1
        return [text(a, b) for a, b in zip(self.lo[at].tolist(), (self.lo[at] + self.n[at] + w).tolist(), strict=True)]

    def key_weights(self, at: np.ndarray, across: bool) -> np.ndarray:
        """Weights for key_rows() of the runs named: 1 for the first of each text, and the mark where a key comes again
        (across: in another document; else also within a run)."""
        order = np.lexsort((self.name[at], self.hash[at]))
        key, name, doc = self.hash[at][order], self.name[at][order], self.doc[at][order]
        new, fresh = np.ones(len(at), bool), np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[1:] = new[1:] | (name[1:] != name[:-1])
        weight = np.zeros(len(at), np.int64)
        weight[order] = fresh
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        if len(at):
            number = self.units.number[doc]
            again = np.minimum.reduceat(number, head) != np.maximum.reduceat(number, head) if across else (size > 1) | np.logical_or.reduceat(self.moves[at][order], head)
            weight[order[np.repeat(again, size)]] |= 0x8000
        return weight

    def groups(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs named, equal texts together and those of the least id first, and where each text begins. Texts of one
        name are compared."""
        at = at[np.lexsort((self.lo[at], self.units.number[self.doc[at]], self.name[at]))]
        head = np.ones(len(at), bool)
        head[1:] = self.name[at][1:] != self.name[at][:-1]
        again = np.flatnonzero(~head)
        differs = [x != y for x, y in zip(self.texts(at[again]), self.texts(at[again - 1]), strict=True)]
        head[again[np.array(differs, bool)]] = True
        return at, head


class Chosen:
    """The snippets of a block: what it sends, and what came back. Made the same way when sending and when removing."""

    def __init__(self, runs: Runs, back: list[dict], buckets: int):
        keys, hot = shared(back, KEYS)
        known, place = among(dealt(runs.hash, buckets), keys)
        is_hot = known & hot[place] if len(keys) else known
        parts = runs.split(np.flatnonzero(is_hot))
        sub, _ = among(dealt(parts.hash, buckets), shared(back, SPLIT)[0])
        self.sets = []  # (runs, at, head, keys of the heads)
        for r, at in ((runs, np.flatnonzero(known & ~is_hot)), (parts, np.flatnonzero(sub))):
            at, head = r.groups(at)
            self.sets.append((r, at, head))
        self.key = np.concatenate([dealt(r.hash[at[head]], buckets) for r, at, head in self.sets])
        self.order = np.argsort(self.key, kind="stable")

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Rows with the distinct texts for their buckets. more: length, windows, key, least id, and whether it comes again."""
        texts = [t for r, at, head in self.sets for t in r.texts(at[head])]
        n = np.concatenate([r.n[at[head]] for r, at, head in self.sets]).astype(np.int64)
        size = [np.diff(np.append(np.flatnonzero(head), len(at))) for r, at, head in self.sets]
        owner = np.concatenate([r.units.number[r.doc[at[head]]] for r, at, head in self.sets])
        again = (np.concatenate(size) > 1).astype(np.int64)
        key = self.key[self.order]
        full, first = np.unique(key >> np.uint64(32), return_index=True)
        columns: list[list] = [[] for _ in ROW]
        for b, i, j in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            own = self.order[i:j]
            some = [texts[k] for k in own.tolist()]
            told = np.stack([np.array([len(t) for t in some], np.int64), n[own], (key[i:j] & np.uint64(0xFFFFFFFF)).astype(np.int64), owner[own], again[own]])
            for c, x in zip(columns, (block, MASKS, b, None, squeezed(told), squeezed(b"".join(some))), strict=True):
                c.append(x)
        if len(full):
            yield rows_of(columns)

    def masks(self, back: list[dict]) -> np.ndarray:
        """Per snippet, in the order of the sets' heads, the bits that came back."""
        out = np.zeros(len(self.key), np.uint32)
        key = self.key[self.order]
        for row in (r for r in back if r["kind"] == MASKS):
            a, b = np.searchsorted(key, np.array([row["bucket"] << 32, (row["bucket"] + 1) << 32], np.uint64))
            out[self.order[a:b]] = opened(row["data"], np.uint32)
        return out


def told(table: pa.Table) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """What a bucket got: length, windows, key, owner and again of each snippet; the snippets; how many each row has."""
    parts = [opened(x, np.int64).reshape(5, -1) for x in table["more"].to_pylist()]
    texts = []
    for p, x in zip(parts, table["text"].to_pylist(), strict=True):
        raw, ends = opened(x), np.cumsum(p[0])
        texts += [raw[a:b] for a, b in zip((ends - p[0]).tolist(), ends.tolist(), strict=True)]
    return list(np.concatenate(parts, axis=1)), texts, [p.shape[1] for p in parts]


def answered(table: pa.Table, sizes: list[int], masks: np.ndarray) -> pa.Table:
    """The masks of the snippets, row by row; rows without a bit are left out."""
    ends = np.cumsum([0, *sizes]).tolist()
    columns: list[list] = [[] for _ in ROW]
    for block, bucket, a, b in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), ends[:-1], ends[1:], strict=True):
        if masks[a:b].any():
            for c, x in zip(columns, (block, MASKS, bucket, squeezed(masks[a:b].astype(np.uint32)), None, None), strict=True):
                c.append(x)
    return pa.Table.from_batches([rows_of(columns)])


def beside(blocks: DataFrame, back: DataFrame, body: Callable[[dict, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """body for each block with the rows that came back to it (none for many)."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, batches = right.to_pylist(), []
        for row in left.to_pylist():
            batches += body(row, rows)
        return pa.Table.from_batches(batches) if batches else NOTHING

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(each, schema)


NOTHING = pa.table({c.name: pa.array([], c.type) for c in ROW})


def on_blocks(blocks: DataFrame, body: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from body(batch.slice(i, 1).to_pylist()[0])

    return blocks.mapInArrow(each, schema)


def exchanged(blocks: DataFrame, keys: DataFrame, runs_of: Callable[[dict], Runs], meet: Callable[[pa.Table], pa.Table], remove: Callable[[Runs, Chosen, list[dict]], Iterator[pa.RecordBatch]], schema: str, buckets: int, alone: bool, hot: int = HOT) -> DataFrame:
    """Steps 2 and 3, from the keys that came back (stored). The blocks are dealt by number once: the three steps that
    read them share the exchange."""

    def send_split(row: dict, back: list[dict]) -> Iterator[pa.RecordBatch]:
        if any(r["more"] for r in back):
            runs = runs_of(row)
            known, hot_ones = shared(back, KEYS)
            yes, place = among(dealt(runs.hash, buckets), known)
            parts = runs.split(np.flatnonzero(yes & hot_ones[place]))
            every = np.arange(len(parts.lo))
            yield from key_rows(row["block"], SPLIT, dealt(parts.hash, buckets), parts.key_weights(every, not alone))

    def send(row: dict, back: list[dict]) -> Iterator[pa.RecordBatch]:
        if back:
            yield from Chosen(runs_of(row), back, buckets).rows(row["block"])

    def finish(row: dict, back: list[dict]) -> Iterator[pa.RecordBatch]:
        runs = runs_of(row)
        chosen = Chosen(runs, back, buckets)
        yield from remove(runs, chosen, back)

    split = sieve(beside(blocks, keys, send_split, ROW_DDL), 1 << 62)
    back = keys.unionByName(split)
    found = beside(blocks, back, send, ROW_DDL).groupBy("bucket").applyInArrow(meet, ROW_DDL)
    return beside(blocks, back.unionByName(found), finish, schema)
