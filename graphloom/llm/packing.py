"""Operator 9, packing: bounded-space best-fit packing of token ids into sequences.

Each task keeps OPEN windows of `length` tokens. A document (its ids, then an end id) longer than a window gives full
windows first; its rest goes to the open window that it fills best. Where none fits, the fullest window is emitted and a
new one is opened; if the gap of the fullest would be more than `max_gap` tokens, the document is cut to fill it. The
windows that stay open at the end of the tasks are merged, some tasks' worth at a time: their pieces are cut to fill
windows exactly and the last window of a merge is cut into powers of two, so merging leaves no padding.

Defined cases: null text counts as empty (one piece, the end id); null or repeated ids and repeated rows are packed row by
row; among windows that fit equally well the oldest is filled; an empty table gives an empty result; texts are whole,
however long; the vocabulary's added tokens count as such inside texts; of further columns none is carried, so their
names clash with nothing. The finished windows' pieces and the
open windows' ids are written to the shared folder before merging, so a lost executor cannot change what was packed.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

LENGTH = 2048
OPEN = 32
MAX_GAP = 64
END = 1
MERGE = 32  # tasks whose open windows are merged together

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, for a byte-level vocabulary whose ids are its merge
    ranks. The file is the tokenizers library's; its ids come out the same from the faster merge code of tiktoken.

    added: whether the file's added tokens are recognised inside texts, as that library's encode() does unless its
    encode_special_tokens is set; without, they are plain characters."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, tokens = told["model"]["vocab"], told.get("added_tokens") or []
        if added and any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError(f"added tokens of {path} with single_word, lstrip or rstrip are not supported")
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if not (t.startswith("<|") and t.endswith("|>"))}
        self.marks = {t["content"]: t["id"] for t in tokens} if added else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")").split
        self.encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if not any(m in text for m in self.marks):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        parts = self.split(text)  # text and mark in turn
        ids = [x for i, part in enumerate(parts) for x in ([self.marks[part]] if i % 2 else self.encode(part))]
        return np.array(ids, dtype="<u4").tobytes()


class Rows:
    """Output rows in columns."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in PIECES]

    def add(self, doc, start, ids, total, sequence, offset, keep=False):
        row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids if keep else None)
        for c, x in zip(self.columns, row, strict=True):
            c.append(x)

    def __len__(self):
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, PIECES.types, strict=True)], schema=PIECES)
        self.columns = [[] for _ in PIECES]
        return out


def packer(path: str, length: int, space: int, max_gap: int, end: int):
    """A mapInArrow function: documents (doc_id, text) to pieces. A piece that stays in an open window keeps its ids
    and has the negative sequence -1 - its task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, task = Encoder(path, added=True), Rows(), TaskContext.get().partitionId()
        stop = np.array([end], dtype="<u4").tobytes()
        open_windows: list[tuple[int, list]] = []
        n = 0

        def emit(pieces):
            nonlocal n
            at = 0
            for doc, start, ids, total in pieces:
                out.add(doc, start, ids, total, (task << 32) | n, at)
                at += len(ids) // 4
            n += 1

        def place(doc, start, ids, total):
            size = len(ids) // 4
            best = max((i for i, (fill, _) in enumerate(open_windows) if fill + size <= length), key=lambda i: open_windows[i][0], default=None)
            if best is None and len(open_windows) >= space:
                fullest = max(range(len(open_windows)), key=lambda i: open_windows[i][0])
                fill, pieces = open_windows.pop(fullest)
                if length - fill > max_gap:
                    cut = 4 * (length - fill)
                    pieces.append((doc, start, ids[:cut], total))
                    ids, start = ids[cut:], start + length - fill
                    size = len(ids) // 4
                emit(pieces)
            if best is None:
                open_windows.append((size, [(doc, start, ids, total)]))
                return
            fill, pieces = open_windows[best]
            pieces.append((doc, start, ids, total))
            if fill + size == length:
                open_windows.pop(best)
                emit(pieces)
            else:
                open_windows[best] = (fill + size, pieces)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + stop
                total = len(ids) // 4
                whole = total // length * length
                for at in range(0, whole, length):
                    emit([(doc, at, ids[4 * at : 4 * (at + length)], total)])
                if total > whole:
                    place(doc, whole, ids[4 * whole :], total)
                if len(out) > 4096:
                    yield out.batch()
        for _, pieces in open_windows:
            for doc, start, ids, total in pieces:
                out.add(doc, start, ids, total, -1 - task, 0, keep=True)
        yield out.batch()

    return pack


def merger(length: int):
    """An applyInArrow function for the open pieces of a merge: cut to fill windows, the last one in powers of two."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        left = sum(table["length"].to_pylist())
        out, group, n = Rows(), -1 - table["sequence_id"][-1].as_py(), 0
        size = lambda left: length if left >= length else 1 << (left.bit_length() - 1)
        at, room = 0, size(left) if left else 0
        for doc, start, ids, total in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            while ids:
                part = ids[: 4 * (room - at)]
                out.add(doc, start, part, total, (1 << 62) | (group << 32) | n, at)
                ids, start, at, left = ids[len(part) :], start + len(part) // 4, at + len(part) // 4, left - len(part) // 4
                if at == room and left:
                    at, room, n = 0, size(left), n + 1
        return pa.Table.from_batches([out.batch()])

    return merge


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, space: int = OPEN, max_gap: int = MAX_GAP, end: int = END) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: its file's path on
    every executor. length must be a power of two."""
    placed = stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(packer(tokenizer, length, space, max_gap, end), DDL))
    merged = placed.filter("sequence_id < 0").groupBy(F.floor((-1 - F.col("sequence_id")) / MERGE).alias("g")).applyInArrow(merger(length), DDL)
    return placed.filter("sequence_id >= 0").drop("ids").unionByName(merged.drop("ids"))
