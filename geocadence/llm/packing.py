"""Bounded-space online packing of documents into token sequences of one length.

Each partition keeps a fixed number of open windows. A document longer than a sequence fills sequences
of its own with its leading ids; the rest goes whole to the window that it fits best. When none fits,
the fullest window is emitted, after the rest has filled it up if the gap is worth a cut. Windows still
open at the end of a partition are joined there, and the one or so that stays short is merged with those
of other partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .encode import encoder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, windows: int, least_gap: int):
        self.capacity, self.windows, self.least_gap = capacity, windows, least_gap
        self.space: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def _open(self, piece: tuple) -> None:
        self.held[self.next] = [piece]
        insort(self.space, (self.capacity - len(piece[2]), self.next))
        self.next += 1

    def _cut(self, piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids, n = piece
        return (doc, start, ids[:at], n), (doc, start + at, ids[at:], n)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Places one document; gives the sequences that are done."""
        rest = (doc_id, 0, ids, len(ids))
        while len(rest[2]) >= self.capacity:
            head, rest = self._cut(rest, self.capacity)
            yield [head]
        if not len(rest[2]):
            return
        i = bisect_left(self.space, (len(rest[2]), -1))
        if i < len(self.space):
            room, window = self.space.pop(i)
            self.held[window].append(rest)
            if room == len(rest[2]):
                yield self.held.pop(window)
            else:
                insort(self.space, (room - len(rest[2]), window))
            return
        if len(self.space) >= self.windows:
            room, window = self.space.pop(0)
            done = self.held.pop(window)
            if room >= self.least_gap:
                head, rest = self._cut(rest, room)
                done.append(head)
            yield done
        self._open(rest)

    def drain(self) -> Iterator[tuple[bool, list[tuple]]]:
        """(full, sequence) of the windows still open, joined by cutting; all but the last are full."""
        row, size = [], 0
        for _, window in self.space:
            for piece in self.held[window]:
                while size + len(piece[2]) >= self.capacity:
                    head, piece = self._cut(piece, self.capacity - size)
                    yield True, [*row, head]
                    row, size = [], 0
                if len(piece[2]):
                    row.append(piece)
                    size += len(piece[2])
        if row:
            yield False, row
        self.space, self.held = [], {}


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, windows: int, least_gap: int, cache: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    # In a pipeline the worker keeps the cache while other stages need the memory.
    enc, packer, rows = encoder(tokenizer, cache), Packer(capacity, windows, least_gap), []
    first = sequence = TaskContext.get().partitionId() << 32

    def put(pieces: list[tuple], sid: int) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sid, at))
            at += len(ids)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], _NAMES)
        rows.clear()
        return batch

    for batch in small_batches(batches, "text"):
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
            for pieces in packer.add(doc_id, np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))):
                put(pieces, sequence)
                sequence += 1
        if len(rows) >= 4096:
            yield flush()
    for full, pieces in packer.drain():
        put(pieces, sequence if full else -1 - first)
        sequence += full
    yield flush()


def _merge(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing of whole short windows; a window is the rows of one sequence_id."""
    size = group.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
    room: list[tuple[int, int]] = []
    base: dict[int, tuple[int, int]] = {}
    for window, n in size.items():
        i = bisect_left(room, (n, -(1 << 62)))
        if i < len(room):
            left, target = room.pop(i)
        else:
            left, target = capacity, window
        base[window] = (target, capacity - left)
        insort(room, (left - n, target))
    group = group.copy()
    group["offset"] += group["sequence_id"].map(lambda w: base[w][1])
    group["sequence_id"] = group["sequence_id"].map(lambda w: base[w][0])
    return group[_NAMES]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, windows: int = 32, least_gap: int = 8, merged: int = 1024, cache: int = 200_000) -> DataFrame:
    """Packs ``doc_id, text`` into sequences of at most ``capacity`` ids; one row per piece.

    Null texts count as empty: the end id alone. Repeated rows are packed each for itself, null doc_ids
    stay null, an empty table gives no rows, other columns are ignored. Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset; pieces lie in their sequence without gaps from 0. Merging
    takes the short windows of up to ``merged`` partitions at a time; theirs are negative sequence_ids. A Python worker caches the ids of about ``cache`` pieces of text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = staged(spark, docs.mapInArrow(partial(_pack, tokenizer=tokenizer, end_id=end_id, capacity=capacity, windows=windows, least_gap=least_gap, cache=cache), _PIECE), "packed")
    open_, done = placed.where("sequence_id < 0"), placed.where("sequence_id >= 0")
    group = F.floor((-1 - F.col("sequence_id")) / F.lit(float(merged * 2**32)))

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        return _merge(pieces, capacity)

    return done.unionByName(open_.groupBy(group.alias("g")).applyInPandas(merge, _PIECE))
