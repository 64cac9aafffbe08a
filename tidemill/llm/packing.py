"""Bounded-space online packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import materialize, slices, texts_of, to_batch

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary(), "packer": pa.int64()}
#: Sequences that the merge of leftovers makes have this bit in their id.
_MERGED = 1 << 62


def token_ids(text: str, tokenizer_path: str, end_id: int) -> np.ndarray:
    """A document's ids: those of its text, then end_id."""
    return np.append(encoder(tokenizer_path)(text), np.uint32(end_id)).astype("<u4")


class _Window:
    def __init__(self) -> None:
        self.used, self.pieces = 0, []


class Packer:
    """A fixed number of open windows; a closed one comes out as rows (sequence number, offset, piece).

    A piece is (doc_id, start, ids, doc_tokens). Stretches of whole windows leave at once; a rest goes to the open
    window that it fits best. If none fits while all places are taken, the fullest leaves: as it is if at most
    `slack` ids of it are empty, else filled with the head of the rest.
    """

    def __init__(self, size: int, windows: int, slack: int):
        self.size, self.windows, self.slack = size, windows, slack
        self.room: list[tuple[int, int]] = []  # (room, serial) of open windows, in order
        self.open: dict[int, _Window] = {}
        self.serial = self.closed = 0

    def _close(self, window: _Window) -> Iterator[tuple]:
        at = 0
        for piece in window.pieces:
            yield self.closed, at, piece
            at += len(piece[2])
        self.closed += 1

    def _put(self, window: _Window, piece: tuple) -> None:
        window.pieces.append(piece)
        window.used += len(piece[2])

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[tuple]:
        while len(ids) >= self.size:
            whole = _Window()
            self._put(whole, (doc_id, start, ids[: self.size], doc_tokens))
            yield from self._close(whole)
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        best = bisect_left(self.room, (len(ids), -1))
        if best == len(self.room) and len(self.room) >= self.windows:
            room, serial = self.room.pop(0)
            fullest = self.open.pop(serial)
            if room > self.slack:
                self._put(fullest, (doc_id, start, ids[:room], doc_tokens))
                start, ids = start + room, ids[room:]
            yield from self._close(fullest)
            best = bisect_left(self.room, (len(ids), -1))
        if best < len(self.room):
            room, serial = self.room.pop(best)
            window = self.open[serial]
        else:
            room, serial, window = self.size, self.serial, _Window()
            self.open[serial] = window
            self.serial += 1
        self._put(window, (doc_id, start, ids, doc_tokens))
        if room == len(ids):
            yield from self._close(self.open.pop(serial))
        else:
            insort(self.room, (room - len(ids), serial))

    def rest(self) -> list[_Window]:
        """The windows still open, fullest first."""
        return [self.open[serial] for _, serial in self.room]


def _rows(found: list[tuple], base: int, keep_ids: bool, packer: list | None = None) -> pa.RecordBatch:
    """found: (sequence number, offset, piece). packer: the partition of leftovers, which keep their ids."""
    ids = [p[2].tobytes() for _, _, p in found]
    left = packer or [None] * len(found)
    columns = {
        "doc_id": [p[0] for _, _, p in found],
        "start": [p[1] for _, _, p in found],
        "length": [len(p[2]) for _, _, p in found],
        "ids_crc32": [zlib.crc32(b) for b in ids],
        "doc_tokens": [p[3] for _, _, p in found],
        "sequence_id": [base | n for n, _, _ in found],
        "offset": [at for _, at, _ in found],
        "ids": [b if keep_ids or x is not None else None for b, x in zip(ids, left)],
        "packer": left,
    }
    return to_batch({k: (_TYPES[k], v) for k, v in columns.items()})


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def pack_online(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, windows: int = 32, slack: int = 8, end_id: int = 0, merge_width: int = 64, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null without keep_ids).

    Each input partition packs its documents online with `windows` open windows. What stays open at its end is merged
    afterwards, `merge_width` partitions to a task: windows are joined best-fit, fullest first, by the same packer
    without slack, and the ids that then remain of a task are cut into sequences whose lengths are powers of two, which
    need no padding. Each id lies in exactly one piece; a sequence's pieces are gapless from offset 0; at most `slack`
    ids of a sequence of `size` are padding.

    Memory: one text, the open windows, and merge_width * windows leftovers. The first pass is written to the shared
    folder before the merge reads it. Null and empty texts are documents of one id, end_id; null doc_ids stay null;
    repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, found = Packer(size, windows, slack), []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = token_ids(text, tokenizer_path, end_id)
                found += packer.add(doc_id, 0, ids, len(ids))
                if len(found) >= 4096:
                    yield _rows(found, part << 32, keep_ids)
                    found = []
        yield _rows(found, part << 32, keep_ids)
        left = [(n, 0, piece) for n, window in enumerate(packer.rest()) for piece in window.pieces]
        yield _rows(left, part << 32, True, [part] * len(left))

    def merge(key, table):
        base = _MERGED | key[0].as_py() << 32
        by_window: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            by_window.setdefault(r["sequence_id"], []).append(r)
        packer, found = Packer(size, windows, 0), []
        for _, own in sorted(by_window.items(), key=lambda x: (-sum(r["length"] for r in x[1]), x[0])):
            for r in sorted(own, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
                found += packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
        last = Packer(size, 1, 0)  # one window: whatever comes fills it to the end
        for window in packer.rest():
            for piece in window.pieces:
                for n, at, p in last.add(*piece):
                    found.append((packer.closed + n, at, p))
        rest = [piece for window in last.rest() for piece in window.pieces]
        number = packer.closed + last.closed
        for length in powers_of_two(sum(len(p[2]) for p in rest)):
            at = 0
            while at < length:
                doc_id, start, ids, total = rest.pop(0)
                if len(ids) > length - at:
                    rest.insert(0, (doc_id, start + length - at, ids[length - at :], total))
                    ids = ids[: length - at]
                found.append((number, at, (doc_id, start, ids, total)))
                at += len(ids)
            number += 1
        return pa.Table.from_batches([_rows(found, base, keep_ids).drop_columns(["packer"])])

    once = materialize(docs.select("doc_id", "text").mapInArrow(first, f"{PIECE}, packer long"), "packed")
    done = once.filter("packer IS NULL").drop("packer")
    left = once.filter("packer IS NOT NULL").withColumn("packer", F.expr(f"packer div {merge_width}"))
    return done.unionByName(left.groupBy("packer").applyInArrow(merge, PIECE))
