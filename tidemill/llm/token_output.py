"""Packed token matrices in binary files: best-fit-decreasing with a segment tree over the bins' room."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, texts_of, to_batch
from .packing import token_ids

SHARD = "path string, first_sequence long, sequences long, id_bytes int, size int"
PIECE = "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, position_reset long, ids_crc32 long"
_INT = pa.int64()


class RoomTree:
    """Bins by their room: how many open bins have each room, in a segment tree whose nodes know if any lies below.

    The bin that fits best is one with the smallest room of at least the wanted length: climb until a right-hand
    neighbour holds any, then go down to its left-most one. Both ways take log2(size) steps.
    """

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.leaves
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, room) of the best fit, which leaves the tree; None if no bin has the room."""
        node = length + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.any[node] -= 1
            node >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Longest first, ties in the order given."""
    bins, offsets, tree, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), RoomTree(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = opened, size
            opened += 1
        bins[i], offsets[i] = found[0], size - found[1]
        if found[1] > n:
            tree.put(found[0], found[1] - n)
    return bins, offsets, opened


def _write(path: str, data: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def _read(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_token_shards(docs: DataFrame, tokenizer_path: str, folder: str, *, size: int = 1024, block_tokens: int = 2_000_000, end_id: int = 0) -> DataFrame:
    """Packs docs and writes shards into folder; returns the written table of shards: path, first_sequence, sequences, id_bytes, size.

    A shard is three files: path.ids, a matrix of sequences x size ids (little-endian, 2 bytes where the vocabulary allows,
    else 4; padded with end_id); path.cu, int32 cumulative lengths of all segments, one sequence behind another, each from 0;
    path.seg, int64 rows (sequence, doc_id or the least int64 for null, doc_tokens, start, position reset). A segment's
    positions restart at its reset, which is 0 for a document's head and `start` for later pieces of a split document.

    A task packs its documents in blocks of at least block_tokens, so a block and one text bound its memory. Texts over
    `size` ids are split without loss: whole sequences, and a rest that is packed with others. Files carry a name of their
    attempt, and only those of attempts that ended are in the table, so tasks may run again anywhere. Null and empty texts
    have the one id end_id; repeated rows are documents of their own; an empty table gives an empty table of shards;
    other columns are not read.
    """

    def shard(part: int, number: int, block: list[tuple], wide: bool) -> dict:
        pieces = [(k, start) for k, (_, ids) in enumerate(block) for start in range(0, len(ids), size)]
        lengths = np.array([min(size, len(block[k][1]) - start) for k, start in pieces], dtype=np.int64)
        bins, offsets, opened = best_fit_decreasing(lengths, size)
        matrix = np.full((opened, size), end_id, dtype="<u4" if wide else "<u2")
        order = np.lexsort((offsets, bins))
        cu, seg = [], []
        for i in order.tolist():
            (k, start), b, at, n = pieces[i], bins[i], int(offsets[i]), int(lengths[i])
            doc_id, ids = block[k]
            matrix[b, at : at + n] = ids[start : start + n]
            cu += [at, at + n] if at == 0 else [at + n]
            seg.append((b, np.iinfo(np.int64).min if doc_id is None else doc_id, len(ids), start, start))
        path = f"{folder}/{part:06d}-{number:05d}-{uuid.uuid4().hex}"
        _write(path + ".ids", matrix.tobytes())
        _write(path + ".cu", np.array(cu, dtype="<i4").tobytes())
        _write(path + ".seg", np.array(seg, dtype="<i8").tobytes())
        return {"path": path, "first_sequence": part << 40 | number << 24, "sequences": opened, "id_bytes": matrix.itemsize, "size": size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import load

        wide = max(load(tokenizer_path).size, end_id + 1) > 1 << 16
        part, block, held, written = TaskContext.get().partitionId(), [], 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = token_ids(text, tokenizer_path, end_id)
                block.append((doc_id, ids))
                held += len(ids)
                if held >= block_tokens:
                    written.append(shard(part, len(written), block, wide))
                    block, held = [], 0
        if block:
            written.append(shard(part, len(written), block, wide))
        kinds = {"path": pa.string(), "first_sequence": _INT, "sequences": _INT, "id_bytes": pa.int32(), "size": pa.int32()}
        yield to_batch({k: (t, [w[k] for w in written]) for k, t in kinds.items()})

    return materialize(docs.select("doc_id", "text").mapInArrow(run, SHARD), "shards")


def read_token_shards(shards: DataFrame, partition_bytes: int = 128 << 20) -> DataFrame:
    """One row per segment, all from the files: doc_id, doc_tokens, start, length, sequence_id, offset, position_reset, ids_crc32.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers. One shard is in memory at a time;
    a task reads shards of about partition_bytes, one after another. A shard without segments gives no rows; so does an
    empty table of shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                matrix = np.frombuffer(_read(s["path"] + ".ids"), dtype=f"<u{s['id_bytes']}").reshape(s["sequences"], s["size"])
                cu = np.frombuffer(_read(s["path"] + ".cu"), dtype="<i4")
                seg = np.frombuffer(_read(s["path"] + ".seg"), dtype="<i8").reshape(-1, 5)
                begins, ends = cu[:-1][cu[1:] != 0], cu[1:][cu[1:] != 0]  # a 0 opens the next sequence
                crc = [zlib.crc32(matrix[b, x:y].astype("<u4").tobytes()) for b, x, y in zip(seg[:, 0], begins, ends)]
                doc_ids = pa.array(seg[:, 1], mask=seg[:, 1] == np.iinfo(np.int64).min)
                yield to_batch(
                    {
                        "doc_id": (_INT, doc_ids),
                        "doc_tokens": (_INT, seg[:, 2]),
                        "start": (_INT, seg[:, 3]),
                        "length": (_INT, (ends - begins).astype(np.int64)),
                        "sequence_id": (_INT, s["first_sequence"] + seg[:, 0]),
                        "offset": (_INT, begins.astype(np.int64)),
                        "position_reset": (_INT, seg[:, 4]),
                        "ids_crc32": (_INT, crc),
                    }
                )

    stored = shards.agg(F.sum(F.col("sequences") * F.col("size") * F.col("id_bytes"))).first()[0] or 0
    tasks = max(-(-stored // partition_bytes), shards.sparkSession.sparkContext.defaultParallelism)
    return shards.repartition(tasks).mapInArrow(run, PIECE)


def token_output(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, block_tokens: int = 2_000_000) -> DataFrame:
    """write_token_shards into a new shared folder, then read_token_shards of it."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_shards(write_token_shards(docs, tokenizer_path, folder, size=size, block_tokens=block_tokens))
