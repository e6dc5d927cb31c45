"""Token ids packed to fixed-length rows, best fit decreasing.

Each partition packs its own documents: encode, split what is longer than a row,
then give the pieces, longest first, to the open row with the least room that
still holds them. A segment tree over the amounts of room finds that row in
log2(row length) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import vocab

PACK_SCHEMA = "pack_id string, n_tokens int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<bigint>, doc_offsets array<int>"


class RoomTree:
    """Rows by the room left in them, with the least room of at least so much found by descent."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row that fits best, with its room, or None."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not self.count[i]:
                    i += 1
        room = i - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The row of each piece, and the number of rows. Ties go by position."""
    tree, rows = RoomTree(most), 0
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        got = tree.take(n)
        if got is None:
            got = (rows, most)
            rows += 1
        out[i] = got[0]
        if got[1] - n:
            tree.put(got[1] - n, got[0])
    return out, rows


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _matrix(flat: np.ndarray, ends: np.ndarray, length: int, fill: int) -> pa.ListArray:
    """Lists of `length` each: the values of each row, then the filler."""
    rows, size = len(ends) - 1, np.diff(ends)
    out = np.full(rows * length, fill, np.int32)
    out[np.arange(len(flat)) + np.repeat(np.arange(rows) * length - ends[:-1], size)] = flat
    return _list(out, np.arange(rows + 1) * length, pa.int32())


def _pack(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, missing: np.ndarray, length: int, pad: int, name: str) -> Iterator[pa.RecordBatch]:
    """Rows from the ids of documents with at least one token."""
    size = np.diff(ends)
    pieces = -(-size // length)
    doc = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = ends[:-1][doc] + nth * length
    n = np.minimum(size[doc] - nth * length, length)
    row, rows = best_fit(n, length)
    order = np.lexsort((np.arange(len(n)), -n, row))
    row, begin, n, doc, nth = row[order], begin[order], n[order], doc[order], nth[order]
    per = np.bincount(row, minlength=rows)
    used = np.bincount(row, n, rows).astype(np.int64)
    first = np.cumsum(per) - per
    row_begin = np.cumsum(used) - used
    flat = tk.gather(ids, begin, n)
    at = np.cumsum(n) - n
    position = (np.arange(len(flat)) - np.repeat(at, n)).astype(np.int32)
    # cumulative lengths: a 0 before each row's
    cu = np.zeros(len(n) + rows, np.int32)
    cu[np.arange(len(n)) + row + 1] = at + n - row_begin[row]
    ids_of = pa.array(docs[doc], pa.int64(), mask=missing[doc])
    step = max(1, (4 << 20) // length)
    for a in range(0, rows, step):
        b = min(rows, a + step)
        t0, t1 = row_begin[a], row_begin[b - 1] + used[b - 1]
        p0, p1 = first[a], first[b - 1] + per[b - 1]
        tok_ends = np.append(row_begin[a:b] - t0, t1 - t0)
        seg_ends = np.append(first[a:b] - p0, p1 - p0)
        c0 = p0 + a
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{name}-{r}" for r in range(a, b)]),
                pa.array(used[a:b].astype(np.int32)),
                _matrix(flat[t0:t1], tok_ends, length, pad),
                _list(cu[c0 : p1 + b], seg_ends + np.arange(b - a + 1), pa.int32()),
                _matrix(position[t0:t1], tok_ends, length, 0),
                pa.ListArray.from_arrays(pa.array(seg_ends.astype(np.int32)), ids_of[int(p0) : int(p1)]),
                _list((nth[p0:p1] * length).astype(np.int32), seg_ends, pa.int32()),
            ],
            names=["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_offsets"],
        )


def pack_tokens(docs: DataFrame, length: int = 2048, folder: str = vocab.TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken", eot: int = 50256, text: str = "text", doc_id: str = "doc_id", group_bytes: int = 24 << 20) -> DataFrame:
    """Rows of `length` ids: what each holds, where its segments end, and positions from 0 in each.

    A document's ids are its text's with `eot` after them. One longer than a row
    is split each `length` ids; doc_offsets says where in the document a segment
    begins, so the segments give the document back. Rows are filled from one
    group of about group_bytes of text within a partition, so nothing is
    shuffled and memory is bounded. input_ids and position_ids are matrices of
    `length` columns: beyond the n_tokens of a row they hold eot and 0, and
    cu_seqlens ends at n_tokens. A pack_id is the partition, the group in it and the
    row in that, so no two rows share one.

    Nulls: a null or empty text is the one id eot; a null doc_id stays null, and
    its segments can't be told from others without id. Ties in length go by the
    order of rows. Repeated rows are packed each. An empty table gives no row.
    Other columns are not read.
    """

    def group(parts: list[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
        ids, size = [], []
        for p in parts:
            buf, offsets = tk.flat(p.column(1))
            for a, b in tk.slices(offsets, 8 << 20):
                got, ends = vocab.encode_bpe(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], folder, vocabulary)
                ids.append(np.insert(got, ends[1:], eot).astype(np.int32))
                size.append(np.diff(ends) + 1)
        if sum(map(len, size)):
            column = pa.concat_arrays([p.column(0) for p in parts])
            missing = np.asarray(column.is_null())
            ends = np.concatenate([[0], np.cumsum(np.concatenate(size))])
            yield from _pack(np.concatenate(ids), ends, np.asarray(column.fill_null(0)), missing, length, eot, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, done, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            n += batch.column(1).nbytes
            if n >= group_bytes:
                yield from group(held, f"{part}-{done}")
                held, n, done = [], 0, done + 1
        yield from group(held, f"{part}-{done}")

    picked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    return picked.mapInArrow(lambda batches: tk.released(run(batches)), PACK_SCHEMA)


BINARY_SCHEMA = "pack_id string, n_tokens int, ids binary, cu_seqlens binary, positions binary"


def to_binary(packs: DataFrame) -> DataFrame:
    """The rows of pack_tokens() as little-endian 32-bit numbers: ids and positions of the row's whole width, and the ends of segments.

    Rows of one table have one width, so the ids of n rows, one after the other, are
    an n x length matrix as they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), batch.column(1)]
            for c in batch.columns[2:]:
                ends = np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))]) * 4
                data = c.flatten().to_numpy().astype("<i4").tobytes()
                columns.append(pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(columns, names=["pack_id", "n_tokens", "ids", "cu_seqlens", "positions"])

    return packs.select("pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids").mapInArrow(run, BINARY_SCHEMA)
