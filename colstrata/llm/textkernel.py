"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Everything works on the flat UTF-8 buffer and offsets of an Arrow string column,
so a batch of documents costs a fixed number of NumPy calls, whatever the number
of rows. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL(None)

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are neither letters nor digits
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if buffers[2] is None or last == first:
        return np.zeros(0, np.uint8), offsets - first
    return np.frombuffer(buffers[2], np.uint8, last - first, first), offsets - first


def _doc_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    marks = offsets[:-1]
    return marks[(marks < size) & (offsets[1:] > marks)]


def lower(buf: np.ndarray) -> np.ndarray:
    """The text with ASCII and Latin-1 capitals made small."""
    out = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * 32
    if len(buf) > 1:
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        x = out[after]
        out[after] = np.where((x >= 0x80) & (x <= 0x9E) & (x != 0x97), x + 32, x)
    return out


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes without separators (ASCII white space)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = separators[buf]
    start = ~ws
    start[1:] &= ws[:-1]
    heads = _doc_starts(offsets, len(buf))
    start[heads] = ~ws[heads]
    end = np.zeros(len(buf) + 1, dtype=bool)
    end[1:] = ~ws
    end[1:-1] &= ws[1:]
    end[heads] = False
    tails = heads[1:]
    end[tails] = ~ws[tails - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(offsets, s, "right") - 1


def chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of pieces: a run of white space with the word after it.

    The pieces of a document, put together, are the document.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = _WS[buf]
    start = ws.copy()
    start[1:] &= ~ws[:-1]
    start[_doc_starts(offsets, len(buf))] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(buf))
    return s, e, np.searchsorted(offsets, s, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _S32)) * _MUL2
    h = (h ^ (h >> _S32)) * _MUL2
    return h ^ (h >> _S32)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span, eight bytes a step."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _MUL + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    at, left, live = starts, size, None
    while True:
        if live is None:
            keep = left > 0
            live = np.flatnonzero(keep) if not keep.all() else np.arange(len(starts))
        else:
            keep = left > 0
            live = live[keep]
        if not len(live):
            return h
        at, left = (at[keep], left[keep])
        x = eight[at]
        short = left < 8
        if short.any():
            shift = (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)) & np.uint64(63)
            x = np.where(short, (x << shift) >> shift, x)
        h[live] = mix((h[live] ^ x) * _MUL + np.uint64(1))
        at, left = at + 8, left - 8


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of an array, one after the other."""
    total = int(lengths.sum())
    if not total:
        return buf[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return buf[index]


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as Python strings."""
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def char_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return lead[offsets[1:]] - lead[offsets[:-1]]


def byte_to_char(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one more entry than bytes)."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def released(parts):
    """The parts of a task's result; memory that was freed goes back to the system at each and at the end.

    A worker serves one task after another, and would keep the most that any took.
    """
    for part in parts:
        yield part
        del part
        _release()
    _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer document stands alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        out.append((a, b))
        a = b
    return out
