"""Repeated passages, by an FM-index in each shard.

Every window of `length` words goes to the shard of its minimizer (the least hash
of its runs of a few words), so equal windows meet in one shard wherever they
stand and nothing is compared across shards. Neighbouring windows of one minimizer
travel as one segment. A shard keeps one symbol of 8 bits for each word (equal
windows of 50 words by chance alone: 1 in 2^400), sorts the suffixes of its distinct
segments, and holds their Burrows-Wheeler transform as a wavelet matrix of
bit-packed levels with running counts. Segments are then streamed against it:
backward search from the right gives, for each end, the longest string that
occurs at least twice; those of `length` words or more are reported. Windows that it finds equal must also
agree in 16 more bits a word, so a window that differs in one word passes for
equal once in 2^24.

A segment whose minimizer occurs nowhere else has no window that repeats, and is
not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import vocab
from .jaccard import _binary, _bytes_of, _free, _grouped
from .staging import stage

_PLACE = np.uint64((1 << 24) - 1)
_SLICE = 4 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a byte array, by prefix doubling from eight symbols on; only tied suffixes are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n + 1,), np.dtype(">u8"), padded.data, strides=(1,))[:n].astype(np.uint64)
    # positions near the end see padding: the shorter suffix comes first
    order = np.argsort(key, kind="stable")
    tail = np.flatnonzero(order >= n - 8)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    if len(tail):
        # within equal keys, suffixes of fewer than eight symbols go first, shorter ones before longer
        starts = np.flatnonzero(new)
        group = np.searchsorted(starts, tail, "right") - 1
        for g in np.unique(group):
            a, b = starts[g], starts[g + 1] if g + 1 < len(starts) else n
            if b - a > 1:
                part = order[a:b]
                short = np.sort(part[part > n - 8])[::-1]
                order[a:b] = np.concatenate([short, part[part <= n - 8]])
                new[a : a + len(short) + 1] = True
        new = new[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    tied = ~(new & np.append(new[1:], True))
    h = 8
    at = np.flatnonzero(tied)
    while len(at):
        p = order[at]
        second = rank[np.minimum(p + h, n)] + 1
        base = start[at]
        by = np.argsort((base.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")
        p, second = p[by], second[by]
        order[at] = p
        first = np.concatenate([[True], (base[1:] != base[:-1]) | (second[1:] != second[:-1])])
        begin = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        start[at] = begin
        rank[p] = begin
        alone = first & np.append(first[1:], True)
        at = at[~alone]
        h *= 2
    return order


class FMIndex:
    """Backward search over a byte text: the transform in a wavelet matrix of eight bit-packed levels."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        n = len(text)
        # a row for the end of the text, which sorts first; its symbol is left out by shifting ranks
        bwt = np.concatenate([text[-1:], text[order - 1]])
        self.gap = int(np.flatnonzero(order == 0)[0]) + 1
        bwt = np.delete(bwt, self.gap)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256] + 1
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(7, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            count = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.ranks.append((np.cumsum(count) - count).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.n = n
        symbols = np.arange(256)
        self.base = np.zeros(256, np.int64)
        self.base = self._walk(symbols, np.zeros(256, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(8):
            word = i >> 6
            one = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (7 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of c followed by what the rows [lo, hi) begin with."""
        m = len(c)
        both = np.concatenate([lo, hi])
        both -= both > self.gap
        got = self._walk(np.concatenate([c, c]), both) - np.concatenate([self.base[c]] * 2) + np.concatenate([self.first[c]] * 2)
        return got[:m], got[m:]

    def whole(self) -> tuple[int, int]:
        return 0, self.n + 1


def maximal_repeats(fm: FMIndex, text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings text[start:end] within the segments [a, b), of `length` or more, that occur twice in the indexed text.

    All segments step together. From an end e, symbols are put in front until
    what is read occurs once only; then the end moves left, past every window
    that holds a string known to occur once.
    """
    lo0, hi0 = fm.whole()
    # what all windows of a segment share: if that occurs once, so do they
    core_end, core_begin = a + length - 1, b - length
    idx = np.arange(len(a))
    p, lo, hi = core_end.copy(), np.full(len(a), lo0), np.full(len(a), hi0)
    live = idx[core_begin <= core_end]
    alive = np.ones(len(a), bool)
    while len(live):
        lo[live], hi[live] = fm.step(text[p[live]].astype(np.int64), lo[live], hi[live])
        once = hi[live] - lo[live] < 2
        alive[live[once]] = False
        p[live] -= 1
        live = live[~once]
        live = live[p[live] >= core_begin[live]]
    idx = idx[alive]
    if not len(idx):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, e = a[idx], b[idx] - 1
    p, lo, hi = e.copy(), np.full(len(a), lo0), np.full(len(a), hi0)
    # a search for the least end that makes a string from the wall unique: beyond `near`, at `stop` at most
    wall, near, stop = np.full(len(a), -1), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    starts, ends = [], []
    while len(a):
        lo, hi = fm.step(text[p].astype(np.int64), lo, hi)
        ok = hi - lo >= 2
        probing = wall >= 0
        through = ok & probing & (p == wall)
        died = ~ok
        at_end = ok & (p == a)
        hit = np.flatnonzero((at_end | died) & ~probing & (e - p + ok >= length))
        if len(hit):
            starts.append(p[hit] + died[hit])
            ends.append(e[hit] + 1)
        again = np.zeros(len(a), bool)
        x = np.flatnonzero(through)
        if len(x):
            near[x] = e[x]
            done = stop[x] - near[x] <= 1
            # the string of this end goes on to the left as it is
            wall[x[done]] = -1
            late = x[done & (p[x] == a[x]) & (e[x] - p[x] + 1 >= length)]
            if len(late):
                starts.append(p[late])
                ends.append(e[late] + 1)
            y = x[~done]
            e[y] = (near[y] + stop[y]) // 2
            again[y] = True
        x = np.flatnonzero(died)
        if len(x):
            again[x] = True
            fresh = wall[x] < 0
            short = x[fresh & (e[x] - p[x] <= 8)]
            e[short] -= 1
            y = x[fresh & (e[x] - p[x] > 8)]
            wall[y], near[y], stop[y] = p[y], p[y] - 1, np.minimum(e[y], p[y] + length)
            z = x[~fresh]
            stop[z] = e[z]
            y = np.concatenate([y, z])
            found = stop[y] - near[y] <= 1
            f, g = y[found], y[~found]
            e[f], wall[f] = near[f], -1
            e[g] = np.where(near[g] < wall[g], np.minimum(wall[g] + 7, (wall[g] + stop[g]) // 2), (near[g] + stop[g]) // 2)
        over = (at_end & ~again) | (np.where(wall >= 0, stop, e + 1) <= a + length - 1)
        p = np.where(again, e, p - 1)
        lo, hi = np.where(again, lo0, lo), np.where(again, hi0, hi)
        if over.any():
            keep = ~over
            a, e, p, lo, hi, wall, near, stop = a[keep], e[keep], p[keep], lo[keep], hi[keep], wall[keep], near[keep], stop[keep]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def _runs_of_equal(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each position, a number for the `length` symbols that begin there."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    eight = np.ndarray((n + length,), np.dtype("<u8"), padded.data, strides=(1,))
    differs = np.zeros(n, bool)
    x, y = order[1:], order[:-1]
    if length >= 8:
        for k in [*range(0, length - 7, 8), length - 8]:
            differs[1:] |= eight[x + k] != eight[y + k]
    else:
        for k in range(length):
            differs[1:] |= padded[x + k] != padded[y + k]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(differs)
    return out


def _window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` values from each position on; the last ones are cut short."""
    n = len(values)
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(values.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    undo = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, back)]))[:n]
    return (total[np.minimum(np.arange(n) + length, n)] - total[:n]) * undo


def repeated_windows(text: np.ndarray, check: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a text of distinct segments [a, b): whether its window occurs twice, and where first.

    check: more bits of each symbol, which the index doesn't hold; windows that
    it finds equal must have them equal too. count: documents' places of each
    segment; the windows of one with several occur twice anyway.
    """
    order = suffix_array(text)
    single = count == 1
    s, e = maximal_repeats(FMIndex(text, order), text, a[single], b[single], length)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, e - length + 1, -1)
    several = np.zeros(len(text) + 1, np.int64)
    np.add.at(several, a[~single], 1)
    np.add.at(several, (b - length + 1)[~single], -1)
    several = np.cumsum(several)[:-1] > 0
    at = np.flatnonzero((np.cumsum(change)[:-1] > 0) | several)
    key = tk.mix(_runs_of_equal(text, order, length)[at].astype(np.uint64)) ^ _window_hashes(check, length)[at]
    _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    repeated, where = np.zeros(len(text), bool), np.arange(len(text))
    repeated[at] = (n[which] > 1) | several[at]
    where[at] = at[first][which]
    return repeated, where


def _segments(docs: DataFrame, text: str, doc_id: str, length: int, run_words: int, shards: int) -> DataFrame:
    """Segments by shard: parallel arrays of a batch's segments in one row for each shard."""
    picked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL").select("d", F.xxhash64("t").alias("h"), "t")
    span = length - run_words + 1

    def sliding(x: np.ndarray) -> np.ndarray:
        w = 1
        while w * 2 <= span:
            x = np.minimum(x[:-w], x[w:]) if len(x) > w else x[:0]
            w *= 2
        k = span - w
        return np.minimum(x[: len(x) - k], x[k:]) if k and len(x) > k else (x[:0] if k else x)

    def segments(part: np.ndarray, off: np.ndarray, ids: np.ndarray, text_hash: np.ndarray) -> pa.RecordBatch | None:
        """The segments of one slice of texts, by shard; what it works on goes before the next slice."""
        s, e, doc = tk.words(part, off)
        if len(s) < length:
            return None
        h = tk.hash_spans(part, s, e)
        count = np.bincount(doc, minlength=len(off) - 1)
        place = np.arange(len(s)) - (np.cumsum(count) - count)[doc]
        g = np.zeros(len(h) - run_words + 1, np.uint64)
        for k in range(run_words):
            g = tk.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - run_words + 1 + k])
        spot = np.arange(len(g), dtype=np.uint64) & _PLACE
        g &= ~_PLACE
        left, right = sliding(g | spot), sliding(g | (_PLACE - spot))
        win = np.flatnonzero(place[: len(left)] + length <= count[doc[: len(left)]])
        if not len(win):
            return None
        value = left[win] >> np.uint64(24)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (win[1:] != win[:-1] + 1)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(win)) - 1
        begin, size = win[head], win[tail] - win[head] + length
        least = value[head]
        several = (left[win[head]] & _PLACE) != _PLACE - (right[win[tail]] & _PLACE)
        shard = (tk.mix(least) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        begin, size, least, several, shard = begin[order], size[order], least[order], several[order], shard[order]
        symbols = (h % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        data = tk.gather(symbols, begin, size)
        check = tk.gather(((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16), begin, size)
        row = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        ends = np.append(row, len(shard))
        of = doc[begin]

        def packed(x: np.ndarray) -> pa.Array:
            return _binary(x, ends * x.itemsize)

        return pa.RecordBatch.from_arrays(
            [
                pa.array(shard[row].astype(np.int32)),
                packed(ids[of]),
                packed(text_hash[of]),
                packed(place[begin].astype(np.int32)),
                packed(size.astype(np.int32)),
                packed(least),
                packed(several.astype(np.uint8)),
                _binary(data, np.concatenate([[0], np.cumsum(size)])[ends]),
                _binary(check, np.concatenate([[0], np.cumsum(size)])[ends] * 2),
            ],
            names=["shard", "ids", "hashes", "places", "sizes", "least", "several", "symbols", "extra"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            buf, offsets = tk.flat(batch.column(2))
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            text_hash = batch.column(1).to_numpy()
            for a, b in tk.slices(offsets, _SLICE):
                if (made := segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], text_hash[a:b])) is not None:
                    yield made

    return picked.mapInArrow(lambda batches: tk.released(run(batches)), "shard int, ids binary, hashes binary, places binary, sizes binary, least binary, several binary, symbols binary, extra binary")


def _runs(flag: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs of flagged windows within a segment."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])])
    head = np.flatnonzero(new)
    return at[head], at[np.append(head[1:], len(at)) - 1]


def search_shard(ids: np.ndarray, hashes: np.ndarray, place: np.ndarray, size: np.ndarray, least: np.ndarray, several: np.ndarray, symbols: np.ndarray, extra: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of words within repeated windows: segment, first word, end word, and whether an equal text stands earlier."""
    _, which, count = np.unique(least, return_inverse=True, return_counts=True)
    keep = np.flatnonzero((count[which] > 1) | (several > 0))
    order = keep[np.lexsort((place[keep], hashes[keep], ids[keep]))]
    # a repeated row of one id and text is one document
    i, h, at = ids[order], hashes[order], place[order]
    order = order[np.concatenate([[True], (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1])])] if len(order) else order
    begin = (np.cumsum(size) - size)[order]
    size = size[order].astype(np.int64)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    if not len(order):
        return none
    code = tk.hash_spans(symbols, begin, begin + size) ^ tk.mix(tk.hash_spans(extra.view(np.uint8), begin * 2, (begin + size) * 2))
    _, first, which, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    # distinct segments in the order of their first place
    rank = np.argsort(first)
    to = np.empty(len(rank), np.int64)
    to[rank] = np.arange(len(rank))
    first, count, which = first[rank], count[rank], to[which]
    n = size[first]
    b = np.cumsum(n + 1) - 1
    a = b - n
    text, check = np.zeros(int(b[-1]) + 1, np.uint8), np.zeros(int(b[-1]) + 1, np.uint16)
    inside = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)
    text[inside], check[inside] = tk.gather(symbols, begin[first], n), tk.gather(extra, begin[first], n)
    repeated, where = repeated_windows(text, check, a, b, count, length)
    seg = np.repeat(np.arange(len(n)), n + 1)
    later = repeated & (where < np.arange(len(text)))
    out = []
    copy = np.ones(len(order), bool)
    copy[first] = False
    # runs of each distinct segment, for its first place
    for flag, dup in ((repeated, False), (later, True)):
        x, y = _runs(flag, seg)
        s = seg[x]
        out.append((order[first[s]], x - a[s], y - a[s] + length, np.full(len(x), dup)))
    # any other place of a segment is repeated as a whole
    c = np.flatnonzero(copy)
    for dup in (False, True):
        out.append((order[c], np.zeros(len(c), np.int64), size[c], np.full(len(c), dup)))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_runs(docs: DataFrame, length: int = 50, run_words: int = 6, shard_bytes: int = 16 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, runs and later: word ranges within repeated windows, and of those that an earlier text has."""
    if not 1 <= run_words <= length:
        raise ValueError("run_words must be from 1 to length")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 0):
            shard = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
                one = batch.slice(p, q - p)
                kinds = (np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint8, np.uint8, np.uint16)
                cols = [np.frombuffer(_bytes_of(one.column(k + 1))[0].tobytes(), kind) for k, kind in enumerate(kinds)]
                seg, x, y, dup = search_shard(*cols, length)
                lost = cols[0][seg] == np.iinfo(np.int64).min
                start = cols[2][seg].astype(np.int64)
                for at in range(0, len(seg), 200_000):
                    c = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0][seg[c]], mask=lost[c]), pa.array(cols[1][seg[c]]), pa.array((start[c] + x[c]).astype(np.int32)), pa.array((start[c] + y[c]).astype(np.int32)), pa.array(dup[c])], names=["doc_id", "text_hash", "a", "b", "later"])

    parts = max(1, min(shards, 20_000))
    sharded = _segments(docs, text, doc_id, length, run_words, shards).repartitionById(parts, "shard").sortWithinPartitions("shard")
    found = sharded.mapInArrow(lambda batches: tk.released(run(batches)), "doc_id bigint, text_hash bigint, a int, b int, later boolean")

    def merged(flag: F.Column | None) -> F.Column:
        ranges = F.sort_array(F.collect_list(F.when(flag, F.struct("a", "b")) if flag is not None else F.struct("a", "b")))
        empty = F.array().cast("array<struct<a:int,b:int>>")
        last = lambda acc: F.element_at(acc, -1)
        return F.aggregate(
            ranges,
            empty,
            lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= last(F.when(F.size(acc) > 0, acc).otherwise(F.array(x)))["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
        )

    return found.groupBy("doc_id", "text_hash").agg(merged(~F.col("later")).alias("runs"), merged(F.col("later")).alias("later"))


def repeated_passages(docs: DataFrame, length: int = 50, run_words: int = 6, shard_bytes: int = 16 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each maximal range of words made of windows that occur twice or more.

    doc_id, start_word, end_word (exclusive) and later_words: how many of its
    words are within a window that stands earlier, in the order of doc_id and
    place. Words are runs without ASCII white space, compared as they are.

    Nulls: a null text has no words; documents without doc_id are compared and
    reported under null. Texts of fewer than `length` words have no window. Very
    long texts are read whole. Repeated rows of one id and text count once; a text
    may repeat itself. An empty table gives no row. Other columns are not read.
    """
    runs = repeated_runs(docs, length, run_words, shard_bytes, text, doc_id)
    x = F.col("x")
    inside = F.aggregate("later", F.lit(0), lambda n, r: n + F.greatest(F.lit(0), F.least(r["b"], x["b"]) - F.greatest(r["a"], x["a"])))
    return runs.select("doc_id", "later", F.explode("runs").alias("x")).select("doc_id", x["a"].alias("start_word"), x["b"].alias("end_word"), inside.alias("later_words"))


def _replaced(column: pa.Array, new: list, where: np.ndarray) -> pa.Array:
    """The column with some values from a list, which follow its own in numbering."""
    return pa.concat_arrays([column, pa.array(new, column.type)]).take(pa.array(where))


def cut_repeats(docs: DataFrame, length: int = 50, run_words: int = 6, shard_bytes: int = 16 << 20, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars", broadcast_rows: int = 200_000) -> DataFrame:
    """The documents without the passages that stand earlier already.

    A window's first place, by doc_id and then by place, is never cut for it.
    What is left of a text keeps its white space; a text that loses every word
    goes, with its row. n_chars, if the documents have such a column, is set to
    the new length of a text that was cut.

    The ranges are broadcast up to broadcast_rows documents and ranges, and joined
    beyond. Repeated rows of one id and text are one document and are cut alike.
    Rows with a null or short text stay as they are; very long texts are read
    whole. An empty table gives an empty table. Other columns pass through,
    whatever their names.
    """
    names = docs.columns
    d, h, cut = _free(names, 3)
    ranges = stage(repeated_runs(docs, length, run_words, shard_bytes, text, doc_id).where(F.size("later") > 0).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("later").alias(cut)), "cuts")
    # 8 bytes a range and 40 a document
    total = ranges.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(cut)), F.lit(0)).alias("ranges")).first()
    side = F.broadcast(ranges) if max(total["rows"], total["ranges"]) <= broadcast_rows else ranges
    t = F.col(f"`{text}`").cast("string")
    joined = docs.join(side, F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64(t) == F.col(h)), "left").select(*[F.col(f"`{c}`") for c in names], F.col(cut))
    at, cut_at = names.index(text), len(names)
    count_at = names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(cut_at)
            some = np.flatnonzero(np.asarray(cuts.is_valid()))
            columns = list(batch.columns[:cut_at])
            if not len(some):
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            texts, lengths = {}, {}
            keep = np.ones(batch.num_rows, bool)
            for i in some.tolist():
                buf, off = tk.flat(columns[at].slice(i, 1))
                s, e, _ = tk.words(buf, off)
                # a cut takes a word with the white space after it
                nxt = np.append(s[1:], len(buf))
                drop = np.zeros(len(buf), bool)
                for c in cuts[i].as_py():
                    drop[s[c["a"]] : nxt[min(c["b"], len(s)) - 1]] = True
                if drop[s].all():
                    keep[i] = False
                    continue
                left = buf[~drop]
                texts[i], lengths[i] = left.tobytes().decode("utf-8", "replace"), int(((left & 0xC0) != 0x80).sum())
            where = np.arange(batch.num_rows)
            where[list(texts)] = batch.num_rows + np.arange(len(texts))
            columns[at] = _replaced(columns[at], list(texts.values()), where)
            if count_at is not None:
                columns[count_at] = _replaced(columns[count_at], list(lengths.values()), where)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(lambda batches: tk.released(run(batches)), docs.schema)
