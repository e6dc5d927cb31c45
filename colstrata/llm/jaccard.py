"""Documents whose word n-gram sets are similar, by Jaccard.

Documents with equal sets are one set with several documents throughout, found by a
pre-aggregated group-by, so copies never meet in a task. A tile holds the sets that
share one of `hashes` minima of their grams (a pair of similarity j meets in none of
them with probability (1 - j)^hashes, 0.0015 % at 0.5). A tile of more than
`block_rows` sets is split into blocks by a hash of the set, and each pair of blocks
is a cell of its own, so no task holds a tile. Within a cell, sets are ordered by
size, so a pair is looked at only in the band of sizes where the threshold can be
reached. Each set has a hashed parity bitmap, 4 to 8 bits a gram: a bit differs
only where the sets do, so (sizes - differing bits) / 2 bounds the overlap from
above. Pairs that the bound leaves are settled by intersecting the sorted arrays of
grams, which only the sets of such pairs are shipped for.

A cell gives one row for each set in a pair: how many documents it is linked to
there, and a set that stands for its component in the cell. So what leaves a cell
grows with its sets, and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as tk
from . import vocab
from .staging import rows_of, stage

_GRAM = np.uint64((1 << 48) - 1)
_SLICE = 4 << 20
PAIR_SCHEMA = "a bigint, b bigint, jaccard double"
LINK_SCHEMA = "sid bigint, root bigint, links bigint"
#: Cells of up to so many sets are settled together, larger ones each by itself.
_SMALL = 24


def gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit gram hashes of up to 65,536 documents, and n + 1 offsets.

    Words are runs of letters and digits, case folded; a document of fewer than n
    words is one gram of them all.
    """
    rows = len(offsets) - 1
    low = tk.lower(buf)
    s, e, doc = tk.words(low, offsets, tk.SEPARATORS)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = tk.hash_spans(low, s, e)
    count = np.bincount(doc, minlength=rows)
    first = np.cumsum(count) - count
    place = np.arange(len(h)) - first[doc]
    heads = (place + n <= count[doc]) | ((place == 0) & (count[doc] < n))
    at = np.flatnonzero(heads)
    left = count[doc[at]] - place[at]
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = left > k
        x = np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(k + 1))
        gram = tk.mix(gram * np.uint64(0x9E3779B97F4A7C15) + x)
    key = (doc[at].astype(np.uint64) << np.uint64(48)) | (gram & _GRAM)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(48)).astype(np.int64)
    return key & _GRAM, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in tk.slices(offsets, _SLICE):
        for c in range(a, b, 65_536):
            yield c, min(b, c + 65_536)


def _minima(grams: np.ndarray, ends: np.ndarray, hashes: int) -> np.ndarray:
    """hashes minima of each non-empty set, which must be all of them."""
    return np.stack([np.minimum.reduceat(tk.mix(grams ^ tk.mix(np.array([k + 1], np.uint64))), ends[:-1]) for k in range(hashes)], 1)


def _widths(size: np.ndarray) -> np.ndarray:
    """Bits of a bitmap: a power of two of 4 to 8 a gram, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1) * 4)).astype(np.int64))


def _bitmaps(grams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps as bytes, one after the other, and their offsets."""
    size = np.diff(ends)
    width = _widths(size)
    at = np.concatenate([[0], np.cumsum(width)])
    bit = (tk.mix(grams + np.uint64(77)) & (np.repeat(width, size).astype(np.uint64) - np.uint64(1))).astype(np.int64) + np.repeat(at[:-1], size)
    odd = (np.bincount(bit, minlength=int(at[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), at // 8


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _sketch(docs: DataFrame, text: str, doc_id: str, n: int, hashes: int, full: bool) -> DataFrame:
    """doc_id, h (of the text), sid (of the set), size, minima, their lower halves, and bitmap or, if full, grams of each document with any."""
    words = F.col(f"`{text}`").cast("string")
    picked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(words).alias("h"), words.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            buf, offsets = tk.flat(batch.column(2))
            for a, b in _slices(offsets):
                grams, ends = gram_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                some = np.flatnonzero(np.diff(ends) > 0)
                if not len(some):
                    continue
                ends = np.append(ends[some], ends[-1])
                mixed = tk.mix(grams + np.uint64(1))
                both = np.add.reduceat(mixed, ends[:-1]) + tk.mix(np.bitwise_xor.reduceat(tk.mix(mixed), ends[:-1]) + np.diff(ends).astype(np.uint64))
                # grams have 48 bits, so six bytes are shipped
                data, at = (grams.view(np.uint8).reshape(-1, 8)[:, :6], ends * 6) if full else _bitmaps(grams, ends)
                own, minima = batch.slice(a, b - a).take(pa.array(some)), _minima(grams, ends, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(1),
                        pa.array(tk.mix(both).view(np.int64)),
                        pa.array(np.diff(ends).astype(np.int32)),
                        _binary(minima.reshape(-1), np.arange(len(some) + 1) * 8 * hashes),
                        _binary(minima.astype(np.uint32).reshape(-1), np.arange(len(some) + 1) * 4 * hashes),
                        _binary(data, at),
                    ],
                    names=["doc_id", "h", "sid", "size", "minima", "short", "data"],
                )

    return picked.mapInArrow(lambda batches: tk.released(run(batches)), "doc_id bigint, h bigint, sid bigint, size int, minima binary, short binary, data binary")


def _cells(sets: DataFrame, hashes: int, block_rows: int) -> DataFrame:
    """sid, cell, nth and part of each set in each cell: part is 0 in a cell of one block, and 1 or 2 in one of two."""
    nth = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))
    tiles = sets.select("sid", nth.alias("nth"), "minima").select("sid", "nth", F.xxhash64("nth", F.substring("minima", F.col("nth") * 8 + 1, F.lit(8))).alias("tile"))
    counts = tiles.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    placed = tiles.join(counts, "tile").select("sid", "nth", "tile", blocks.alias("blocks"), F.pmod(F.xxhash64("sid", F.lit(3)), blocks).cast("int").alias("own"))
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other"))
    part = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return each.select("sid", cell.alias("cell"), "nth", part.cast("int").alias("part"))


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows with the same value in the sorted key column come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut == 0 and held and held[-1].column(key)[0].as_py() == k[-1]:
            held.append(batch)
            continue
        if cut or held:
            if held and cut == 0:
                yield _joined(held)
                held = [batch]
                continue
            yield _joined([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows in one batch; binary columns and strings get 64-bit offsets, as 2 GiB of one may be passed."""
    if len(held) == 1:
        return held[0]
    wide = {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}
    table = pa.Table.from_batches(held)
    found = table.cast(pa.schema([pa.field(f.name, wide.get(f.type, f.type)) for f in table.schema])).combine_chunks().to_batches()
    if len(found) != 1:
        raise ValueError(f"the rows of one key are too many for one batch: {len(found)}")
    return found[0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes of a binary column and its offsets."""
    n = len(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    b = column.buffers()
    offsets = np.frombuffer(b[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(b[2], np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def _band_pairs(run_end: np.ndarray, size: np.ndarray, t: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of the same run, sizes ascending within it, whose sizes allow similarity t."""
    n = len(size)
    # the last row of the run whose size is within reach: runs are sorted by size
    start = np.concatenate([[0], np.flatnonzero(np.diff(run_end)) + 1]) if n else np.zeros(0, np.int64)
    run = np.searchsorted(start, np.arange(n), "right") - 1
    span = float(size.max()) * 2 + 4 if n else 1.0
    reach = np.searchsorted(run * span + size, run * span + np.floor(size / t + 1e-9), "right")
    todo = np.minimum(reach, run_end) - np.arange(n) - 1
    a = 0
    total = np.concatenate([[0], np.cumsum(todo)])
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        k = todo[a:b]
        if k.sum():
            left = np.repeat(np.arange(a, b), k)
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        a = b


def _least_overlap(sa: np.ndarray, sb: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (sa + sb) - 1e-9)


def _bound(data: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of each pair, from its bitmaps."""
    words = data.view(np.uint64)
    begin, width = at[:-1] // 8, np.diff(at) // 8
    out = np.zeros(len(a), np.int64)
    for wa, wb in {*zip(width[a].tolist(), width[b].tolist())}:
        here = np.flatnonzero((width[a] == wa) & (width[b] == wb))
        w = min(wa, wb)
        for p in range(0, len(here), max(1, (1 << 21) // max(wa, wb))):
            i = here[p : p + max(1, (1 << 21) // max(wa, wb))]
            # a wider parity bitmap folds to a narrower one
            x = np.bitwise_xor.reduce(words[begin[a[i]][:, None] + np.arange(wa)].reshape(len(i), -1, w), 1)
            y = np.bitwise_xor.reduce(words[begin[b[i]][:, None] + np.arange(wb)].reshape(len(i), -1, w), 1)
            out[i] = (size[a[i]] + size[b[i]] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
    return np.minimum(out, np.minimum(size[a], size[b]))


def _first_meeting(minima: np.ndarray, a: np.ndarray, b: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Whether this is the first tile where the pair meets."""
    return (minima[a] == minima[b]).argmax(1) == nth[a]


def _met(run_end: np.ndarray, size: np.ndarray, part: np.ndarray, nth: np.ndarray, minima: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each cell that are for it to settle, whose sizes allow similarity t."""
    for a, b in _band_pairs(run_end, size, t):
        ok = (part[a] == 0) | (part[a] != part[b])
        a, b = a[ok], b[ok]
        ok = _first_meeting(minima, a, b, nth)
        yield a[ok], b[ok]


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows sorted by (cell, size, sid), each set of a cell once, and no cell of one set."""
    cell, sid = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    once = np.concatenate([[True], (cell[1:] != cell[:-1]) | (sid[1:] != sid[:-1])])
    if not once.all():
        batch = batch.filter(pa.array(once))
        cell = cell[once]
    edge = np.concatenate([[True], cell[1:] != cell[:-1]])
    alone = edge & np.append(edge[1:], True)
    return batch.filter(pa.array(~alone)) if alone.any() else batch


def _candidates(placed: DataFrame, t: float, hashes: int) -> DataFrame:
    """cell, sid, nth, part and m of the sets that have a pair within the bound in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches, 0):
            batch = _once(whole)
            if not batch.num_rows:
                continue
            cell, size, _, nth, part = (batch.column(k).to_numpy() for k in range(5))
            size = size.astype(np.int64)
            minima = np.frombuffer(_bytes_of(batch.column(6))[0].tobytes(), np.uint32).reshape(-1, hashes)
            data, at = _bytes_of(batch.column(7))
            data = np.ascontiguousarray(data)
            hit = np.zeros(len(cell), bool)
            for a, b in _met(_run_ends(cell), size, part, nth, minima, t):
                ok = _bound(data, at, size, a, b) >= _least_overlap(size[a], size[b], t)
                hit[a[ok]] = hit[b[ok]] = True
            if hit.any():
                names = ["cell", "sid", "nth", "part", "m"]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)).filter(pa.array(hit)) for x in names], names=names)

    sized = placed.select("cell", "size", "sid", "nth", "part", "m", "short", "data").repartition("cell").sortWithinPartitions("cell", "size", "sid")
    return sized.mapInArrow(lambda batches: tk.released(run(batches)), "cell bigint, sid bigint, nth int, part int, m bigint")


def _run_ends(cell: np.ndarray) -> np.ndarray:
    return np.searchsorted(cell, cell, "right")


def _sparse_overlap(grams: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of pairs of sorted sets: each gram of b is searched in a's."""
    size = np.diff(at)
    out = np.zeros(len(a), np.int64)
    total = np.concatenate([[0], np.cumsum(size[b] + 1)])
    p = 0
    while p < len(a):
        q = min(len(a), p + 60_000, max(p + 1, int(np.searchsorted(total, total[p] + (4 << 20), "right")) - 1))
        rows, own = np.unique(a[p:q], return_inverse=True)
        tag = np.uint64(48)
        known = tk.gather(grams, at[rows], size[rows]) | np.repeat(np.arange(len(rows), dtype=np.uint64), size[rows]) << tag
        n = size[b[p:q]]
        asked = tk.gather(grams, at[b[p:q]], n) | np.repeat(own.astype(np.uint64), n) << tag
        found = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        out[p:q] = np.add.reduceat(found.astype(np.int64), np.cumsum(n) - n)
        p = q
    return out


class _Ranked:
    """The sets of one cell as rows of bits, one for each gram that two of them have."""

    def __init__(self, grams: np.ndarray, size: np.ndarray):
        _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1
        shared = count[which] > 1
        self.row, self.rank = np.repeat(np.arange(len(size)), size)[shared], rank[which[shared]]
        self.rows, self.width = len(size), int(rank[-1]) + 1 if len(rank) else 0

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        step = max(512, (24 << 20) // max(1, self.rows) // 64 * 64)
        for c in range(0, self.width, step):
            here = (self.rank >= c) & (self.rank < c + step)
            wide = -(-min(step, self.width - c) // 64) * 64
            flags = np.zeros((self.rows, wide), np.uint8)
            flags[self.row[here], self.rank[here] - c] = 1
            bits = np.packbits(flags, axis=1).view(np.uint64)
            block = max(1, (2 << 20) // bits.shape[1])
            for p in range(0, len(a), block):
                out[p : p + block] += np.bitwise_count(bits[a[p : p + block]] & bits[b[p : p + block]]).sum(1, dtype=np.int64)
        return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row connected to each row."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _settle(shipped: DataFrame, t: float, hashes: int, pairs: bool) -> DataFrame:
    """The similar pairs of each cell with their exact similarity, or the links of its sets."""

    def similar(a: np.ndarray, b: np.ndarray, same: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        ok = same >= _least_overlap(size[a], size[b], t)
        return a[ok], b[ok], same[ok] / (size[a[ok]] + size[b[ok]] - same[ok])

    def listed(sid: np.ndarray, a: np.ndarray, b: np.ndarray, jac: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b]), pa.array(jac)], names=["a", "b", "jaccard"])

    def settled(sid: np.ndarray, m: np.ndarray, found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        links, label = np.zeros(len(sid)), np.arange(len(sid))
        for a, b, jac in found:
            if pairs:
                yield listed(sid, a, b, jac)
            elif len(a):
                links += np.bincount(a, m[b], len(sid)) + np.bincount(b, m[a], len(sid))
                label = _roots(len(sid), np.append(a, np.arange(len(sid))), np.append(b, label))
        some = np.flatnonzero(links > 0)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(sid[label[some]]), pa.array(links[some].astype(np.int64))], names=["sid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches, 0):
            batch = _once(whole)
            if not batch.num_rows:
                continue
            cell, size, sid, nth, part, m = (batch.column(k).to_numpy() for k in range(6))
            size = size.astype(np.int64)
            minima = np.frombuffer(_bytes_of(batch.column(6))[0].tobytes(), np.uint32).reshape(-1, hashes)
            raw, at = _bytes_of(batch.column(7))
            six = np.zeros((len(raw) // 6, 8), np.uint8)
            six[:, :6] = raw.reshape(-1, 6)
            grams, at = six.reshape(-1).view(np.uint64), at // 6
            head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            tail = np.append(head[1:], len(cell))
            little = np.flatnonzero(np.repeat(tail - head <= _SMALL, tail - head))
            met = _met(_run_ends(cell[little]), size[little], part[little], nth[little], minima[little], t)
            yield from settled(sid, m, (similar(little[a], little[b], _sparse_overlap(grams, at, little[a], little[b]), size) for a, b in met))
            for x, y in zip(head.tolist(), tail.tolist()):
                if y - x > _SMALL:
                    ranked = _Ranked(grams[at[x] : at[y]], size[x:y])
                    met = _met(np.full(y - x, y - x), size[x:y], part[x:y], nth[x:y], minima[x:y], t)
                    yield from settled(sid[x:y], m[x:y], (similar(a, b, ranked.overlaps(a, b), size[x:y]) for a, b in met))

    picked = shipped.select("cell", "size", "sid", "nth", "part", "m", "short", "data").repartition("cell").sortWithinPartitions("cell", "size", "sid")
    return picked.mapInArrow(lambda batches: tk.released(run(batches)), PAIR_SCHEMA if pairs else LINK_SCHEMA)


def _sets(docs: DataFrame, n: int, hashes: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The documents (sid, doc_id, h), each once; and the sets: sid, their least document, its text's hash, number of documents m, size, minima, bitmap."""
    sketch = stage(_sketch(docs, text, doc_id, n, hashes, False), "sketch")
    members = sketch.select("sid", "doc_id", "h").distinct()
    count = members.groupBy("sid").agg(F.count("*").alias("m"))
    least = sketch.groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "minima", "short", "data")])
    return members, stage(least.join(count, "sid"), "sets")


def _settled(docs: DataFrame, sets: DataFrame, threshold: float, n: int, hashes: int, text: str, doc_id: str, block_rows: int, broadcast_rows: int, pairs: bool) -> DataFrame:
    light = _cells(sets.select("sid", "minima"), hashes, block_rows)
    found = stage(_candidates(light.join(sets.select("sid", "size", "m", "short", "data"), "sid"), threshold, hashes), "cells")
    wanted = found.select("sid").distinct().join(sets.select("sid", "rep.doc_id", "rep.h"), "sid").select("doc_id", "h")
    wanted = stage(wanted, "wanted")
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # a row has 16 bytes
    near = own.join(F.broadcast(wanted) if rows_of(wanted, broadcast_rows) else wanted, ["doc_id", "h"], "left_semi")
    grams = _sketch(near, "text", "doc_id", n, hashes, True)
    return _settle(grams.select("sid", "size", "short", "data").join(found, "sid"), threshold, hashes, pairs)


def jaccard_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, hashes: int = 16, text: str = "text", doc_id: str = "doc_id", block_rows: int = 4096, broadcast_rows: int = 400_000) -> DataFrame:
    """doc_id, near_id and jaccard: the pairs of different sets of similarity `threshold` or more, each by the least documents of the two; and each further document of a set beside its least one, at 1.

    Cases are those of near_classes(). Two documents of one id that are similar
    give a row with that id twice.
    """
    members, sets = _sets(docs, n, hashes, text, doc_id)
    found = _settled(docs, sets, threshold, n, hashes, text, doc_id, block_rows, broadcast_rows, True)
    name = sets.select("sid", F.col("rep.doc_id").alias("id"))
    near = found.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("near_id"), "jaccard")
    several = sets.where("m > 1").select("sid", "rep")
    copies = members.join(several, "sid").where(F.struct("doc_id", "h") != F.col("rep")).select(F.col("rep.doc_id").alias("doc_id"), F.col("doc_id").alias("near_id"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies)


def _classes(docs: DataFrame, threshold: float, n: int, hashes: int, text: str, doc_id: str, block_rows: int, broadcast_rows: int) -> DataFrame:
    """doc_id, h, kept (the least document of the class) and n_links of each document with a link."""
    members, sets = _sets(docs, n, hashes, text, doc_id)
    found = stage(_settled(docs, sets, threshold, n, hashes, text, doc_id, block_rows, broadcast_rows, False), "links")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    linked = components(found.select("sid", "root"), "sid", "root").select(F.col("node").alias("sid"), "component")
    some = sets.select("sid", "rep", "m").join(links, "sid", "left").join(linked, "sid", "left").where("m > 1 OR links IS NOT NULL")
    some = stage(some.select("sid", "rep", F.coalesce("component", "sid").alias("component"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    kept = some.groupBy("component").agg(F.min("rep").alias("kept"))
    return members.join(some.join(kept, "component").select("sid", "kept", "n_links"), "sid").select("doc_id", "h", "kept", "n_links")


def near_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, hashes: int = 16, text: str = "text", doc_id: str = "doc_id", block_rows: int = 4096, broadcast_rows: int = 400_000) -> DataFrame:
    """doc_id, class_id and n_links: a row for each document that another one is similar to.

    n_links is the number of other documents of Jaccard similarity `threshold` or
    more; documents linked through any chain have one class, named by its least
    doc_id. Documents without a link have no row.

    A document is an id with a text: repeated rows of both are one document, and
    rows of one id with different texts are compared as different documents, each
    with a row. The texts of the documents in candidate pairs are found again by a
    broadcast of their keys up to broadcast_rows of them, and beyond by a shuffled
    join.

    Nulls: documents without id or text have no row, nor have texts without a
    letter or digit. Very long texts count whole. Similarity equal to the
    threshold counts; the classes don't depend on the order of rows. An empty
    table gives no row. Other columns are not read.
    """
    found = _classes(docs, threshold, n, hashes, text, doc_id, block_rows, broadcast_rows)
    return found.select("doc_id", F.col("kept.doc_id").alias("class_id"), "n_links")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and the least node connected to it, by alternating large and small stars.

    Each round is written to the shared folder, until one changes nothing; rounds
    grow with the logarithm of a component's size.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        e = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.5, n: int = 3, hashes: int = 16, text: str = "text", doc_id: str = "doc_id", once: bool = False, broadcast_rows: int = 400_000) -> DataFrame:
    """The documents without those that are near another of lower id, through any chain of pairs.

    A document is an id with a text, known by the id and a 64-bit hash of the text:
    rows of one id with different texts stay or go each on their own, and of those
    that are near each other one stays. Repeated rows of one id and text stay or go
    together; with `once`, one row of each is left, the least by its other columns.

    Nulls: documents without id or text, or without a letter or digit in it, are
    near no other and stay. Very long texts count whole. Of a class the least id
    stays, and of equal ids the least hash. An empty table gives an empty table.
    Other columns pass through, whatever their names.
    """
    own, words = F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string")
    i, h = _free(docs.columns, 2)

    def keyed(rows: DataFrame) -> tuple[DataFrame, Column]:
        side = F.broadcast(rows) if rows_of(rows, broadcast_rows) else rows
        return side, (own == F.col(i)) & (F.xxhash64(words) == F.col(h))

    found = _classes(docs, threshold, n, hashes, text, doc_id, 4096, broadcast_rows)
    gone = stage(found.where(F.struct("doc_id", "h") != F.col("kept")).select(F.col("doc_id").alias(i), F.col("h").alias(h)), "gone")
    left = docs.join(*keyed(gone), "left_anti")
    if not once:
        return left
    copied = stage(docs.where(own.isNotNull() & words.isNotNull()).groupBy(own.alias(i), F.xxhash64(words).alias(h)).agg(F.count("*").alias("n")).where("n > 1").select(i, h), "copied")
    row = _free(docs.columns, 3)[2]
    every = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    again = left.join(*keyed(copied), "left_semi").groupBy(own.alias(i), F.xxhash64(words).alias(h))
    first = again.agg(F.min_by(F.struct(*every), order).alias(row)).select(f"{row}.*")
    return left.join(*keyed(copied), "left_anti").unionByName(first)


def _free(columns: list[str], n: int) -> list[str]:
    """Names that the columns don't have."""
    taken, out, k = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if (name := f"_x{k}") not in taken:
            out.append(name)
        k += 1
    return out
