"""Exact search over packed blocks: single precision finds what may be among the nearest, double precision decides.

A block is one row of bytes, so it is converted once and travels whole. Each pair of
blocks is a partition of its own. In a task, memory is bounded by the two blocks and
a tile of products, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of vectors in a block; a task holds two blocks.
BLOCK_ROWS = 65_536
_ROWS, _FIRST, _TILE, _PAIRS = 1024, 2048, 8192, 1 << 16


class Ranking(NamedTuple):
    """How pairs of rows rank: shift + scale * (left . right) is about the distance, and exact tells it.

    left and right give the features of some rows; exact gets positions of both
    sides and gives infinity for pairs that don't count. grain: the unit to which
    exact distances are rounded.
    """

    left: Callable[[slice], np.ndarray]
    right: Callable[[slice], np.ndarray]
    shift: Callable[[slice], np.ndarray]
    scale: float
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
    grain: float


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def longest(x: np.ndarray) -> float:
    """The greatest length of the rows, 1 if all are 0."""
    most = max((float(dot(y := x[s : s + _TILE].astype(np.float64), y).max()) for s in range(0, len(x), _TILE)), default=0.0)
    return most**0.5 or 1.0


def ranking(q: np.ndarray, x: np.ndarray, metric: str, digits: int, counts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Ranking:
    """The ranking by a metric; counts: which pairs of positions do."""
    unit = lambda y: y / np.maximum(np.sqrt(dot(y, y)), 1e-30)[:, None]
    doubles = lambda y, s: y[s].astype(np.float64)
    if metric == "l2":
        mean = np.mean(x, axis=0, dtype=np.float64)
        size = max(longest(q - mean), longest(x - mean))
        near = lambda y, s: (doubles(y, s) - mean) / size
        left = lambda s: np.concatenate([y := -near(q, s), np.ones((len(y), 1))], 1)
        right = lambda s: np.concatenate([y := near(x, s), dot(y, y)[:, None] / 2], 1)
        shift, scale = (lambda s: dot(y := near(q, s), y) * size**2), 2 * size**2
    elif metric == "cosine":
        left, right = (lambda s: -unit(doubles(q, s))), (lambda s: unit(doubles(x, s)))
        shift, scale = (lambda s: np.ones(len(q[s]))), 1.0
    else:
        a, b = longest(q), longest(x)
        left, right = (lambda s: doubles(q, s) / -a), (lambda s: doubles(x, s) / b)
        shift, scale = (lambda s: np.ones(len(q[s]))), a * b

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        y, z = doubles(q, r), doubles(x, c)
        if metric == "l2":
            y -= z
            d = dot(y, y)
        else:
            d = 1 - (dot(unit(y), unit(z)) if metric == "cosine" else dot(y, z))
        return np.where(counts(r, c), np.round(d, digits) + 0.0, np.inf)

    return Ranking(left, right, shift, scale, exact, 10.0**-digits)


def nearest(rank: Ranking, m: int, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k owners with the least distance to each of m rows; ties go by owner.

    owner: that of each column, in order; an owner counts once, with the nearest of
    its columns. A product in single precision can be off by no more than `slack`,
    so what isn't within it of the k-th distance needn't be looked at.
    """
    n = len(owner)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    b, length = None, 0.0
    for s in range(0, n, _TILE):
        part = rank.right(slice(s, s + _TILE))
        b = np.empty((n, part.shape[1]), np.float32) if b is None else b
        b[s : s + _TILE] = part
        length = max(length, float(dot(part, part).max()) ** 0.5)
    repeated = bool((owner[1:] == owner[:-1]).any())
    found = []
    for s in range(0, m, _ROWS):
        rows = slice(s, min(m, s + _ROWS))
        a = rank.left(rows)
        slack = (a.shape[1] + 8) * 2.0**-24 * np.sqrt(dot(a, a)) * length
        dist, place = _of_rows(rank, a.astype(np.float32), b, s, slack, rank.shift(rows), owner, repeated, k)
        r, c = np.nonzero(np.isfinite(dist))
        found.append((s + r, place[r, c], dist[r, c]))
    return tuple(np.concatenate(z) for z in zip(*found))


def _up(x: np.ndarray) -> np.ndarray:
    """No less than x, in single precision."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _of_rows(rank: Ranking, a: np.ndarray, b: np.ndarray, start: int, slack: np.ndarray, shift: np.ndarray, owner: np.ndarray, repeated: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    m, n = len(a), len(b)
    dist, place = np.full((m, k), np.inf), np.zeros((m, k), np.int64)
    most = np.full(m, -np.inf, np.float32)

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[rank.exact(start + r[i : i + _PAIRS], c[i : i + _PAIRS]) for i in range(0, len(r), _PAIRS)]])

    def first(h: np.ndarray, rows: np.ndarray, t: int) -> list[tuple]:
        """For rows without k distances yet: the k nearest of a tile; what doesn't count is left out and the row tried again."""
        own = owner[t : t + h.shape[1]]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        parts, todo = [], np.arange(len(rows))
        while len(todo):
            g = h[todo]
            by_owner = np.minimum.reduceat(g, heads, axis=1) if repeated else g
            j = min(k, by_owner.shape[1])
            kth = np.partition(by_owner, j - 1, axis=1)[:, j - 1]
            r, c = np.nonzero((g <= _up(kth + 2 * slack[rows[todo]] + rank.grain / rank.scale)[:, None]) & (g < np.inf))
            d = exact(rows[todo[r]], t + c)
            out = np.isinf(d)
            h[todo[r[out]], c[out]] = np.inf
            again = np.zeros(len(todo), bool)
            again[r[out]] = True
            ok = ~again[r]
            parts.append((rows[todo[r[ok]]], t + c[ok], d[ok]))
            todo = todo[again]
        return parts

    t = 0
    while t < n:
        u = min(n, t + (_TILE if t else _FIRST))
        h = a @ b[t:u].T
        r, c = np.divmod(np.flatnonzero(h <= most[:, None]), u - t)
        parts = [(r, t + c, exact(r, t + c))]
        few = np.flatnonzero(np.isinf(dist[:, -1]))
        if len(few):
            parts += first(h[few], few, t)
        r, c, d = (np.concatenate(z) for z in zip(*parts))
        keep = np.flatnonzero(d < dist[r, -1])
        keep = keep[np.argsort(r[keep], kind="stable")]
        r, c, d = r[keep], c[keep], d[keep]
        if len(r):
            rows, heads, count = np.unique(r, return_index=True, return_counts=True)
            all_d = np.concatenate([dist[rows], np.full((len(rows), count.max()), np.inf)], 1)
            all_c = np.concatenate([place[rows], np.zeros((len(rows), count.max()), np.int64)], 1)
            at, pos = np.repeat(np.arange(len(rows)), count), k + np.arange(len(r)) - np.repeat(heads, count)
            all_d[at, pos], all_c[at, pos] = d, c
            if repeated:
                own = owner[all_c]
                order = np.lexsort((all_d, own), axis=1)
                all_d, all_c, own = (np.take_along_axis(z, order, 1) for z in (all_d, all_c, own))
                all_d[:, 1:][own[:, 1:] == own[:, :-1]] = np.inf
            # columns are in the order of owners, and those of earlier tiles come first
            order = np.argsort(all_d, axis=1, kind="stable")[:, :k]
            dist[rows], place[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_c, order, 1)
            full = rows[np.isfinite(dist[rows, -1])]
            most[full] = _up((dist[full, -1] - shift[full]) / rank.scale + slack[full])
        t = u
    return dist, place


def finite(x: np.ndarray) -> np.ndarray:
    """Rows without an infinite element or one that is no number."""
    return np.isfinite(x).all(1)


def pack(rows: DataFrame, **columns: str) -> DataFrame:
    """block and each column's bytes in order of id, one row for each block. columns: the kind of each, v for vectors.

    Vectors are written in single precision where that is all they have.
    """
    out = pa.schema([("block", pa.int32()), ("rows", pa.int64()), *[(c, pa.binary()) for c in columns]])

    def run(one: pa.Table) -> pa.Table:
        one = one.sort_by("id")
        packed = {}
        for c, kind in columns.items():
            values = one.column(c).combine_chunks()
            if kind == "v":
                sizes = pc.list_value_length(values)
                if values.null_count or pc.count_distinct(sizes).as_py() > 1:
                    raise ValueError("vectors of one table must have one length")
                x = values.flatten().to_numpy(zero_copy_only=False)
                if x.dtype != np.float32 and np.array_equal(y := x.astype(np.float32), x):
                    x = y
                packed[c] = bytes([x.itemsize] * 8) + x.tobytes()
            elif kind == "binary":
                packed[c] = b"".join(values.to_pylist())
            else:
                packed[c] = values.to_numpy(zero_copy_only=False).tobytes()
        return pa.Table.from_pylist([{"block": one.column("block")[0].as_py(), "rows": one.num_rows} | packed], out)

    return rows.select("block", "id", *[c for c in columns if c != "id"]).groupBy("block").applyInArrow(run, "block int, rows bigint, " + ", ".join(f"{c} binary" for c in columns))


def vectors(data: bytes | pa.Buffer, rows: int) -> np.ndarray:
    """Packed vectors, of the precision that their first byte tells."""
    return np.frombuffer(data, np.float32 if data[0] == 4 else np.float64, offset=8).reshape(rows, -1)


def cores(df: DataFrame) -> int:
    try:
        return df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # a remote session doesn't tell
        return 16


def blocks(df: DataFrame, queries: int, data: int, most: int) -> tuple[int, int]:
    """How many blocks of queries and of data: of `most` rows, and as many pairs as keep all cores busy."""
    nd = max(1, -(-data // most))
    return max(1, -(-queries // most), min(queries // 1024, -(-2 * cores(df) // nd))), nd


def block_of(n: int, *key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def pairs(left: DataFrame, right: DataFrame, nl: int, nr: int, compare: Callable[[list[dict], list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What compare makes of each of nl blocks on the left and nr on the right, by their column block; a task has one pair.

    compare gets the rows of both sides, with the bytes of binary columns as they lie
    in memory.
    """
    index = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.select("*", index(nr).alias("other")).select((F.col("block") * nr + F.col("other")).alias("pair"), F.lit(True).alias("asks"), *[c for c in left.columns if c != "block"])
    two = right.select("*", index(nl).alias("other")).select((F.col("other") * nr + F.col("block")).alias("pair"), F.lit(False).alias("asks"), *[c for c in right.columns if c != "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[dict]] = {True: [], False: []}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: (v.as_buffer() if v.is_valid else None) if pa.types.is_binary((v := batch.column(j)[i]).type) else v.as_py() for j, f in enumerate(batch.schema)}
                sides[row["asks"]].append(row)
        if sides[True] and sides[False]:
            yield from compare(sides[True], sides[False])

    return one.unionByName(two, allowMissingColumns=True).repartitionById(nl * nr, "pair").mapInArrow(run, schema)
