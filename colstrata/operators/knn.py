"""Exact nearest neighbours by blocks of vectors, and the quantised forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan
from .scan import BLOCK_ROWS

_NO_PAIRS = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block, without vectors that have no distance to any."""
    ids = np.frombuffer(block["id"], np.int64)
    x = scan.vectors(block["v"], len(ids))
    good = scan.finite(x)
    return (ids, x) if good.all() else (ids[good], x[good])


def top_k(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", digits: int = 6, same_set: bool = True, block_rows: int = BLOCK_ROWS, owner: str | None = None) -> DataFrame:
    """query_id, vec_id and dist of the k nearest vectors, for (id, v) of both sides.

    Distances are rounded before ranking; ties go by id. Pairs of packed blocks are
    compared in tasks of their own, and keep k candidates a query; no side is
    broadcast. same_set: a vector isn't its own neighbour. owner: a column of
    `data` to report and rank instead of the id, with the least distance of its
    vectors.
    """
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError("metric must be l2, ip or cosine")
    nq, nd = scan.blocks(data, queries.count(), data.count(), block_rows)
    target = owner or "id"
    left = scan.pack(queries.select(scan.block_of(nq, "id").alias("block"), F.col("id").cast("bigint").alias("id"), "v"), id="bigint", v="v")
    right = scan.pack(data.select(scan.block_of(nd, target).alias("block"), F.col(target).cast("bigint").alias("id"), "v"), id="bigint", v="v")

    def compare(a: list[dict], b: list[dict]) -> Iterator[pa.RecordBatch]:
        (qi, q), (xi, x) = _matrix(a[0]), _matrix(b[0])
        counts = (lambda r, c: qi[r] != xi[c]) if same_set else (lambda r, c: np.ones(len(r), bool))
        r, c, d = scan.nearest(scan.ranking(q, x, metric, digits, counts), len(qi), xi, k) if len(qi) and len(xi) else _NO_PAIRS
        yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[c]), pa.array(d)], names=["query_id", "vec_id", "dist"])

    found = scan.pairs(left, right, nq, nd, compare, "query_id bigint, vec_id bigint, dist double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def plan(filtered: float, total: float, k: int, ef: int, indexed: bool = True, shard_rows: int | None = None) -> str:
    """exact or graph: a graph search pays only where it visits fewer vectors than pass the filter.

    shard_rows: the graphs are of so many vectors each, so the rule holds for a
    shard and its share of those that pass.
    """
    if not indexed:
        return "exact"
    if shard_rows:
        shards = max(1, -(-total // shard_rows))
        filtered, total = filtered / shards, total / shards
    if filtered <= 0:
        return "graph" if total > max(k, ef) else "exact"
    visited = max(k, ef) * total / filtered
    return "exact" if filtered <= visited * max(1.0, np.log2(max(2, total))) else "graph"


def check_vectors(table: DataFrame, key: str, vector: str, dims: int, multi: bool = False) -> DataFrame:
    """key and problem of the rows whose vectors don't fit."""
    n = F.size(vector)
    bad = (
        F.when(F.col(vector).isNull(), "null")
        .when(n == 0, "empty")
        .when((n % dims != 0) if multi else (n != dims), "length")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    )
    return table.select(key, bad.alias("problem")).where("problem IS NOT NULL")


class RaBitQ:
    """Sign bits around a centroid for stored vectors, 4-bit queries, and an unbiased estimate of distances.

    After a random rotation, a stored vector keeps one bit a dimension, its
    distance to the centroid, and the correlation of its bits with itself; a query
    keeps 4 bits a dimension, and products of bits and small numbers estimate the
    dot product (arXiv 2405.12497).
    """

    def __init__(self, dims: int, centroid: np.ndarray, seed: int = 11):
        self.dims, self.padded = dims, -(-dims // 64) * 64
        self.centroid = np.asarray(centroid, float)
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0]

    def _rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.zeros((len(x), self.padded))
        c[:, : self.dims] = x - self.centroid
        n = np.sqrt((c * c).sum(1))
        return (c / np.maximum(n, 1e-30)[:, None]) @ self.rotation, n

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, distance to the centroid, and correlation of each vector."""
        r, n = self._rotated(x)
        bits = r > 0
        signs = np.where(bits, 1.0, -1.0) / np.sqrt(self.padded)
        return np.packbits(bits, axis=1), n, np.maximum((r * signs).sum(1), 1e-12)

    def estimate(self, q: np.ndarray, packed: np.ndarray, norm: np.ndarray, corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of queries to stored vectors, and their error bounds."""
        r, n = self._rotated(q)
        low = r.min(1, keepdims=True)
        step = np.maximum((r.max(1, keepdims=True) - low) / 15, 1e-30)
        code = np.round((r - low) / step)
        bits = np.unpackbits(packed, axis=1).astype(float)
        ones = bits.sum(1)
        d = self.padded
        dot = (2 * step * (code @ bits.T) + 2 * low * ones[None, :] - step * code.sum(1, keepdims=True) - d * low) / np.sqrt(d)
        est = dot / corr[None, :]
        wide = np.sqrt((1 - np.minimum(corr, 1) ** 2) / (d - 1))[None, :] / corr[None, :] * 1.9
        scale = 2 * n[:, None] * norm[None, :]
        return n[:, None] ** 2 + norm[None, :] ** 2 - scale * est, scale * wide

    def features(self, q: np.ndarray) -> np.ndarray:
        """Of queries: their products with stored() are the bounds of estimate(), less the query's own part."""
        r, n = self._rotated(q)
        low = r.min(1, keepdims=True)
        step = np.maximum((r.max(1, keepdims=True) - low) / 15, 1e-30)
        return np.concatenate([np.ones((len(q), 1)), n[:, None], n[:, None] * (low + step * np.round((r - low) / step))], 1)

    def stored(self, packed: np.ndarray, norm: np.ndarray, corr: np.ndarray, square: np.ndarray, metric: str, side: int = 1) -> Callable[[slice | np.ndarray], np.ndarray]:
        """Features of some stored vectors. side: 1 for the greatest possible distance, -1 for the least."""
        d, half = self.padded, 2 if metric == "ip" else 1

        def of(s: slice | np.ndarray) -> np.ndarray:
            m, c = norm[s], corr[s]
            wide = np.sqrt((1 - np.minimum(c, 1) ** 2) / (d - 1)) / c * 1.9
            signs = 2.0 * np.unpackbits(packed[s], axis=1) - 1
            own = m**2 - (square[s] if metric == "ip" else 0)
            return np.concatenate([own[:, None], side * (2 * m * wide)[:, None], signs * (-2 * m / c / np.sqrt(d))[:, None]], 1) / half

        return of


def rabitq_top_k(table: DataFrame, k: int, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, vec_id and dist of the k nearest, from codes whose error bounds decide which vectors are looked at.

    Vectors are encoded once. Each pair of blocks compares queries with codes, and
    reports the k least of the greatest possible distances; the k-th of all blocks
    decides. A second comparison takes the k nearest by exact distance among those
    whose least possible distance is no more than that. What lies within the bounds
    may be a large share of all pairs, so it stays in the task that meets it: no
    more than k rows a query leave a pair of blocks.
    """
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, dist double")
    rows = rows.where(F.size("v") == dims)
    mean = rows.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("p").collect()
    coder = RaBitQ(dims, np.array([r["m"] for r in mean]))
    n = rows.count()
    nq, nd = scan.blocks(table, n, n, block_rows)

    def encode(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            packed, norm, corr = coder.encode(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(norm), pa.array(corr), pa.array((x * x).sum(1))], names=["id", "v", "code", "norm", "corr", "square"])

    coded = rows.mapInArrow(encode, "id bigint, v array<float>, code binary, norm double, corr double, square double").withColumn("block", scan.block_of(nd, "id"))
    codes = {"id": "bigint", "code": "binary", "norm": "double", "corr": "double", "square": "double"}
    asked = rows.withColumn("block", scan.block_of(nq, "id"))

    def read(a: dict, b: dict) -> tuple[np.ndarray, ...]:
        qi, xi = np.frombuffer(a["id"], np.int64), np.frombuffer(b["id"], np.int64)
        norm, corr, square = (np.frombuffer(b[c], np.float64) for c in ("norm", "corr", "square"))
        return qi, scan.vectors(a["v"], len(qi)), xi, (np.frombuffer(b["code"], np.uint8).reshape(len(xi), -1), norm, corr, square)

    def bounds(a: list[dict], b: list[dict]) -> Iterator[pa.RecordBatch]:
        qi, q, xi, stored = read(a[0], b[0])
        left, right = coder.features(q), coder.stored(*stored, metric)
        size = scan.longest(left)
        exact = lambda r, c: np.where(qi[r] != xi[c], scan.dot(left[r], right(c)), np.inf)
        rank = scan.Ranking(lambda s: left[s] / size, right, lambda s: np.zeros(len(left[s])), size, exact, 0.0)
        r, _, high = scan.nearest(rank, len(qi), xi, k)
        yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(high)], names=["id", "high"])

    high = scan.pairs(scan.pack(asked, id="bigint", v="v"), scan.pack(coded, **codes), nq, nd, bounds, "id bigint, high double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("high"))
    most = high.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("id").agg(F.max("high").alias("most"))

    def compare(a: list[dict], b: list[dict]) -> Iterator[pa.RecordBatch]:
        qi, q, xi, stored = read(a[0], b[0])
        x, most = scan.vectors(b[0]["v"], len(xi)), np.frombuffer(a[0]["most"], np.float64)
        left, least = coder.features(q), coder.stored(*stored, metric, -1)
        counts = lambda r, c: (qi[r] != xi[c]) & (scan.dot(left[r], least(c)) <= most[r])
        r, c, d = scan.nearest(scan.ranking(q, x, metric, 6, counts), len(qi), xi, k)
        yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[c]), pa.array(d)], names=["query_id", "vec_id", "dist"])

    near = scan.pairs(scan.pack(asked.join(most, "id"), id="bigint", v="v", most="double"), scan.pack(coded, **codes, v="v"), nq, nd, compare, "query_id bigint, vec_id bigint, dist double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
