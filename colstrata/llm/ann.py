"""Approximate nearest neighbours: a navigable small-world graph for each shard, results merged.

Vectors go to the cell of their nearest centroid, and a cell of more than shard_rows
vectors is split into shards by a hash of the id, so a crowded place is many shards.
A shard's hierarchy of graphs is stored in flat neighbour arrays, one row a shard. A
query is searched in all shards of the cells whose centroids are nearest to it, and
the shards' best are merged by distance and id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import Layer, build_graph, search_graph
from .jaccard import _grouped
from .staging import stage

SCHEMA = "vec_id bigint, rank int, neighbour_id bigint, distance double"
GRAPH_SCHEMA = "cell int, shard int, ids binary, vectors binary, nodes array<binary>, links array<binary>"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float32).reshape(-1, dims)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Means of the vectors nearest to each of `cells` centres, by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = _cells_of(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _cells_of(x: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The cells of the `most` nearest centroids of each vector, nearest first."""
    out = np.empty((len(x), most), np.int32)
    norms = (centroids * centroids).sum(1)
    for a in range(0, len(x), 4096):
        d = norms[None, :] - 2 * x[a : a + 4096] @ centroids.T
        out[a : a + 4096] = np.argsort(d, axis=1, kind="stable")[:, :most]
    return out


def fit_probes(x: np.ndarray, centroids: np.ndarray, k: int, coverage: float, most: int = 512) -> int:
    """How many cells to search so that `coverage` of the true k nearest of `most` of the vectors lie in them."""
    asked = x[:: max(1, len(x) // most)][:most]
    d = (x * x).sum(1)[None, :] - 2 * asked @ x.T
    d[np.arange(len(asked)), np.arange(0, len(x), max(1, len(x) // most))[: len(asked)]] = np.inf
    near = min(k, len(x) - 1)
    if near < 1:
        return len(centroids)
    true = np.argpartition(d, near - 1, axis=1)[:, :near]
    own = _cells_of(x, centroids, 1)[:, 0]
    order = _cells_of(asked, centroids, len(centroids))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids), dtype=np.int32)[None, :], 1)
    ranks = np.sort(np.take_along_axis(rank, own[true], 1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(coverage * len(ranks))))]) + 1


def _clean(table: DataFrame, metric: str, vec_id: str, vector: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size(v) > 0) & finite)
    return rows.where(F.exists(v, lambda x: x != 0)) if metric == "cosine" else rows


def _placed(rows: DataFrame, centroids: np.ndarray, metric: str, dims: int, most: int) -> DataFrame:
    """id, v and cells: the nearest ones of each vector."""

    def run(batches):
        for batch in batches:
            cells = _cells_of(_unit(_matrix(batch.column(1), dims), metric), centroids, most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * most), pa.array(cells.reshape(-1)))], names=["id", "v", "cells"])

    return rows.mapInArrow(run, "id bigint, v array<float>, cells array<int>")


def _by_cell(counts: dict[int, int], cells: int, rows: int) -> Column:
    """How many parts of about `rows` rows each cell has, by the column `cell`."""
    parts = F.array(*[F.lit(max(1, -(-counts.get(c, 0) // rows))) for c in range(cells)])
    return F.get(parts, F.col("cell"))


def neighbours(
    table: DataFrame,
    queries: Column | None = None,
    among: Column | None = None,
    k: int = 10,
    m: int = 16,
    ef_build: int = 48,
    ef_search: int = 96,
    shard_rows: int = 10_000,
    cells: int | None = None,
    probes: int | None = None,
    coverage: float = 0.98,
    sample: int = 65_536,
    block_rows: int = 20_000,
    metric: str = "cosine",
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, rank from 1, neighbour_id and distance of the k nearest other vectors found for each query.

    queries: which rows are asked for, all by default; among: which rows can be
    found, all by default; both conditions on the table's own columns.
    metric: cosine (1 - cosine similarity) or l2 (squared distance).

    Centroids (`cells` of them, by default one for each shard_rows vectors and 1,024
    at most) are fitted on up to `sample` vectors by a hash of the id, which bounds
    what the driver holds; every vector is indexed. A query probes the `probes`
    nearest cells, by default as many as hold `coverage` of the true neighbours of
    512 vectors of the sample among its others, which is few where vectors form
    groups and most cells where they don't. A shard's graph is shipped once for each block of block_rows of
    its queries, so neither the vectors nor the queries of a crowded cell meet in
    one task.

    Nulls: rows without id, and vectors that are null, empty, of other than the
    most frequent dimension, with a null or infinite element, or (for cosine) of
    length 0 are in no result. Of several rows of one id the least vector counts.
    Distances are rounded to 6 digits; of those found that are equal, the least
    ids come first. Fewer than k others found give fewer rows; an empty table
    gives none. Other columns are not read but by the two conditions.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    spark = table.sparkSession
    stored = _clean(table if among is None else table.where(among), metric, vec_id, vector)
    sizes = stored.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    dims = sizes["d"]

    def once(rows: DataFrame) -> DataFrame:
        return rows.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))

    wanted = cells or max(1, min(1024, round(sizes["n"] / shard_rows)))
    picked = stored.where(F.size("v") == dims).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow()
    fitted = _unit(_matrix(picked.column("v").combine_chunks(), dims), metric)
    centroids = fit_centroids(fitted, wanted)
    wanted = len(centroids)
    probes = min(wanted, probes or fit_probes(fitted, centroids, k, coverage))
    own = stage(_placed(once(stored), centroids, metric, dims, 1).select("id", "v", F.col("cells")[0].alias("cell")), "vectors")
    # a row for each cell
    held = {r["cell"]: r["n"] for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shards = own.withColumn("shard", F.pmod(F.xxhash64("id"), _by_cell(held, wanted, shard_rows)).cast("int"))

    def build(batches):
        for batch in _grouped(batches, 0):
            cell, shard = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1])])), len(cell))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                one = batch.slice(a, b - a)
                x = _unit(_matrix(one.column(4), dims), metric)
                layers = build_graph(x, m, ef_build)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(cell[a])], pa.int32()),
                        pa.array([int(shard[a])], pa.int32()),
                        pa.array([one.column(3).to_numpy().tobytes()], pa.binary()),
                        pa.array([x.tobytes()], pa.binary()),
                        pa.array([[y.nodes.astype(np.int64).tobytes() for y in layers]], pa.list_(pa.binary())),
                        pa.array([[y.links.tobytes() for y in layers]], pa.list_(pa.binary())),
                    ],
                    names=["cell", "shard", "ids", "vectors", "nodes", "links"],
                )

    n_shards = sum(max(1, -(-n // shard_rows)) for n in held.values())
    placed = shards.select(F.xxhash64("cell", "shard").alias("key"), "cell", "shard", "id", "v").repartition(max(1, min(n_shards, 20_000)), "key").sortWithinPartitions("key", "id")
    graphs = stage(placed.mapInArrow(build, GRAPH_SCHEMA), "graphs")

    asked = own if queries is None and among is None else _placed(once(_clean(table if queries is None else table.where(queries), metric, vec_id, vector)), centroids, metric, dims, 1).select("id", "v")
    probed = stage(_placed(asked.select("id", "v"), centroids, metric, dims, probes).select("id", "v", F.explode("cells").alias("cell")), "queries")
    asks = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = _by_cell(asks, wanted, block_rows)
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = probed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")).select("id", "v", "cell", "block", span(_by_cell(held, wanted, shard_rows)).alias("shard"))
    right = graphs.select("*", span(blocks).alias("block"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        g = right.slice(0, 1).to_pylist()[0]
        ids = np.frombuffer(g["ids"], np.int64)
        x = np.frombuffer(g["vectors"], np.float32).reshape(-1, dims)
        layers = [Layer(n := np.frombuffer(a, np.int64), np.frombuffer(b, np.int32).reshape(len(n), -1)) for a, b in zip(g["nodes"], g["links"])]
        mine = left.column("id").to_numpy()
        i, d = search_graph(x, layers, _unit(_matrix(left.column("v").combine_chunks(), dims), metric), max(ef_search, k + 1))
        near = ids[np.maximum(i, 0)]
        d = np.where((i >= 0) & (near != mine[:, None]), np.round(d.astype(np.float64) / (2 if metric == "cosine" else 1), 6), np.inf)
        # ties among all that the beam found go by id
        best = np.lexsort((near, d), axis=1)[:, :k]
        d, near = np.take_along_axis(d, best, 1), np.take_along_axis(near, best, 1)
        r, c = np.nonzero(np.isfinite(d))
        return pa.table([mine[r], near[r, c], d[r, c]], schema=out)

    found = left.groupBy("cell", "shard", "block").cogroup(right.groupBy("cell", "shard", "block")).applyInArrow(find, "vec_id bigint, neighbour_id bigint, distance double")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")
