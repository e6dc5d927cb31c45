"""A stored index of vectors: a small-world graph for each shard, searched with or without a filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan
from .graph import Layer, build_graph, search_graph
from .knn import plan
from .quantile import Discoveries

VERSION = 1
METRICS = ("l2", "ip", "cosine")


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30) if metric == "cosine" else x


def _stored(x: np.ndarray, metric: str, longest: float) -> np.ndarray:
    """Vectors whose squared distances rank as the metric does; for products, one more element makes all as long."""
    if metric != "ip":
        return _unit(x, metric)
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1, keepdims=True), 0))], 1)


def write(table: DataFrame, path: str, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 10_000, m: int = 16, ef: int = 64) -> None:
    """Builds the graphs and stores them with what a search must know, one row a shard.

    Rows with a null id or vector, or of another length than the most, aren't indexed.
    """
    if metric not in METRICS:
        raise ValueError("metric must be l2, ip or cosine")
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest")).orderBy(F.desc("n"), "d").first()
    dims, n, longest = (sizes["d"], sizes["n"], sizes["longest"]) if sizes else (0, 0, 0.0)
    shards = max(1, -(-n // shard_rows))
    kind = pa.schema([("version", pa.int32()), ("metric", pa.string()), ("dims", pa.int32()), ("total", pa.int64()), ("shards", pa.int32()), ("longest", pa.float64()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])

    def build(one: pa.Table) -> pa.Table:
        one = one.sort_by("id")
        x = one.column("v").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, dims)
        layers = build_graph(_stored(x, metric, longest).astype(np.float32), m, ef)
        row = {"version": VERSION, "metric": metric, "dims": dims, "total": n, "shards": shards, "longest": longest, "shard": one.column("shard")[0].as_py(), "ids": one.column("id").to_numpy().tobytes(), "vectors": x.tobytes()}
        return pa.Table.from_pylist([row | {"nodes": [y.nodes.astype(np.int64).tobytes() for y in layers], "links": [y.links.tobytes() for y in layers]}], kind)

    placed = rows.where(F.size("v") == dims).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    made = placed.groupBy("shard").applyInArrow(build, "version int, metric string, dims int, total bigint, shards int, longest double, shard int, ids binary, vectors binary, nodes array<binary>, links array<binary>")
    made.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The stored graphs, and metric, dims, total and shards; an index of a later version is an error."""
    found = spark.read.parquet(path)
    head = found.select("version", "metric", "dims", "total", "shards", "longest").first()
    if head is None:
        return found, {"version": VERSION, "metric": "l2", "dims": 0, "total": 0, "shards": 0, "longest": 0.0}
    if head["version"] > VERSION:
        raise ValueError(f"the index in {path} is of a later version")
    return found, head.asDict()


def _least(k: int, row: np.ndarray, ids: np.ndarray, dist: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k entries of each row with the least distance, ties by id."""
    order = np.lexsort((ids, dist, row))
    by = row[order]
    order = order[np.arange(len(by)) - np.searchsorted(by, by) < k]
    return tuple(z[order] for z in (row, ids, dist, *rest))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, ef: int = 96, among: DataFrame | None = None, early: bool = False, same_set: bool = False, block_rows: int = 20_000, digits: int = 6) -> DataFrame:
    """query_id, vec_id, dist, distances and way of the k nearest found for each (id, v) of the queries.

    among: the one column of ids that may be found. A shard whose ids that may be
    found are few is scanned, by the rule of plan(), and else its graph is searched
    with a wider beam and what may not be found left out. Those that are scanned go
    through the exact search together. early: for k above 10, a
    query ends where it has stopped finding. distances: how many its shard computed
    for its block of queries; way: exact or graph. same_set: a vector isn't its own
    neighbour. Ties go by id.
    """
    stored, about = read(spark, path)
    schema = "query_id bigint, vec_id bigint, dist double, distances bigint, way string"
    if not about["shards"]:
        return spark.createDataFrame([], schema)
    metric, dims, shards, longest = about["metric"], about["dims"], about["shards"], about["longest"]
    asked = queries.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<float>").alias("v")).where(F.size("v") == dims)
    blocks = max(1, -(-queries.count() // block_rows))
    left = scan.pack(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")), id="bigint", v="v")
    # a task has as many shards as make a block of the exact search, and fewer where cores would be idle
    bundles = min(shards, max(-(-about["total"] // scan.BLOCK_ROWS), -(-4 * scan.cores(stored) // blocks)))
    kind = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("way", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())), ("may", pa.binary())])
    columns = ["shard", "ids", "vectors", "nodes", "links"]

    def planned(g: dict, own: np.ndarray | None) -> list[dict]:
        """The shard with its way, and what that needs; none if nothing in it may be found."""
        ids = np.frombuffer(g["ids"], np.int64)
        may = np.ones(len(ids), bool) if own is None else np.isin(ids, own)
        way = plan(int(may.sum()), len(ids), k, ef)
        if not may.any():
            return []
        row = {"block": g["shard"] % bundles, "shard": g["shard"], "way": way}
        if way == "exact":
            x = np.frombuffer(g["vectors"], np.float32).reshape(-1, dims)
            return [row | {"ids": ids[may].tobytes(), "vectors": x[may].tobytes()}]
        return [row | {c: g[c] for c in columns} | {"may": may.tobytes()}]

    fields = "block int, shard int, way string, ids binary, vectors binary, nodes array<binary>, links array<binary>, may binary"
    if among is None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist(planned(batch.slice(i, 1).to_pylist()[0], None), kind)

        right = stored.select(columns).mapInArrow(each, fields)
    else:

        def marked(own: pa.Table, one: pa.Table) -> pa.Table:
            rows = planned(one.to_pylist()[0], own.column("id").to_numpy()) if one.num_rows else []
            return pa.Table.from_pylist(rows, kind)

        own = among.select(F.col(among.columns[0]).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
        own = own.select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
        right = own.groupBy("shard").cogroup(stored.select(columns).groupBy("shard")).applyInArrow(marked, fields)

    def by_graph(g: dict, q_id: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        ids = np.frombuffer(g["ids"], np.int64)
        x = np.frombuffer(g["vectors"], np.float32).reshape(-1, dims)
        may, stats = np.frombuffer(g["may"], bool), {"distances": 0}
        wide = min(len(ids), -(-max(ef, k + 1) * len(ids) // max(1, int(may.sum()))))
        layers = [Layer(n := np.frombuffer(a, np.int64), np.frombuffer(b, np.int32).reshape(len(n), -1)) for a, b in zip(g["nodes"], g["links"])]
        asked = np.concatenate([q, np.zeros((len(q), 1), np.float32)], 1) if metric == "ip" else _unit(q, metric)
        stop = (lambda m: Discoveries(m, wide, 0.14 if metric == "l2" else 0.2, 128)) if early and k > 10 else None
        place, _ = search_graph(_stored(x, metric, longest).astype(np.float32), layers, asked, wide, stop, stats)
        out = []
        step = max(1, (4 << 20) // max(1, place.shape[1] * dims))
        for a in range(0, len(q), step):
            p, y = place[a : a + step], q[a : a + step].astype(np.float64)
            z = x[np.maximum(p, 0)].astype(np.float64)
            if metric == "l2":
                d = ((z - y[:, None, :]) ** 2).sum(2)
            else:
                z, y = (z / np.maximum(np.linalg.norm(z, axis=2, keepdims=True), 1e-30), _unit(y, metric)) if metric == "cosine" else (z, y)
                d = 1 - (z * y[:, None, :]).sum(2)
            near = ids[np.maximum(p, 0)]
            d = np.where((p >= 0) & may[np.maximum(p, 0)] & ~(same_set & (near == q_id[a : a + step][:, None])), np.round(d, digits) + 0.0, np.inf)
            best = np.lexsort((near, d), axis=1)[:, :k]
            d, near = np.take_along_axis(d, best, 1), np.take_along_axis(near, best, 1)
            r, c = np.nonzero(np.isfinite(d))
            out.append((a + r, near[r, c], d[r, c]))
        r, near, d = (np.concatenate(z) for z in zip(*out))
        return r, near, d, np.full(len(r), stats["distances"]), np.ones(len(r), bool)

    def by_scan(some: list[dict], q_id: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        ids = [np.frombuffer(g["ids"], np.int64) for g in some]
        cost = np.concatenate([np.full(len(i), len(i) * len(q)) for i in ids])
        ids, x = np.concatenate(ids), np.concatenate([np.frombuffer(g["vectors"], np.float32) for g in some]).reshape(-1, dims)
        order, asks = np.argsort(ids, kind="stable"), np.flatnonzero(scan.finite(q))
        order = order[scan.finite(x[order])]
        ids, x, cost = ids[order], x[order], cost[order]
        counts = (lambda r, c: q_id[asks[r]] != ids[c]) if same_set else (lambda r, c: np.ones(len(r), bool))
        r, c, d = scan.nearest(scan.ranking(q[asks], x, metric, digits, counts), len(asks), ids, k)
        return asks[r], ids[c], d, cost[c], np.zeros(len(r), bool)

    def find(left: list[dict], right: list[dict]) -> Iterator[pa.RecordBatch]:
        q_id = np.frombuffer(left[0]["id"], np.int64)
        q = scan.vectors(left[0]["v"], len(q_id))
        exact = [g for g in right if g["way"] == "exact"]
        found = [by_scan(exact, q_id, q)] if exact else []
        for g in right:
            if g["way"] == "graph":
                # the k nearest of the shards so far
                found = [_least(k, *(np.concatenate(z) for z in zip(*found, by_graph(g, q_id, q))))]
        r, near, d, distances, graph = _least(k, *(np.concatenate(z) for z in zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(q_id[r]), pa.array(near), pa.array(d), pa.array(distances), pa.array(np.where(graph, "graph", "exact"))], names=["query_id", "vec_id", "dist", "distances", "way"])

    found = scan.pairs(left, right, blocks, bundles, find, schema)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
