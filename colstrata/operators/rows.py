"""Rows by id: fetch, shards, cut-offs, and block statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def fetch(table: DataFrame, wanted: DataFrame, key: str, columns: list[str], order: str = "ordinal") -> DataFrame:
    """The columns of the wanted rows, each with its place in the request.

    Repeated ids give repeated rows. Spark chooses the join by the sizes it sees.
    """
    return wanted.join(table.select(key, *columns), key).select(order, key, *columns)


def shard_bounds(total: int, shards: int) -> list[tuple[int, int | None]]:
    """First and last row id of equal slices; the last one is open."""
    size = -(-total // shards) if total else 0
    return [(i * size, None if i == shards - 1 else (i + 1) * size - 1) for i in range(shards)]


def in_shard(key: Column, total: int, shards: int, which: int) -> Column:
    low, high = shard_bounds(total, shards)[which]
    return key >= low if high is None else key.between(low, high)


def cutoff(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by id; a negative n is no limit."""
    return rows if n < 0 else rows.orderBy(key).limit(n)


def block_stats(table: DataFrame, key: str, column: str, block: int = BLOCK) -> DataFrame:
    """block, rows, least and most of a column by blocks of row ids."""
    return table.groupBy((F.floor(F.col(key) / block)).cast("bigint").alias("block")).agg(F.count("*").alias("rows"), F.min(column).alias("least"), F.max(column).alias("most"))


def matching_blocks(stats: DataFrame, low, high) -> DataFrame:
    """Blocks whose range of values meets [low, high]."""
    return stats.where((F.col("most") >= low) & (F.col("least") <= high))


def estimate_rows(stats: DataFrame, low, high) -> DataFrame:
    """One row: blocks that match, and the rows in them at most."""
    hit = (F.col("most") >= low) & (F.col("least") <= high)
    return stats.agg(F.count_if(hit).alias("blocks"), F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).cast("bigint").alias("rows"))


def early_reject(stats: DataFrame, low, high) -> DataFrame:
    """One row: whether no value of the whole table can match."""
    s = stats.agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return s.select(F.coalesce((F.col("most") < low) | (F.col("least") > high), F.lit(True)).alias("rejected"))


def prune(table: DataFrame, column: str, low, high) -> DataFrame:
    """Rows within [low, high]: the bounds go to the scan, which skips the row groups whose statistics rule them out."""
    return table.where(F.col(column).between(low, high))
