"""Inverted posting tables: value, count, range of row ids, and the ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Written with each index; readers take this version and earlier ones.
STORAGE_VERSION = 1


def build(table: DataFrame, key: str, value: str) -> DataFrame:
    """The posting table of a column; an array column has a posting for each element.

    Ids of one value are split into posting blocks by the upper bits of the id, so
    a frequent value is no row of unbounded length.
    """
    kind = table.schema[value].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        raise ValueError("float vectors have no postings")
    x = F.explode(value) if isinstance(kind, T.ArrayType) else F.col(value)
    flat = table.select(x.alias("value"), F.col(key).alias("rid")).where(F.col("value").isNotNull())
    return (
        flat.groupBy("value", F.shiftright("rid", 20).alias("part"))
        .agg(F.count("*").alias("n"), F.min("rid").alias("min_rid"), F.max("rid").alias("max_rid"), F.sort_array(F.collect_list("rid")).alias("rids"))
        .drop("part")
    )


def write(postings: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """The posting table as Parquet in ranges of values, each file sorted, so a lookup skips all row groups but those of its values."""
    ordered = postings.repartitionByRange("value", "min_rid").sortWithinPartitions("value", "min_rid")
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A posting table as written; ids are read only where a query asks for them."""
    found = spark.read.parquet(path)
    missing = {"value", "n", "min_rid", "max_rid", "rids"} - set(found.columns)
    if missing:
        raise ValueError(f"no posting table in {path}: without {', '.join(sorted(missing))}")
    return found


def merged_floats(postings: DataFrame, digits: int = 6) -> DataFrame:
    """value and n of a float column's postings, values that agree in `digits` decimals being one."""
    return postings.groupBy(F.round(F.col("value").cast("double"), digits).alias("value")).agg(F.sum("n").alias("n"))


def rows(postings: DataFrame, test: Column) -> DataFrame:
    """rid: distinct row ids of the values that pass."""
    return postings.where(test).select(F.explode("rids").alias("rid")).distinct()


def bounded(postings: DataFrame, test: Column, low: int, high: int) -> DataFrame:
    """rid within [low, high], leaving postings outside unread."""
    inside = postings.where(test & (F.col("max_rid") >= low) & (F.col("min_rid") <= high))
    return rows(inside, F.lit(True)).where(F.col("rid").between(low, high))


def excluded(table: DataFrame, key: str, postings: DataFrame, test: Column) -> DataFrame:
    """rid of the rows of which no posting passes."""
    return table.select(F.col(key).alias("rid")).join(rows(postings, test), "rid", "left_anti")


def count(postings: DataFrame, test: Column) -> DataFrame:
    """One row: the number of postings that pass, without reading ids."""
    return postings.where(test).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def summary(postings: DataFrame) -> DataFrame:
    """One row: distinct values, postings, least and most value."""
    return postings.agg(F.countDistinct("value").alias("values"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("postings"), F.min("value").alias("least"), F.max("value").alias("most"))


def num_values(postings: DataFrame, test: Column, listed: Sequence | None = None) -> DataFrame:
    """One row: how many values a lookup visits; a list of 100 or more counts as its length."""
    if listed is not None and len(listed) >= 100:
        return postings.sparkSession.range(1).select(F.lit(len(listed)).cast("bigint").alias("iterators"))
    return postings.where(test).agg(F.countDistinct("value").alias("iterators"))


def mismatches(postings: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Postings that differ from the table they were built of: (value, rid) on one side alone."""
    kind = table.schema[value].dataType
    x = F.explode(value) if isinstance(kind, T.ArrayType) else F.col(value)
    now = table.select(x.alias("value"), F.col(key).alias("rid")).where(F.col("value").isNotNull())
    then = postings.select("value", F.explode("rids").alias("rid"))
    both = now.withColumn("side", F.lit(1)).unionByName(then.withColumn("side", F.lit(-1)))
    return both.groupBy("value", "rid").agg(F.sum("side").alias("surplus")).where("surplus <> 0")


class Registry:
    """Which columns have a usable index; a changed column takes its JSON paths with it."""

    def __init__(self, columns: Sequence[str]):
        self.enabled = dict.fromkeys(columns, True)
        self.path: str | None = None
        self.changed = True

    @staticmethod
    def parent(name: str) -> str:
        return name.split("['", 1)[0]

    def resolve(self, name: str) -> str | None:
        """The indexed column to use for a name: itself or its parent, if enabled."""
        for x in (name, self.parent(name)):
            if self.enabled.get(x):
                return x
        return None

    def column_updated(self, name: str) -> None:
        """The column's index is out of date; of a JSON path, those of all paths of its column."""
        if not self.enabled.get(name):
            return
        self.changed = True
        self.enabled[name] = False
        if name != self.parent(name):
            for x in self.enabled:
                if x != self.parent(x) and self.parent(x) == self.parent(name):
                    self.enabled[x] = False

    def info(self, kinds: dict[str, str] | None = None) -> list[tuple[str, str | None, bool]]:
        """Name, kind and whether it is enabled, of each column."""
        return [(x, (kinds or {}).get(x), e) for x, e in self.enabled.items()]

    def save(self, spark: SparkSession, path: str) -> bool:
        """Writes what is enabled beside the index, if that has changed since it was read; whether it was written."""
        if not self.changed:
            return False
        rows = [(STORAGE_VERSION, x, e) for x, e in self.enabled.items()]
        spark.createDataFrame(rows, "version int, attr string, enabled boolean").coalesce(1).write.mode("overwrite").parquet(path)
        self.path, self.changed = path, False
        return True

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """What was saved; an index of a later version than this one is an error."""
        found = spark.read.parquet(path).collect()  # a row for each indexed column
        if any(r["version"] > STORAGE_VERSION for r in found):
            raise ValueError(f"the index in {path} is of a later version")
        out = cls([r["attr"] for r in found])
        out.enabled = {r["attr"]: r["enabled"] for r in found}
        out.path, out.changed = path, False
        return out

    def moved(self, path: str) -> None:
        """The index lies in another folder now."""
        self.path = path
