"""Reading and writing of column tables: Parquet with the layout that predicates profit from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "uint32set": T.ArrayType(T.LongType()),
    "int64set": T.ArrayType(T.LongType()),
    "floatvec": T.ArrayType(T.FloatType()),
}


def schema_of(columns: dict[str, str]) -> T.StructType:
    """A schema from column names and kinds; a kind that isn't known is an error."""
    unknown = sorted(set(columns.values()) - set(KINDS))
    if unknown:
        raise ValueError(f"unsupported kinds: {', '.join(unknown)}")
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in columns.items()])


def write(table: DataFrame, path: str, sort: str | None = None, row_group_bytes: int = 32 << 20) -> None:
    """The table as Parquet, sorted within files by a column so its ranges can be skipped; sets are sorted."""
    for f in table.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.LongType):
            table = table.withColumn(f.name, F.sort_array(f.name))
    if sort is not None:
        table = table.sortWithinPartitions(sort)
    table.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def read(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The table, with the columns' kinds checked if they are given."""
    df = spark.read.parquet(path)
    if columns is not None:
        have = {f.name: f.dataType for f in df.schema.fields}
        for f in schema_of(columns).fields:
            if have.get(f.name) != f.dataType:
                raise ValueError(f"column {f.name}: {have.get(f.name)} where {f.dataType} is wanted")
    return df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A table of one Parquet file with each row's position in it."""
    return df.withColumn(name, F.col("_metadata.row_index"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
