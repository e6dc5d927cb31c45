"""Checks of column tables, of their files and of what the files say about themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_table(table: DataFrame, key: str, block: int = 65_536, dims: dict[str, int] | None = None) -> DataFrame:
    """block, attr, problem and n: what is wrong in each block of row ids, and in how many rows.

    Row ids must be there, from 0 up and unlike each other. Sets must be sorted
    without repetition and without null elements; float vectors must have the
    length that `dims` gives their column, and numbers all; floats must be numbers.
    All of it is one pass, with partial sums for each block.
    """
    checks: list[tuple[str, str, F.Column]] = [(key, "null id", F.col(f"`{key}`").isNull()), (key, "negative id", F.col(f"`{key}`") < 0)]
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            checks.append((f.name, "not a number", F.isnan(c)))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
            checks.append((f.name, "not a number", F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
            if dims and f.name in dims:
                checks.append((f.name, "length", F.size(c) != dims[f.name]))
        elif isinstance(f.dataType, T.ArrayType):
            checks.append((f.name, "null element", F.exists(c, lambda x: x.isNull())))
            checks.append((f.name, "unsorted", (F.size(c) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.get(c, i - 1) >= F.get(c, i))))
    number = F.coalesce(F.floor(F.col(f"`{key}`") / block).cast("bigint"), F.lit(-1).cast("bigint"))
    sums = [F.count_if(bad).alias(f"p{i}") for i, (_, _, bad) in enumerate(checks)]
    by_block = table.groupBy(number.alias("block")).agg(*sums)
    found = F.array(*[F.struct(F.lit(c).alias("attr"), F.lit(p).alias("problem"), F.col(f"p{i}").alias("n")) for i, (c, p, _) in enumerate(checks)])
    wrong = by_block.select("block", F.explode(found).alias("x")).select("block", "x.*").where("n > 0")
    again = table.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    repeated = again.groupBy(F.floor(F.col("k") / block).cast("bigint").alias("block")).agg(F.sum(F.col("n") - 1).alias("n")).select("block", F.lit(key).alias("attr"), F.lit("repeated id").alias("problem"), "n")
    return wrong.unionByName(repeated)


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """file, row_group, rows, nulls, least and most of a column as the Parquet files' footers state them; no row is read.

    least and most are null where a file has no statistics, and doubles otherwise.
    """
    files = [(f,) for f in spark.read.parquet(path).inputFiles()]
    schema = "file string, row_group int, rows bigint, nulls bigint, least double, most double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs
        import pyarrow.parquet as pq

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, place = pfs.FileSystem.from_uri(file.replace(" ", "%20"))
                with fs.open_input_file(place) as f:
                    meta = pq.ParquetFile(f).metadata
                at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path.split(".")[0] == column)
                rows = []
                for g in range(meta.num_row_groups):
                    x = meta.row_group(g).column(at).statistics
                    whole = x is not None and x.has_min_max
                    rows.append({"file": file, "row_group": g, "rows": meta.row_group(g).num_rows, "nulls": x.null_count if x is not None and x.has_null_count else None, "least": float(x.min) if whole else None, "most": float(x.max) if whole else None})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), ("nulls", pa.int64()), ("least", pa.float64()), ("most", pa.float64())]))

    listed = spark.createDataFrame(files, "file string")
    return listed.repartition(max(1, min(len(files), 2000)), "file").mapInArrow(run, schema)


def footer_reject(stated: DataFrame, low: float, high: float) -> DataFrame:
    """One row: whether by the footers no value can be within [low, high]; a row group without statistics can hold any."""
    maybe = F.col("least").isNull() & (F.coalesce("nulls", F.lit(0)) < F.col("rows")) | (F.col("most") >= low) & (F.col("least") <= high)
    return stated.agg((F.count_if(maybe) == 0).alias("rejected"))


def footer_estimate(stated: DataFrame, low: float, high: float) -> DataFrame:
    """One row: row groups that can hold a value within [low, high], and the rows in them."""
    maybe = F.col("least").isNull() | (F.col("most") >= low) & (F.col("least") <= high)
    return stated.agg(F.count_if(maybe).alias("groups"), F.coalesce(F.sum(F.when(maybe, F.col("rows"))), F.lit(0)).alias("rows"))
