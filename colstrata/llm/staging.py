"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.shared import shared_folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written as Parquet and read again, which cuts its lineage.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        jvm = spark._jvm
    except Exception:  # a remote session has no JVM gateway; its files stay
        jvm = None
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def rows_of(df: DataFrame, most: int) -> bool:
    """Whether the table has no more than `most` rows, without counting beyond."""
    return df.limit(most + 1).count() <= most
