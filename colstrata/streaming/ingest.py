"""Streams of rows through the same predicates, appended to a column table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.filters import Filter, all_of


def append_filtered(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, filters: Sequence[Filter] = ()) -> StreamingQuery:
    """What has arrived in a folder of Parquet files, filtered and appended once each; ends when all of it is in."""
    rows = spark.readStream.schema(schema).parquet(source).where(all_of(filters, schema))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
