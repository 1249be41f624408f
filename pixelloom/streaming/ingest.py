"""A folder of image files as a stream: decoded or identified as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.registry import Context


def decoded_stream(spark: SparkSession, path: str, context: Context = Context()) -> DataFrame:
    return files.decode(files.scan(spark, path, stream=True), context)


def identified_stream(spark: SparkSession, path: str, context: Context = Context()) -> DataFrame:
    return files.identify(files.scan(spark, path, stream=True), context)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, decoded into Parquet; run again, it goes on where it was."""
    return decoded_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
