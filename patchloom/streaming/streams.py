"""The row-wise operators over a stream of pair tables: one row in, its sides out, no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from patchloom.operators import datasets


def sides(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the sides of new Parquet pair files in source to sink, each file once, then stop."""
    schema = spark.read.parquet(source).schema
    stream = datasets.sides(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
