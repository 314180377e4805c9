"""Streams: event-time rollups and continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema=None, glob: str | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def rollup_stream(events: DataFrame, seconds: int = 60, lateness: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """count, sum, min and max of each tumbling window; in append mode a window is final when the watermark passes it."""
    timed = events.select(F.col(time).cast("timestamp").alias("at"), F.col(value).alias("value")).withWatermark("at", lateness)
    buckets = timed.groupBy(F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return buckets.select(F.unix_seconds("w.start").alias("bucket"), "count", "sum", "min", "max")


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """What a stream gives when all that is there now has been read, as a parquet table under `path`: each batch of
    complete mode replaces the table before it, and no row passes through the driver."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/table")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a parquet table, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
