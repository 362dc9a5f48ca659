"""Incremental runs: a checkpointed stream of JSON lines, and resumption without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.lookup import pending


def stream_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of JSON lines under ``path`` as a stream; lines that are no objects keep their text in ``_corrupt``."""
    reader = spark.readStream.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def append_outputs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all files that are there, appends Parquet and stops; a second run takes new files only."""
    writer = stream.where("_corrupt is null").drop("_corrupt").writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_request(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each request once, while its copies arrive within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, width: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Row counts in tumbling windows; rows later than ``delay`` are left out."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def resume(requests: DataFrame, outputs: DataFrame | None, key: str = "request_id") -> DataFrame:
    """Requests without an output."""
    return requests if outputs is None else pending(requests, outputs, key)
