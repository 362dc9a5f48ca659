"""Two streams, requests and outputs, joined with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(
    requests: DataFrame, outputs: DataFrame, key: str = "request_id", asked: str = "asked_at", said: str = "said_at", within: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Each request with the first output that comes within ``within`` after it, or alone once none can come any more.

    Both streams may be late by ``delay``. Outputs are taken once a key while
    their copies lie within the time they may answer. State goes when the
    watermarks pass it, so its size follows the rows of that time, not of the
    stream. Outputs without a request, or beyond its time, leave no row. Adds
    ``answered``; columns of the outputs are null where it is false.
    """
    left = requests.withWatermark(asked, delay)
    once = outputs.withWatermark(said, delay).dropDuplicatesWithinWatermark([key])
    right = once.withColumnRenamed(key, "__key")
    in_time = (F.col(said) >= F.col(asked)) & (F.col(said) <= F.col(asked) + F.expr(f"interval {within}"))
    both = left.join(right, (F.col(key) == F.col("__key")) & in_time, "leftOuter")
    return both.withColumn("answered", F.col("__key").isNotNull()).drop("__key")
