"""Outputs that are parsed and validated as they come, into three tables, each row once however often a run dies.

Every micro-batch writes its part of each table under its own number and
overwrites what an earlier try left there; when all parts stand, its number is
committed, and readers see committed numbers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import verify
from tracemill.operators.traces import parse_outputs

VERIFIED, REJECTED, QUARANTINED = TABLES = ("verified", "rejected", "quarantined")
_BATCH = "batch_id"


def judged(outputs: DataFrame, manifest: DataFrame, issues_of: Callable[[Column], Column]) -> dict[str, DataFrame]:
    """verified, rejected and quarantined rows of outputs with raw_text and the request columns.

    ``manifest`` holds example_id, benchmark, answer and the evidence that
    ``issues_of`` reads. Broken lines (column ``_corrupt``), texts that give no
    step and unknown examples are quarantined, with a reason.
    """
    broken = outputs.where("_corrupt is not null").select(F.lit(None).cast("string").alias("request_id"), F.lit("broken_line").alias("reason"), F.col("_corrupt").alias("raw_text"))
    whole = outputs.where("_corrupt is null").drop("_corrupt")
    traces, failed = parse_outputs(whole)
    taken = ("benchmark", "answer", "example_id")
    known = manifest.select(*(F.col(c).alias(f"m_{c}") for c in taken), *(c for c in manifest.columns if c not in taken))
    met = traces.join(known, traces["example_id"] == known["m_example_id"], "left")
    strange = met.where("m_example_id is null").select(F.col("trace_id").alias("request_id"), F.lit("unknown_example").alias("reason"))
    checked = verify.annotate(verify.validate(met.where("m_example_id is not null"), issues_of))
    checked = checked.drop(*(c for c in manifest.columns if c not in taken), *(f"m_{c}" for c in taken))
    raw = whole.select(F.col("request_id").alias("__id"), "raw_text").dropDuplicates(["__id"])
    lost = failed.select("request_id", "reason").unionByName(strange)
    lost = lost.join(raw, F.col("request_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return {VERIFIED: checked.where("passed"), REJECTED: checked.where("not passed"), QUARANTINED: broken.unionByName(lost)}


def write_batch(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """The parts of one batch, then its number; the same call again leaves the same rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/{_BATCH}={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias(_BATCH)).write.mode("overwrite").parquet(f"{root}/committed/n={batch_id}")


def judge_stream(stream: DataFrame, manifest: DataFrame, issues_of: Callable[[Column], Column], root: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that is there and stops; ``stream`` is one of :func:`tracemill.streaming.resume.stream_jsonl`."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_batch(judged(batch, manifest, issues_of), root, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of the committed batches of one of :data:`TABLES`."""
    done = spark.read.parquet(f"{root}/committed").select(F.col(_BATCH).cast("long").alias("__done"))
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.join(done, F.col(_BATCH).cast("long") == F.col("__done"), "left_semi").drop(_BATCH)
