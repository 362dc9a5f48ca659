"""Keyed lookups, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.picks import in_share


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as building a dictionary leaves it; one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return last.select(*key, *(F.col("__row")[c].alias(c) for c in rest))


def with_lookup(rows: DataFrame, entries: DataFrame, keys: list[Column], entry_key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the value of the first of ``keys`` that ``entries`` knows; entries hold a key once.

    The side of the entries is left to the planner, which broadcasts it only below its size threshold.
    """
    out = rows
    for k, key in enumerate(keys):
        side = entries.select(F.col(entry_key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}"))
        out = out.join(side, key == F.col(f"__k{k}"), "left").drop(f"__k{k}")
    found = F.coalesce(*(F.col(f"__v{k}") for k in range(len(keys))))
    return out.withColumn(name, found).drop(*(f"__v{k}" for k in range(len(keys))))


def matched_and_unknown(rows: DataFrame, manifest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows joined to their manifest row, and rows whose key it lacks."""
    return rows.join(manifest, key), rows.join(manifest.select(key), key, "left_anti")


def pending(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return requests.join(done.select(key), key, "left_anti")


def with_outputs(requests: DataFrame, outputs: DataFrame, order: str, key: str = "example_id", benchmark: str = "docvqa") -> DataFrame:
    """Every output beside its request: the last output and the last request of a key (by ``order``) count.

    Outputs without a request keep blank fields and the default ``benchmark``; a
    missing temperature is 0.2. Requests without an output are left out.
    """
    asked = keep_last(requests, [key], [order]).select(key, "benchmark", "image_path", "question", "gold_answer")
    said = keep_last(outputs, [key], [order])
    blank = {c: F.coalesce(c, F.lit("")) for c in ("image_path", "question", "gold_answer")}
    both = said.join(asked, key, "left").withColumns({"benchmark": F.coalesce("benchmark", F.lit(benchmark)), "temperature": F.coalesce("temperature", F.lit(0.2))} | blank)
    return both.select(key, "request_id", "benchmark", "image_path", "question", "gold_answer", "generated_text", "finish_reason", "temperature")


def split_by_hash(rows: DataFrame, key: str, test_percent: int, salt: str = "split") -> DataFrame:
    """Adds split (train or test) by the key, so rows of one key stay together wherever they are."""
    return rows.withColumn("split", F.when(in_share(test_percent, F.lit(salt), F.col(key)), "test").otherwise("train"))


def newest(rows: DataFrame, by: list[str], order: str, keep: int) -> DataFrame:
    """The last ``keep`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("age", place).where(F.col("age") <= keep)
