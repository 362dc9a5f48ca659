"""Scores of traces, rankings and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import scan
from tracemill.schemas import GROUNDED_STEPS


def critical_mask(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.coalesce(s["step_type"].isin(*GROUNDED_STEPS), F.lit(False)))


def aggregate_scores(scores: Column, critical: Column, threshold: float = 0.5, penalty: float = 0.5) -> Column:
    """Mean score less a penalty if a critical step falls below the threshold; 0 at least, and for no steps."""
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))
    failed = F.exists(F.zip_with(scores, critical, lambda s, c: c & (s < threshold)), lambda f: f)
    return F.coalesce(F.greatest(F.lit(0.0), mean - F.when(failed, penalty).otherwise(0.0)), F.lit(0.0))


def score_groups(steps: DataFrame, key: list[str], score: str, critical: Column, threshold: float = 0.5, penalty: float = 0.5) -> DataFrame:
    """The same over one row per step, with map-side partial sums."""
    failed = F.bool_or(critical & (F.col(score) < threshold))
    final = F.greatest(F.lit(0.0), F.avg(score) - F.when(failed, penalty).otherwise(0.0))
    return steps.groupBy(*key).agg(F.count("*").alias("n_steps"), final.alias("final_score"))


def rank(traces: DataFrame, by: list[str], score: str, tie: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return traces.withColumn("rank", F.row_number().over(order))


def under_budget(traces: DataFrame, by: list[str], order: list[str], cost: Column, budget: float, ranges: int | None = None) -> DataFrame:
    """The longest prefix of each group whose running cost stays within the budget; a missing cost is 1.

    A group is one task, unless ``ranges`` says over how many ranges of the order
    the running costs of large groups are to be spread.
    """
    price = F.coalesce(cost, F.lit(1.0))
    if ranges:
        dealt = scan.ranged(traces, order, by, ranges)
        spent = scan.running(dealt, {"spent": price}, order, by, keep_range=True)
        peak = scan.running(spent, {"peak": F.col("spent")}, order, by, kind="max")
    else:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        peak = traces.withColumn("spent", F.sum(price).over(upto)).withColumn("peak", F.max("spent").over(upto))
    # with negative costs a later sum may fall again, but the prefix has ended
    return peak.where((F.col("peak") <= budget) & F.lit(budget > 0)).drop("peak")


def best_under_budget(traces: DataFrame, by: list[str], order: list[str], cost: Column, budget: float | None, score: str, tie: list[str], keep: list[str]) -> DataFrame:
    """The best of the traces that fit the budget in their order, one of each group; no budget: the best of all.

    Groups whose first trace is too dear, and all groups for a budget of 0 or less, give no row.
    """
    fits = traces if budget is None else under_budget(traces, by, order, cost, budget)
    return best(fits, by, score, tie, keep)


def best(traces: DataFrame, by: list[str], score: str, tie: list[str], keep: list[str]) -> DataFrame:
    """The first of each group by falling score, without a sort."""
    key = F.struct((-F.col(score)).alias("s"), *tie)
    return traces.groupBy(*by).agg(*(F.min_by(c, key).alias(c) for c in keep), F.max(score).alias(score))
