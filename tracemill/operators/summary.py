"""Counts of the stages, the gate before training, and the summary of an evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracemill.schemas import BENCHMARKS


def stage_counts(stages: dict[str, DataFrame], by: str = "benchmark") -> DataFrame:
    """(stage, ``by``, n) of the tables that each stage left."""
    counted = [rows.groupBy(by).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), by, "n") for name, rows in stages.items()]
    return reduce(DataFrame.unionByName, counted)


class StageCounts:
    """Counts of rows by stage and group, taken while the rows pass: no stage is scanned for them.

    Groups are the few values of ``by`` that are counted apart; rows of others,
    and nulls, count as ``other``.
    """

    def __init__(self, by: str = "benchmark", groups: tuple[str, ...] = BENCHMARKS):
        self.by, self.groups = by, groups
        self.seen: list[tuple[tuple[str, ...], Observation]] = []

    def watch(self, rows: DataFrame, **stages: Column) -> DataFrame:
        """``rows``; the next action on them also counts, for each stage, the rows that meet its condition."""
        seen = Observation()
        among = F.coalesce(F.col(self.by).isin(*self.groups), F.lit(False))
        of = {str(i): F.coalesce(F.col(self.by) == g, F.lit(False)) for i, g in enumerate(self.groups)} | {"other": ~among}
        self.seen.append((tuple(stages), seen))
        return rows.observe(seen, *(F.count_if(c & mine).alias(f"{k}_{g}") for k, c in enumerate(stages.values()) for g, mine in of.items()))

    def counts(self) -> list[tuple[str, str, int]]:
        """(stage, group, n) of what was watched, once its actions have run; groups without rows are left out."""
        out = []
        for stages, seen in self.seen:
            got = seen.get
            out += [(s, g, got[f"{k}_{i}"]) for k, s in enumerate(stages) for i, g in [*((str(i), g) for i, g in enumerate(self.groups)), ("other", "other")] if got[f"{k}_{i}"]]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), f"stage string, {self.by} string, n long")


def training_gate(stages: DataFrame) -> DataFrame:
    """One row (status, ready, pending) from one row per benchmark: benchmark, status, include_in_training, verified, corrupted (paths).

    Web pages take part only where they are included expressly. Training goes on
    if some benchmark is ready and none is pending.
    """
    included = F.coalesce("include_in_training", F.col("benchmark") != "visualwebbench") & (F.coalesce("status", F.lit("")) != "disabled")
    there = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("verified", "corrupted")]
    ready = included & (F.coalesce("status", F.lit("")) == "completed") & there[0] & there[1]
    names = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("benchmark"))))
    out = stages.agg(names(ready).alias("ready"), names(included & ~ready).alias("pending"))  # a row for each of a few benchmarks
    return out.select(F.when((F.size("pending") > 0) | (F.size("ready") == 0), "skipped").otherwise("completed").alias("status"), "ready", "pending")


def full_decision(delta: Column, challenger: Column, baseline: Column) -> Column:
    """The rule of the full evaluation: GO for a gain of 0.05 by the better model, whatever the intervals."""
    return F.when((delta >= 0.05) & (challenger > baseline), "GO").otherwise("NO-GO")


# fixed values: the reasons of a decision, but for the name of the model
_REASONS = {
    "mock": "Evaluation fell back to mock — train models first",
    "go": "{model} significantly outperforms pointwise (delta ≥ 0.05, CIs non-overlapping)",
    "marginal": "Weak signal (0.02 ≤ delta < 0.05) — consider more data or debugging",
    "worse": "{model} performs worse than pointwise — hypothesis rejected",
    "small": "Delta too small (< 0.02) — no meaningful improvement",
    "chance": "{model} AUROC < 0.55 — not learning grounding",
    "overlap": "CIs overlapping — insufficient confidence",
}


def decision_reason(delta: Column, challenger: Column, challenger_low: Column, baseline_high: Column, mock: Column | None = None, model: str = "contrastive") -> Column:
    """Why :func:`tracemill.operators.metrics.decision` says what it says."""
    say = lambda name: F.lit(_REASONS[name].format(model=model))
    out = F.when(F.lit(False) if mock is None else mock, say("mock"))
    out = out.when((delta >= 0.05) & (challenger_low > baseline_high), say("go")).when((delta >= 0.02) & (delta < 0.05), say("marginal"))
    return out.when(delta < 0, say("worse")).when(delta < 0.02, say("small")).when(challenger < 0.55, say("chance")).otherwise(say("overlap"))


def significant(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Whether two intervals do not meet."""
    return (low1 > high2) | (high1 < low2)


def conclusion(challenger: Column, baseline: Column, delta: Column, decided: Column, best_family: Column, best_value: Column, step_accuracy: Column, model: str = "contrastive") -> Column:
    """Sentences on the main result, the best family and the steps; a null family or accuracy leaves its sentence out."""
    said = F.when(decided == "GO", "significantly outperforms").otherwise("does not show significant improvement over")
    main = F.format_string(model + " (AUROC=%.4f) %s pointwise baseline (AUROC=%.4f), with delta=%.4f.", challenger, said, baseline, delta)
    best = F.when(best_family.isNotNull(), F.format_string("Best performance on %s corruption (AUROC=%.4f).", best_family, best_value))
    steps = F.when(step_accuracy.isNotNull(), F.format_string("Step-level error detection accuracy: %.4f.", step_accuracy))
    return F.concat_ws(" ", main, best, steps)


def summary(main: DataFrame, families: DataFrame, step_accuracy: DataFrame) -> DataFrame:
    """One row of results.

    ``main``: one row with challenger, challenger_low, challenger_high, baseline,
    baseline_low, baseline_high. ``families``: family and auroc. ``step_accuracy``:
    one row, accuracy; both may be empty.
    """
    best = families.agg(F.min_by("family", F.struct(-F.col("auroc"), "family")).alias("best_family"), F.max("auroc").alias("best_value"))
    steps = step_accuracy.agg(F.max("accuracy").alias("step_accuracy"))
    rows = main.crossJoin(best).crossJoin(steps)  # one row each
    rows = rows.withColumn("delta", F.col("challenger") - F.col("baseline"))
    rows = rows.withColumn("decision", full_decision(F.col("delta"), F.col("challenger"), F.col("baseline")))
    return rows.withColumns(
        {
            "significant": significant(*(F.col(c) for c in ("challenger_low", "challenger_high", "baseline_low", "baseline_high"))),
            "conclusion": conclusion(*(F.col(c) for c in ("challenger", "baseline", "delta", "decision", "best_family", "best_value", "step_accuracy"))),
        }
    )


def results_table(results: DataFrame) -> DataFrame:
    """(model, auroc, lower, upper) rows of a :func:`summary`, for a report."""
    line = lambda name, c: F.struct(F.lit(name).alias("model"), F.col(c).alias("auroc"), F.col(f"{c}_low").alias("lower"), F.col(f"{c}_high").alias("upper"))
    return results.select(F.inline(F.array(line("pointwise", "baseline"), line("contrastive", "challenger"))))
