"""Supervision tables from clean and corrupted traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import serialize_steps, strip
from tracemill.operators.rank import aggregate_scores, critical_mask


def answer_correct(predicted: Column, gold: Column, validated: Column | None = None) -> Column:
    """The validation's verdict if there is one; else equality without case and outer space; null without a prediction."""
    plain = F.lower(strip(predicted)) == F.lower(strip(gold))
    own = F.when(predicted.isNotNull(), plain)
    return own if validated is None else F.coalesce(validated, own)


def _verdict(rows: DataFrame) -> Column:
    """:func:`answer_correct` of ``rows``; the validation's column of that name is its verdict, null without answers."""
    known = {"predicted_answer", "gold_answer"} <= set(rows.columns)
    validated = F.col("answer_correct") if "answer_correct" in rows.columns else None
    if not known:
        return F.lit(None).cast("boolean") if validated is None else validated
    return answer_correct(F.col("predicted_answer"), F.col("gold_answer"), validated)


def pointwise(clean: DataFrame, corrupted: DataFrame, threshold: float = 0.5, penalty: float = 0.5) -> DataFrame:
    """One row per trace, clean ones first in role only: labels, critical mask, score target and trace label."""
    traces = clean.unionByName(corrupted, allowMissingColumns=True)
    labels = F.transform("steps", lambda s: F.coalesce(s["label"], F.lit(1)))
    rows = traces.withColumns({"step_labels": labels, "critical": critical_mask(F.col("steps"))})
    scores = F.transform("step_labels", lambda x: x.cast("double"))
    return rows.select(
        F.concat(F.lit("pointwise::"), "trace_id").alias("record_id"), "example_id", "benchmark", "trace_id",
        F.when(F.col("family").isNotNull(), "corrupted").otherwise("clean").alias("dataset_role"),
        F.forall("step_labels", lambda x: x == 1).cast("int").alias("trace_label"),
        aggregate_scores(scores, F.col("critical"), threshold, penalty).alias("trace_score_target"),
        _verdict(traces).alias("answer_correct"),
        F.col("family").alias("corruption_family"), "wrong_use_type", "source_trace_id", "step_labels",
        F.transform("steps", lambda s: F.coalesce(s["error_type"], F.lit("none"))).alias("step_error_types"),
        F.transform("critical", lambda c: c.cast("int")).alias("critical_step_mask"), "trace_mode", F.size("steps").alias("num_steps"), "steps",
    )


def pairwise(clean: DataFrame, corrupted: DataFrame, order: str) -> DataFrame:
    """Each corrupted trace beside its source, or beside the first clean trace (by ``order``) of its example; else dropped.

    Whether the two answers are right is the validation's verdict, where the
    tables have one, and null where they hold no answers.
    """
    mine = F.struct("trace_id", "steps", _verdict(clean).alias("answer_correct"))
    by_id = clean.select(F.col("trace_id").alias("source_trace_id"), mine.alias("__own"))
    first = clean.groupBy("example_id").agg(F.min_by(mine, order).alias("__first"))
    both = corrupted.join(by_id, "source_trace_id", "left").join(first, "example_id", "left")
    better = F.coalesce("__own", "__first")
    both = both.withColumn("__better", better).where(F.col("__better").isNotNull())
    return _pairs(both, _verdict(corrupted))


def pairwise_of(corrupted: DataFrame) -> DataFrame:
    """The pairs of corrupted traces that hold their source's steps, as ``corrupt(..., source_steps=True)`` makes them.

    Nothing is joined and no row moves. A corrupted trace keeps the answers of its source, and so its verdict.
    """
    own = F.struct(F.col("source_trace_id").alias("trace_id"), F.col("source_steps").alias("steps"), _verdict(corrupted).alias("answer_correct"))
    return _pairs(corrupted.withColumn("__better", own), _verdict(corrupted))


def _pairs(both: DataFrame, verdict: Column) -> DataFrame:
    """Corrupted rows beside their better trace, ``__better``, as pairs; ``verdict`` is on the corrupted one's answer."""
    generator = F.col("generator_name") if "generator_name" in both.columns else F.lit(None).cast("string")
    return both.select(
        F.concat(F.lit("pair::"), F.col("__better.trace_id"), F.lit("::"), "trace_id").alias("pair_id"), "example_id", "benchmark", F.lit("clean_vs_corrupted").alias("pair_type"),
        F.col("__better.trace_id").alias("preferred_trace_id"), F.col("trace_id").alias("rejected_trace_id"),
        F.col("family").alias("corruption_family"), "wrong_use_type", "source_trace_id",
        generator.alias("generator_name"), F.col("__better.answer_correct").alias("preferred_answer_correct"), verdict.alias("rejected_answer_correct"),
        F.col("__better.steps").alias("preferred_steps"), F.col("steps").alias("rejected_steps"),
    )


# fixed values: the texts of the two verifier prompts
POINTWISE_HEAD = (
    "You are a multimodal verifier.\n"
    "Given an image, a question, and a reasoning trace, judge whether each step is grounded.\n"
    "Return JSON with `step_labels`, `final_score`, and `trace_label`.\n\n"
)
PAIRWISE_HEAD = (
    "You are a multimodal verifier.\n"
    "Given two reasoning traces for the same image and question, choose the more grounded trace.\n"
    "Respond with a JSON object containing `preferred_trace` set to `A` or `B`.\n\n"
)


def _about(image: Column, question: Column) -> Column:
    return F.concat(F.lit("Image path: "), image, F.lit("\nQuestion: "), question)


def pointwise_prompt(image: Column, question: Column, steps: Column) -> Column:
    return F.concat(F.lit(POINTWISE_HEAD), _about(image, question), F.lit("\nTrace:\n"), serialize_steps(steps), F.lit("\n"))


def pairwise_prompt(image: Column, question: Column, better: Column, worse: Column) -> Column:
    """The preferred trace is always A, as every target says."""
    return F.concat(
        F.lit(PAIRWISE_HEAD), _about(image, question), F.lit("\n\nTrace A:\n"), serialize_steps(better), F.lit("\n\nTrace B:\n"), serialize_steps(worse), F.lit("\n")
    )


def pointwise_target(labels: Column, score: Column, label: Column) -> Column:
    """The target object, spaced as Python's json module does."""
    items = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
    return F.concat(F.lit('{"step_labels": ['), items, F.lit('], "final_score": '), score.cast("string"), F.lit(', "trace_label": '), label.cast("string"), F.lit("}"))


def pointwise_texts(rows: DataFrame) -> DataFrame:
    """(record_id, image_path, prompt, target) of pointwise rows, or of pairs.

    Pointwise rows have record_id, steps, step_labels, trace_score_target and
    trace_label. Of a pair (preferred_trace_id, preferred_steps) the better trace
    is supervised: its own labels (1 where missing), score and label 1.
    """
    if "step_labels" in rows.columns:
        rows = rows.withColumns({"__id": F.col("record_id"), "__steps": F.col("steps"), "__labels": F.col("step_labels"), "__score": F.col("trace_score_target"), "__label": F.col("trace_label")})
    else:
        labels = F.transform("preferred_steps", lambda s: F.coalesce(s["label"], F.lit(1)))
        rows = rows.withColumns({"__id": F.col("preferred_trace_id"), "__steps": F.col("preferred_steps"), "__labels": labels, "__score": F.lit(1.0), "__label": F.lit(1)})
    prompt = pointwise_prompt(F.col("image_path"), F.col("question"), F.col("__steps"))
    return rows.select(F.col("__id").alias("record_id"), "image_path", prompt.alias("prompt"), pointwise_target(F.col("__labels"), F.col("__score"), F.col("__label")).alias("target"))


def quality_profile(pairs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Row count, range of t_star, and negatives that hold a wrong step; with ``images`` (a table of path) also how many pairs' image_path it holds, and their share."""
    checks = [F.count("*").alias("n"), F.min("t_star").alias("min_t_star"), F.max("t_star").alias("max_t_star"), F.count_if(F.exists("rejected_steps", lambda s: s["label"] == 0)).alias("with_wrong_step")]
    if images is None:
        return pairs.agg(*checks)
    there = images.select(F.col("path").alias("__path")).distinct()
    met = pairs.join(there, F.col("image_path") == F.col("__path"), "left")
    out = met.agg(*checks, F.count("__path").alias("with_image"))
    return out.withColumn("image_share", F.coalesce(F.try_divide("with_image", "n"), F.lit(0.0)))
