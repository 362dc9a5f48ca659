"""Enumerations and table schemas of the trace data model, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the data model
BENCHMARKS = ("docvqa", "gqa", "visualwebbench")
TRACE_MODES = ("canonical", "light", "free")
STEP_TYPES = (
    "locate", "read", "extract", "identify", "relate", "count", "compute",
    "derive", "answer", "reason", "verify", "free", "summary",
)
ERROR_TYPES = (
    "none", "wrong_region", "wrong_value", "wrong_relation", "irrelevant_evidence",
    "wrong_intermediate_evidence", "missing_grounding_ref", "unknown_grounding_ref",
    "malformed_grounding_ref", "missing_evidence_value", "evidence_mismatch",
    "wrong_answer", "malformed_step", "validation_error",
)
FAMILIES = ("wrong_region", "wrong_value", "wrong_relation", "irrelevant_evidence", "wrong_intermediate_evidence")
#: steps that must name where their evidence is, and whose failure is penalised
GROUNDED_STEPS = ("locate", "read", "extract", "identify", "relate", "count", "compute", "reason", "verify")
#: steps that must say what their evidence is
EVIDENCE_STEPS = ("read", "extract", "count", "compute")

STEP = (
    "struct<step_id int, step_text string, step_type string, grounding_ref string, "
    "evidence_value string, label int, error_type string>"
)
SPAN = "struct<span_id string, text string, normalized_text string, bbox array<double>, page int, tokens array<string>>"
OBJECT = (
    "struct<object_id string, name string, attributes array<string>, bbox array<double>, "
    "relations array<struct<name string, target_object_id string>>>"
)
ELEMENT = "struct<element_id string, text string, normalized_text string, bbox array<double>, role string>"
TRACE = (
    "trace_id string, example_id string, benchmark string, image_path string, question string, gold_answer string, "
    f"predicted_answer string, trace_mode string, steps array<{STEP}>"
)
MANIFEST = (
    "example_id string, benchmark string, image_path string, question string, answer string, metadata struct<"
    "split string, source_id string, question_id string, image_id string, image_name string, answers array<string>, "
    f"ocr_spans array<{SPAN}>, objects array<{OBJECT}>, elements array<{ELEMENT}>, verification_mode string>"
)


def steps_in_order(steps: Column) -> Column:
    """Whether the step ids are 1..n in array order; false for empty and null arrays."""
    ids = F.transform(steps, lambda s: s["step_id"].cast("long"))
    return F.coalesce((F.size(steps) > 0) & (ids == F.sequence(F.lit(1).cast("long"), F.greatest(F.size(steps), F.lit(1)).cast("long"))), F.lit(False))


def violations(traces: DataFrame) -> DataFrame:
    """(trace_id, violation) for every broken rule of the trace schema; a sound table gives no rows."""
    blank = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"blank_{c}")) for c in ("trace_id", "example_id", "image_path", "question", "gold_answer")]
    types = F.transform("steps", lambda s: s["step_type"])
    errors = F.transform("steps", lambda s: F.coalesce(s["error_type"], F.lit("none")))
    rules = [
        *blank,
        F.when(~F.coalesce(F.col("benchmark").isin(*BENCHMARKS), F.lit(False)), "unknown_benchmark"),
        F.when(~F.coalesce("trace_mode", F.lit("canonical")).isin(*TRACE_MODES), "unknown_trace_mode"),
        F.when(~steps_in_order(F.col("steps")), "step_ids_not_contiguous"),
        F.when(F.exists(types, lambda t: ~F.coalesce(t.isin(*STEP_TYPES), F.lit(False))), "unknown_step_type"),
        F.when(F.exists(errors, lambda e: ~e.isin(*ERROR_TYPES)), "unknown_error_type"),
        F.when(F.exists("steps", lambda s: ~F.coalesce(s["label"], F.lit(1)).isin(0, 1)), "label_not_binary"),
    ]
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return traces.select("trace_id", F.explode(found).alias("violation"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
