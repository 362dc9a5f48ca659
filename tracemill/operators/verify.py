"""Checks of trace steps against evidence: text spans, scene objects and page elements.

Each check is a column over a step and its evidence arrays; issues come in a
fixed order and the first one names the step's error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import element_ref, filled, last, last_part, normalize_text, once, scene_ref, strip
from tracemill.schemas import EVIDENCE_STEPS, GROUNDED_STEPS


def _is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _issues(*rules: tuple[Column, str]) -> Column:
    found = F.array(*(F.when(_is_true(test), F.lit(code)) for test, code in rules))
    return F.filter(found, lambda code: code.isNotNull())


def _missing(step: Column) -> tuple[Column, Column, Column, Column]:
    """(needs a reference but has none, needs a value but has none, has a reference, has a value)."""
    grounded, telling = (_is_true(step["step_type"].isin(*types)) for types in (GROUNDED_STEPS, EVIDENCE_STEPS))
    ref, value = F.coalesce(step["grounding_ref"], F.lit("")) != "", F.coalesce(step["evidence_value"], F.lit("")) != ""
    return grounded & ~ref, telling & ~value, ref, value


def _neither_contains(a: Column, b: Column) -> Column:
    return ~a.contains(b) & ~b.contains(a)


def _last_of(items: Column, key: str, wanted: Column) -> Column:
    """The last item of an id, as a dictionary keeps it; ids count without outer space, blank ones not at all."""
    return last(F.filter(items, lambda i: (wanted != "") & (strip(i[key]) == wanted)))


def span_issues(step: Column, spans: Column) -> Column:
    """Issues of a step grounded in a text span; the last span of an id counts."""
    no_ref, no_value, has_ref, has_value = _missing(step)

    def by_id(span_id: Column) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("struct<text string>")), F.transform(F.filter(spans, lambda s: strip(s["span_id"]) == span_id), lambda s: F.struct(F.coalesce(filled(s["normalized_text"]), s["text"]).alias("text")))), -1)

    span = F.coalesce(by_id(last_part(step["grounding_ref"])), by_id(step["grounding_ref"]))
    said, there = normalize_text(step["evidence_value"]), normalize_text(span["text"])
    return _issues(
        (no_ref, "missing_grounding_ref"),
        (has_ref & span.isNull(), "unknown_grounding_ref"),
        (no_value, "missing_evidence_value"),
        (has_ref & span.isNotNull() & has_value & (said != "") & _neither_contains(there, said), "evidence_mismatch"),
    )


def object_issues(step: Column, objects: Column) -> Column:
    """Issues of a step grounded in scene objects or a relation between two."""

    def look_up(ref: Column) -> Column:
        unknown = (ref["kind"] == "objects") & F.exists(ref["ids"], lambda i: _last_of(objects, "object_id", i).isNull())
        one, source = (_last_of(objects, "object_id", i) for i in (F.get(ref["ids"], F.lit(0)), ref["source"]))
        return F.struct(unknown.alias("unknown"), one.alias("one"), source.alias("source"))

    # references are parsed once, and objects looked up once
    return once(scene_ref(step["grounding_ref"]), lambda ref: once(look_up(ref), lambda found: _object_issues(step, ref, found)))


def _object_issues(step: Column, ref: Column, found: Column) -> Column:
    no_ref, no_value, has_ref, has_value = _missing(step)
    is_objects, is_relation = ref["kind"] == "objects", ref["kind"] == "relation"
    unknown, one, source = found["unknown"], found["one"], found["source"]
    is_count = (step["step_type"] == "count") & has_value
    number = strip(step["evidence_value"]).try_cast("int")
    wrong_count = is_objects & ~unknown & is_count & ~_is_true(number == F.size(ref["ids"]))
    names = F.concat(F.array(normalize_text(one["name"])), F.transform(F.coalesce(one["attributes"], F.array().cast("array<string>")), normalize_text))
    names = F.filter(names, lambda n: n != "")
    said = normalize_text(step["evidence_value"])
    wrong_name = is_objects & ~unknown & ~is_count & has_value & (F.size(ref["ids"]) == 1) & (said != "") & (F.size(names) > 0) & ~F.array_contains(names, said)
    edge = F.exists(source["relations"], lambda r: (strip(r["name"]) == ref["relation"]) & (strip(r["target_object_id"]) == ref["target"]))
    return _issues(
        (no_ref, "missing_grounding_ref"),
        (has_ref & (ref["kind"] == "unknown"), "malformed_grounding_ref"),
        (unknown, "unknown_grounding_ref"),
        (_is_true(wrong_count) | _is_true(wrong_name), "evidence_mismatch"),
        (is_relation & source.isNull(), "unknown_grounding_ref"),
        (is_relation & source.isNotNull() & ~_is_true(edge), "evidence_mismatch"),
        (no_value, "missing_evidence_value"),
    )


def element_issues(step: Column, elements: Column, mode: Column) -> Column:
    """Issues of a step grounded in page elements; in other modes than ``element`` only the reference's form counts."""
    no_ref, no_value, has_ref, has_value = _missing(step)
    strict = _is_true(mode == "element")
    ref = element_ref(step["grounding_ref"])
    is_elements = ref["kind"] == "elements"
    unknown = is_elements & F.exists(ref["ids"], lambda i: _last_of(elements, "element_id", i).isNull())
    texts = F.transform(ref["ids"], lambda i: normalize_text(_last_of(elements, "element_id", i)["text"]))
    texts = F.filter(texts, lambda t: t != "")
    said = normalize_text(step["evidence_value"])
    mismatch = is_elements & ~unknown & has_value & (F.size(texts) > 0) & (said != "") & F.forall(texts, lambda t: _neither_contains(t, said))
    return _issues(
        (has_ref & (ref["kind"] == "unknown"), "malformed_grounding_ref"),
        (strict & no_ref, "missing_grounding_ref"),
        (strict & unknown, "unknown_grounding_ref"),
        (strict & mismatch, "evidence_mismatch"),
        (strict & no_value, "missing_evidence_value"),
    )


def first_issue(issues: Column) -> Column:
    return F.coalesce(F.get(issues, F.lit(0)), F.lit("none"))


def validate(traces: DataFrame, issues_of: Callable[[Column], Column]) -> DataFrame:
    """``traces`` (with the manifest columns m_example_id, m_benchmark, m_answer and evidence) judged.

    Adds step_issues, answer_correct (null without a prediction), passed and
    rejection_reason. A mismatch of ids or benchmarks outranks a wrong answer,
    which outranks the first failed step.
    """
    out = traces.withColumn("step_issues", F.transform("steps", issues_of))
    mismatch = ~(F.col("m_example_id").eqNullSafe(F.col("example_id")) & F.col("m_benchmark").eqNullSafe(F.col("benchmark")))
    correct = F.when(F.col("predicted_answer").isNotNull(), normalize_text(F.col("predicted_answer")) == normalize_text(F.col("m_answer")))
    steps_pass = F.forall("step_issues", lambda i: F.size(i) == 0)
    out = out.withColumn("answer_correct", correct)
    out = out.withColumn("passed", steps_pass & F.coalesce(F.col("answer_correct"), F.lit(True)) & ~mismatch)
    failed = first_issue(F.get(F.filter("step_issues", lambda i: F.size(i) > 0), F.lit(0)))
    reason = F.when(mismatch, "trace_metadata_mismatch").when(F.col("answer_correct") == F.lit(False), "wrong_answer").otherwise(failed)
    return out.withColumn("rejection_reason", F.when(~F.col("passed"), reason))


def annotate(validated: DataFrame) -> DataFrame:
    """Labels and error types of the steps, overwritten by the validation."""
    merged = F.zip_with(
        "steps", "step_issues", lambda s, i: s.withField("label", (F.size(i) == 0).cast("int")).withField("error_type", first_issue(i))
    )
    return validated.withColumn("steps", merged)
