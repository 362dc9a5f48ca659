"""Generation requests and the parsing of generated texts into step traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators.lookup import keep_first
from tracemill.schemas import STEP

_ASK = "Question: {question}\nImage path: {image_path}\n"
_STEPS = "Write 2-4 short numbered steps, then a final answer line. "
# fixed values: the form of a structured answer
_STRUCTURED = (
    "Return valid JSON with this schema only:\n"
    "{{\n"
    '  "predicted_answer": "<answer>",\n'
    '  "steps": [\n'
    "    {{\n"
    '      "step_id": 1,\n'
    '      "step_text": "<reasoning step>",\n'
    '      "step_type": "<locate|read|extract|identify|relate|count|compute|derive|answer|reason|verify>",\n'
    '      "grounding_ref": "<element:<id>|elements:<id,id>>",\n'
    '      "evidence_value": "<short evidence string>"\n'
    "    }}\n"
    "  ]\n"
    "}}\n"
    "Do not wrap the JSON in markdown fences."
)
# fixed values: (prompt_id, benchmark, trace_mode, expects_json, system_prompt, user_template)
TEMPLATES = [
    ("docvqa_canonical_v1", "docvqa", "canonical", False,
     "You are generating evidence-faithful reasoning traces for document question answering. Use only evidence visible in the image.",
     _ASK + "Answer:"),
    ("docvqa_light_v1", "docvqa", "light", False,
     "You are generating concise step-by-step document reasoning. Prefer grounded evidence over fluent filler.",
     _ASK + _STEPS + "Mention concrete evidence text when possible."),
    ("docvqa_free_v1", "docvqa", "free", False,
     "Answer the document question naturally, but ensure the reasoning is visually grounded.",
     _ASK + "Give a natural explanation followed by the answer."),
    ("gqa_canonical_v1", "gqa", "canonical", False,
     "You are generating evidence-faithful reasoning traces for real-image compositional visual reasoning. "
     "Use only object and relation references that are visually supported.",
     _ASK + "Answer:"),
    ("gqa_light_v1", "gqa", "light", False,
     "You are generating concise step-by-step compositional visual reasoning.",
     _ASK + _STEPS + "Be explicit about counted objects or relations when relevant."),
    ("gqa_free_v1", "gqa", "free", False,
     "Answer the visual reasoning question naturally while remaining visually faithful.",
     _ASK + "Give a natural explanation followed by the answer."),
    ("visualwebbench_canonical_v1", "visualwebbench", "canonical", True,
     "You are generating evidence-faithful reasoning traces for web-grounding tasks. "
     "Use only visible UI elements, text, icons, or layout cues supported by the screenshot.",
     _ASK + "Task: Answer the question or predict the next action and provide a structured reasoning trace. "
     "Cite UI elements with element ids when possible.\n\n" + _STRUCTURED),
    ("visualwebbench_light_v1", "visualwebbench", "light", False,
     "You are generating concise step-by-step web-grounding reasoning.",
     _ASK + _STEPS + "Mention visible UI elements or evidence cues when possible."),
    ("visualwebbench_free_v1", "visualwebbench", "free", False,
     "Answer the web-grounding question naturally while remaining screenshot-faithful.",
     _ASK + "Give a natural explanation followed by the answer."),
]


def templates(spark: SparkSession, benchmark: str | None = None) -> DataFrame:
    """The prompt templates (nine rows), by id."""
    schema = "prompt_id string, t_benchmark string, trace_mode string, expects_json boolean, system_prompt string, user_template string"
    out = spark.createDataFrame(sorted(TEMPLATES), schema)
    return out if benchmark is None else out.where(F.col("t_benchmark") == benchmark)


def fill(template: Column, **values: Column) -> Column:
    """A format string with its named fields filled and doubled braces single; text in values is not filled again."""
    mark = "\x00"
    out = F.replace(F.replace(template, F.lit("{{"), F.lit(mark + "<")), F.lit("}}"), F.lit(mark + ">"))
    for k, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"{mark}{k}{mark}"))
    out = F.replace(F.replace(out, F.lit(mark + "<"), F.lit("{")), F.lit(mark + ">"), F.lit("}"))
    for k, value in enumerate(values.values()):
        out = F.replace(out, F.lit(f"{mark}{k}{mark}"), F.coalesce(F.replace(value, F.lit(mark), F.lit("")), F.lit("")))
    return out


def build_requests(manifest: DataFrame, prompt_id: str, model_name: str = "teacher", seed: int = 0, limit: int | None = None, order: str | list[str] | None = None) -> DataFrame:
    """One request per manifest row (of the first ``limit`` in an order, such as path and line): prompt texts and configuration. Raises if the template is for another benchmark."""
    found = [t for t in TEMPLATES if t[0] == prompt_id]
    if not found:
        raise KeyError(f"unknown prompt template {prompt_id}")
    rows = manifest if limit is None else manifest.orderBy(*([order] if isinstance(order, str) else order or ["example_id"])).limit(limit)
    _, benchmark, mode, expects_json, system, user = found[0]
    checked = F.when(F.col("benchmark") == benchmark, F.lit(user)).otherwise(F.raise_error(F.lit(f"prompt {prompt_id} targets {benchmark}")))
    fields = {c: F.col(c) for c in ("question", "image_path", "example_id", "benchmark")}
    return rows.withColumns(
        {
            "request_id": F.concat_ws("__", "example_id", F.lit(prompt_id), F.lit(f"seed{seed}")),
            "prompt_id": F.lit(prompt_id), "trace_mode": F.lit(mode), "expects_json": F.lit(expects_json),
            "model_name": F.lit(model_name), "seed": F.lit(seed), "system": F.lit(system), "user": fill(checked, **fields),
        }
    )


_JSON_STEPS = "array<struct<step_id int, step_text string, step_type string, grounding_ref string, evidence_value string, label int, error_type string>>"


def parse_outputs(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, failures) from rows with raw_text and the request columns.

    Structured answers are read where the template expects them and the text is
    one JSON object; all others are segmented by the template's mode. Rows whose
    text gives no step go to the failures, with a reason.
    """
    raw = T.strip(F.coalesce("raw_text", F.lit("")))
    payload = F.when(F.col("expects_json"), T.json_object(F.col("raw_text")))
    rows = outputs.withColumns({"__raw": raw, "__payload": payload})
    listed = F.try_variant_get("__payload", "$.steps", _JSON_STEPS)
    plain = T.segment(F.col("__raw"), F.col("trace_mode"))
    paragraphs = F.filter(F.transform(F.split("__raw", "\n\n"), T.strip), lambda s: s != "")
    segments = F.when(F.size(plain) > 0, plain).otherwise(paragraphs)
    from_text = F.transform(
        segments,
        lambda s, i: F.struct(
            (i + 1).alias("step_id"), s.alias("step_text"), T.step_type(s, F.col("benchmark")).alias("step_type"), F.lit("").alias("grounding_ref"),
            F.lit("").alias("evidence_value"), F.lit(1).alias("label"), F.lit("none").alias("error_type"),
        ),
    )
    from_json = F.transform(
        listed,
        lambda s: s.withField("label", F.coalesce(s["label"], F.lit(1))).withField("error_type", F.coalesce(s["error_type"], F.lit("none"))),
    )
    is_json = F.col("__payload").isNotNull()
    rows = rows.withColumn("steps", F.when(is_json, from_json).otherwise(from_text).cast(f"array<{STEP}>"))
    said = F.nullif(T.strip(F.try_variant_get("__payload", "$.predicted_answer", "string")), F.lit(""))
    last = F.element_at(F.transform("steps", lambda s: s["step_text"]), -1)
    rows = rows.withColumn("__ok", F.coalesce(F.size("steps") > 0, F.lit(False)))
    answer = F.when(is_json, said).otherwise(T.extracted_answer(F.col("raw_text"), F.when(F.col("__ok"), last)))
    rows = rows.withColumn("predicted_answer", F.when(F.col("__ok"), answer))
    traces = rows.where("__ok").select(
        F.col("request_id").alias("trace_id"), "example_id", "benchmark", "image_path", "question", F.col("answer").alias("gold_answer"),
        "predicted_answer", "trace_mode", "steps", F.when(is_json, "json").otherwise("text").alias("parsing_mode"),
    )
    reason = F.when(F.col("__raw") == "", "empty_text").when(is_json, "no_steps").otherwise("not_segmented")
    return traces, rows.where(~F.col("__ok")).select("request_id", "example_id", reason.alias("reason"))


def first_outputs(outputs: DataFrame, order: str) -> DataFrame:
    """The first output of each request."""
    return keep_first(outputs, ["request_id"], [order])
