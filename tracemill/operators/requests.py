"""Generation requests and their outputs, read with defaults, and requests in the form that batch inference takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import filled

# fixed values: defaults of a generation
MAX_TOKENS, TEMPERATURE, TOP_P = 1024, 0.2, 0.95

CONFIG = "struct<model_name string, prompt_id string, max_tokens int, temperature double, top_p double, seed int>"
EXAMPLE = "struct<example_id string, benchmark string, image_path string, question string, answer string>"
#: a line of outputs: the request as it was, or its fields side by side
OUTPUT = (
    f"request struct<example {EXAMPLE}, config {CONFIG}, prompt map<string,string>>, example_id string, benchmark string, image_path string, question string, "
    f"gold_answer string, answer string, reference_answer string, config {CONFIG}, prompt map<string,string>, raw_text string, provider string"
)
#: a line of requests: an example with its prompt, or a ready prompt text
REQUEST = (
    f"request_id string, example_id string, example {EXAMPLE}, config {CONFIG}, prompt string, max_tokens int, temperature double, top_p double, "
    f"generation_config {CONFIG}"
)


def _settings(config: Column) -> dict[str, Column]:
    text = lambda f: F.coalesce(F.trim(config[f]), F.lit(""))
    return {
        "model_name": text("model_name"), "prompt_id": text("prompt_id"), "max_tokens": F.coalesce(config["max_tokens"], F.lit(MAX_TOKENS)),
        "temperature": F.coalesce(config["temperature"], F.lit(TEMPERATURE)), "top_p": F.coalesce(config["top_p"], F.lit(TOP_P)), "seed": F.coalesce(config["seed"], F.lit(0)),
    }


def outputs_with_defaults(rows: DataFrame) -> DataFrame:
    """One flat row per output line of type :data:`OUTPUT`: the nested request where there is one, else the line's own fields.

    The answer of a flat line is the first that is not empty of gold_answer,
    answer and reference_answer, else empty.
    """
    nested = F.col("request").isNotNull()
    own = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("gold_answer", "answer", "reference_answer")), F.lit(""))
    both = lambda f, flat: F.when(nested, F.col("request.example")[f]).otherwise(flat)
    rows = rows.withColumn("__config", F.when(nested, F.col("request.config")).otherwise(F.col("config")))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return rows.select(
        *(both(f, F.col(f)).alias(f) for f in ("example_id", "benchmark", "image_path", "question")), both("answer", own).alias("answer"),
        *(c.alias(f) for f, c in _settings(F.col("__config")).items()),
        F.coalesce(F.when(nested, F.col("request.prompt")).otherwise(F.col("prompt")), empty).alias("prompt"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce(filled(F.col("provider")), F.lit("unknown")).alias("provider"),
    )


def batch_requests(rows: DataFrame) -> DataFrame:
    """Requests of type :data:`REQUEST` as (request_id, example_id, prompt, max_tokens, temperature, top_p).

    A row with an example is named by it and asks its prompt's user text;
    another keeps its own id, prompt and settings, which may stand in
    generation_config.
    """
    nested = F.col("example").isNotNull()
    user = F.get_json_object("prompt", "$.user")
    settings = {"max_tokens": MAX_TOKENS, "temperature": TEMPERATURE, "top_p": TOP_P}
    of = lambda f: F.when(nested, F.col("config")[f]).otherwise(F.coalesce(F.col(f), F.col("generation_config")[f]))
    return rows.select(
        F.when(nested, F.col("example.example_id")).otherwise(F.coalesce("request_id", "example_id")).alias("request_id"),
        F.when(nested, F.col("example.example_id")).otherwise(F.col("example_id")).alias("example_id"),
        F.when(nested, user).otherwise(F.col("prompt")).alias("prompt"), *(F.coalesce(of(f), F.lit(v)).alias(f) for f, v in settings.items()),
    )
