"""The stages from manifests and outputs to training sets, for :class:`tracemill.runner.Runner`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import corrupt, training, verify
from tracemill.operators.traces import build_requests, first_outputs, parse_outputs
from tracemill.runner import Runner, Stage
from tracemill.sources.readers import read_numbered_jsonl
from tracemill.streaming.resume import resume

_RELATIONS = "array<struct<name string, target_object_id string>>"
#: by benchmark: the evidence columns of a manifest with their types, and the check of a step against them
EVIDENCE = {
    "docvqa": ({"spans": "array<struct<span_id string, text string, normalized_text string>>"}, lambda s: verify.span_issues(s, F.col("spans"))),
    "gqa": ({"objects": f"array<struct<object_id string, name string, attributes array<string>, relations {_RELATIONS}>>"}, lambda s: verify.object_issues(s, F.col("objects"))),
    "visualwebbench": (
        {"elements": "array<struct<element_id string, text string>>", "verification_mode": "string"},
        lambda s: verify.element_issues(s, F.col("elements"), F.col("verification_mode")),
    ),
}
MANIFEST = "example_id string, benchmark string, image_path string, question string, answer string"
OUTPUT = "request_id string, raw_text string"


def read_requests(spark: SparkSession):
    def build(manifest: str, benchmark: str, prompt_id: str, seed: int, limit: int | None) -> DataFrame:
        """The manifest's rows, in the order of its lines, as requests."""
        rows = read_numbered_jsonl(spark, manifest, ", ".join([MANIFEST, *(f"{c} {t}" for c, t in EVIDENCE[benchmark][0].items())]))
        return build_requests(rows, prompt_id, seed=seed, limit=limit, order=["path", "line"])

    return build


def read_answers(spark: SparkSession):
    def build(outputs: str, requests: DataFrame) -> DataFrame:
        """The first output of each request, by file and line, beside it."""
        said = read_numbered_jsonl(spark, outputs, OUTPUT).withColumn("place", F.struct("path", "line"))
        return requests.drop("path", "line").join(first_outputs(said, "place").select("request_id", "raw_text"), "request_id")

    return build


def parse(answers: DataFrame) -> DataFrame:
    return parse_outputs(answers)[0]


def failures(answers: DataFrame) -> DataFrame:
    return parse_outputs(answers)[1]


def judge(parsed: DataFrame, requests: DataFrame, benchmark: str) -> DataFrame:
    """Traces with their evidence, judged; labels are the validation's."""
    known = requests.select("request_id", F.col("example_id").alias("m_example_id"), F.col("benchmark").alias("m_benchmark"), F.col("answer").alias("m_answer"), *EVIDENCE[benchmark][0])
    met = parsed.join(known, parsed["trace_id"] == known["request_id"]).drop("request_id")
    return verify.annotate(verify.validate(met, EVIDENCE[benchmark][1]))


def corrupted(verified: DataFrame, benchmark: str, suite: str, seed: int) -> DataFrame:
    return corrupt.corrupt(verified, benchmark, suite, seed)


def some(**tables: DataFrame) -> bool:
    """A gate: no training set from nothing."""
    return all(rows.limit(1).count() for rows in tables.values())


def flow(spark: SparkSession, root: str, manifest: str, outputs: str, benchmark: str, prompt_id: str, seed: int = 0, limit: int | None = None) -> Runner:
    """Requests, answers, parsed traces and failures, verified and rejected ones, three suites of corruptions, and both training sets.

    The training sets take clean traces and those of the main suite; their gate
    is closed while either is missing.
    """
    of = {"benchmark": benchmark}
    suites = {"corrupted": "main", "corrupted_cross": "cross", "wrong_use": "wrong_use"}
    stages = [
        Stage("requests", ("manifest",), read_requests(spark), parameters=of | {"prompt_id": prompt_id, "seed": seed, "limit": limit}),
        Stage("answers", ("outputs", "requests"), read_answers(spark)),
        Stage("parsed", ("answers",), parse),
        Stage("failures", ("answers",), failures),
        Stage("judged", ("parsed", "requests"), judge, parameters=of),
        Stage("verified", ("judged",), lambda judged: judged.where("passed")),
        Stage("rejected", ("judged",), lambda judged: judged.where("not passed")),
        *(Stage(name, ("verified",), corrupted, parameters=of | {"suite": suite, "seed": seed}) for name, suite in suites.items()),
        Stage("pointwise", ("verified", "corrupted"), lambda verified, corrupted: training.pointwise(verified, corrupted), gate=some),
        Stage("pairwise", ("verified", "corrupted"), lambda verified, corrupted: training.pairwise(verified, corrupted, "trace_id"), gate=some),
    ]
    return Runner(spark, root, stages, {"manifest": manifest, "outputs": outputs})


def unanswered(runner: Runner) -> DataFrame:
    """Requests that no output answers yet."""
    done = runner.published()
    return resume(runner.table("requests"), runner.table("answers") if "answers" in done else None)
