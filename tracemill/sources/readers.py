"""Readers and writers: JSON, JSON lines, Parquet shards, logs, scenes, and the typed tables of the data model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.lookup import keep_last
from tracemill.schemas import MANIFEST, TRACE
from tracemill.sources.splitting import read_elements, read_lines


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): one VARIANT per whole file, null where it is not JSON."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.try_parse_json("value").alias("payload"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Typed rows of JSON lines; blank lines are skipped. Strict reading fails at a bad line, the other keeps it in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(schema + ", _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of the lines that are not JSON objects; lines are numbered from 1 in each file."""
    lines = read_lines(spark, path).withColumnRenamed("value", "raw").where("trim(raw) <> ''")
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")), F.lit(""))
    return lines.where(~kind.startswith("OBJECT"))


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, ...) of JSON lines in the order of the files; blank lines are skipped but counted, lines that do not parse give nulls."""
    lines = read_lines(spark, path).where("trim(value) <> ''")
    return lines.select("path", "line", F.from_json("value", schema).alias("row")).select("path", "line", "row.*")


def write_jsonl(rows: DataFrame, path: str, ascii: bool = False) -> None:
    """JSON lines under a folder, overwriting it; nulls are written. ``ascii`` writes other characters as escapes of UTF-16 units."""
    if not ascii:
        return rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = lambda c: F.when(F.ascii(c) < 128, c).otherwise(units(c))
    plain = line.rlike(r"^[\x00-\x7f]*$")
    rows.select(F.when(plain, line).otherwise(F.array_join(F.transform(F.split(line, ""), escaped), "")).alias("value")).write.mode("overwrite").text(path)


def read_question_shards(spark: SparkSession, path: str) -> DataFrame:
    """questionId, question, docId and answers (stripped, blanks dropped) of Parquet shards; only those columns are scanned.

    Of a folder its ``train*`` shards are read, or all if there are none.
    """
    files = (path,) if path.endswith(".parquet") else (f"{path}/train*.parquet", f"{path}/*.parquet")
    rows = _first_found(spark.read.parquet, *files).select(F.col("questionId").cast("string"), "question", F.col("docId").cast("string"), "answers")
    return rows.withColumn("answers", F.filter(F.transform("answers", lambda a: F.trim(a)), lambda a: a != ""))


def existing_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of the files under a folder of any store, as paths without a scheme; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "").alias("path"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """step, loss, eval_loss and learning_rate of log lines that hold any of them; a plain loss may come from inside eval_loss."""
    line = spark.read.text(path)
    number = r"=\s*(\d+\.\d+)"
    return line.select(
        F.regexp_extract("value", r"step=\s*(\d+)", 1).try_cast("int").alias("step"),
        F.regexp_extract("value", "loss" + number, 1).try_cast("double").alias("loss"),
        F.regexp_extract("value", "eval_loss" + number, 1).try_cast("double").alias("eval_loss"),
        F.regexp_extract("value", r"learning_rate=\s*([0-9.eE+-]+)", 1).try_cast("double").alias("learning_rate"),
    ).where("coalesce(step, loss, eval_loss, learning_rate) is not null")


def _first_found(load, *paths: str) -> DataFrame:
    """What ``load`` gives for the first path (or pattern) that exists."""
    for path in paths:
        try:
            return load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {', '.join(paths)}")


_SCENE = "struct<image_filename string, objects array<struct<size string, color string, material string, shape string, pixel_coords array<double>>>>"


def read_scenes(spark: SparkSession, root: str) -> DataFrame:
    """(image_filename, objects) of ``scenes.json`` or of the split files under ``scenes``; the last scene of a file name wins, nameless ones go.

    Many tasks read a large file (:mod:`tracemill.sources.splitting`).
    """
    load = lambda path: read_elements(spark, path, "scenes")
    found = _first_found(load, f"{root}/scenes.json", f"{root}/scenes/CLEVR_*_scenes.json", f"{root}/scenes/*_scenes.json")
    rows = found.select("path", "pos", F.from_json("raw", _SCENE).alias("scene")).select("path", "pos", "scene.*")
    return keep_last(rows.where("image_filename <> ''"), ["image_filename"], ["path", "pos"]).drop("path", "pos")


def read_photo_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, image_id, question and answers of a JSON file with its rows under ``data``; a missing image_id is empty."""
    row = "struct<question_id string, image_id string, question string, answers array<string>>"
    rows = read_elements(spark, path, "data").select(F.from_json("raw", row).alias("row")).select("row.*")
    return rows.withColumn("image_id", F.coalesce("image_id", F.lit("")))


def read_document_questions(spark: SparkSession, root: str) -> DataFrame:
    """question_id, image_id, question and answers of ``train-*`` shards, else of ``validation-*``; images are never scanned.

    A row without an image id is named by document and question; one without
    answers has its single answer.
    """
    rows = _first_found(spark.read.parquet, f"{root}/train-*.parquet", f"{root}/validation-*.parquet")
    col = lambda name, kind="string": F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    rows = rows.select(
        F.coalesce(F.nullif(col("question_id"), F.lit("")), col("questionId"), F.lit("")).alias("question_id"), col("image_id").alias("image_id"),
        F.coalesce(col("docId"), F.lit("")).alias("doc"), F.coalesce(col("question"), F.lit("")).alias("question"),
        F.coalesce(col("answers", "array<string>"), F.array(F.coalesce(col("answer"), F.lit("")))).alias("answers"),
    )
    named = F.when(F.col("question_id") != "", F.concat("doc", F.lit("_"), "question_id", F.lit(".png"))).otherwise("")
    return rows.withColumn("image_id", F.coalesce(F.nullif("image_id", F.lit("")), named)).drop("doc")


def questions_of_images(questions: DataFrame) -> DataFrame:
    """(image_id, n, first_question_id) of each image; no image's questions are gathered."""
    return questions.groupBy("image_id").agg(F.count("*").alias("n"), F.min("question_id").alias("first_question_id"))


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.to(rows.sparkSession.createDataFrame([], schema).schema)


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest as JSON lines; what the adapters give as columns of their own becomes the metadata."""
    if "metadata" not in rows.columns:
        wanted = rows.sparkSession.createDataFrame([], MANIFEST).schema["metadata"].dataType
        own = lambda f: {"ocr_spans": "spans"}.get(f, f)
        parts = [(F.col(own(f.name)) if own(f.name) in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
        rows = rows.withColumn("metadata", F.struct(*parts))
    write_jsonl(_typed(rows, MANIFEST), path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MANIFEST)


def write_traces(rows: DataFrame, path: str) -> None:
    write_jsonl(_typed(rows, TRACE), path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRACE)


def _write_dataset(rows: DataFrame, path: str, needed: tuple[str, ...]) -> None:
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    write_jsonl(rows.select(*needed, *(c for c in rows.columns if c not in needed)), path)


def write_pointwise_dataset(rows: DataFrame, path: str) -> None:
    """Rows of :func:`tracemill.operators.training.pointwise` as JSON lines."""
    _write_dataset(rows, path, ("record_id", "example_id", "benchmark", "trace_id", "dataset_role", "trace_label", "trace_score_target", "step_labels"))


def write_pairwise_dataset(rows: DataFrame, path: str) -> None:
    """Rows of :func:`tracemill.operators.training.pairwise` as JSON lines."""
    _write_dataset(rows, path, ("pair_id", "example_id", "benchmark", "preferred_trace_id", "rejected_trace_id"))


def write_results(results: DataFrame, path: str) -> None:
    """The one row of a summary as JSON under a folder, nulls included."""
    write_jsonl(results.coalesce(1), path)
