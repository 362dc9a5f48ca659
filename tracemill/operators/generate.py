"""Traces made from scenes and from questions with known answers, their pairs, and seeds and splits by key.

Choices are hashes of (seed, name of the choice, key), so every run makes the same traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.picks import draw, pick
from tracemill.operators.corrupt import first_difference, prefix_corruption
from tracemill.operators.metrics import ordinals
from tracemill.schemas import STEP, TRACE

# fixed values: what a scene object is described by, and the kinds of questions about scenes
ATTRIBUTES = ("size", "color", "material", "shape")
SCENE_KINDS = ("count", "exist", "relation")


def _json(value: Column) -> Column:
    """A value as JSON text; null for null."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def _ref(kind: str, *more: Column, **fields: Column) -> Column:
    """A reference as a JSON object, spaced as Python's json module does; null fields are left out."""
    named = [F.concat(F.lit(f'"{k}": '), _json(v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", F.lit(f'"type": "{kind}"'), *named, *more), F.lit("}"))


def _steps(*steps: tuple) -> Column:
    """Right steps from (type, text, reference, evidence)."""
    made = [
        F.struct(F.lit(k), text, F.lit(kind), ref, evidence, F.lit(1), F.lit("none")).cast(STEP) for k, (kind, text, ref, evidence) in enumerate(steps, 1)
    ]
    return F.array(*made)


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _count(rows: DataFrame, salt) -> DataFrame:
    attribute = pick(F.array(*(F.lit(a) for a in ATTRIBUTES)), *salt("attribute"))
    rows = rows.withColumn("__a", attribute)
    of = lambda o: F.coalesce(*(F.when(F.col("__a") == a, o[a]) for a in ATTRIBUTES))
    rows = rows.withColumn("__all", F.transform("objects", of))
    known = F.array_sort(F.array_distinct(F.filter("__all", lambda v: v != "")))
    rows = rows.withColumn("__v", pick(known, *salt("value")))
    rows = rows.withColumn("__n", F.size(F.filter("__all", lambda v: v == F.col("__v"))))
    a, v, n, size = F.col("__a"), F.col("__v"), F.col("__n"), F.size("objects")
    steps = _steps(
        ("locate", _say("Locate all objects in the scene"), _ref("all_objects", count=size), _say(size.cast("string"), " objects")),
        ("read", _say("Filter objects by ", a, "=", v), _ref("attribute_filter", attr=a, value=v), v),
        ("compute", _say("Count the filtered objects"), _ref("count", result=n), n.cast("string")),
        ("answer", _say("The answer is ", n.cast("string")), _ref("final_answer", value=n), n.cast("string")),
    )
    return rows.where("__v is not null").withColumns({"question": _say("How many objects are ", v, "?"), "answer": n.cast("string"), "steps": steps})


def _exist(rows: DataFrame, salt) -> DataFrame:
    rows = rows.withColumn("__o", pick(F.col("objects"), *salt("target")))
    rows = rows.withColumns({"__s": F.coalesce("__o.shape", F.lit("cube")), "__c": F.coalesce("__o.color", F.lit("red"))})
    hit = F.exists("objects", lambda o: o["shape"].eqNullSafe(F.col("__s")) & o["color"].eqNullSafe(F.col("__c")))
    rows = rows.withColumn("__found", hit)
    shape, found = F.col("__s"), F.col("__found")
    thing, word = F.concat_ws(" ", "__c", "__s"), F.when(found, "yes").otherwise("no")
    steps = _steps(
        ("locate", _say("Search for a ", thing, " in the scene"), _ref("object_search", shape=shape, color=F.col("__c")), thing),
        ("read", _say(F.when(found, "Found").otherwise("Did not find"), " a ", thing), _ref("existence_check", result=found), F.when(found, "True").otherwise("False")),
        ("answer", _say("The answer is ", word), _ref("final_answer", value=found), word),
    )
    return rows.where("__o is not null").withColumns({"question": _say("Is there a ", thing, "?"), "answer": word, "steps": steps})


def _relation(rows: DataFrame, salt) -> DataFrame:
    rows = rows.withColumn("__p", pick(F.col("objects"), *salt("first")))
    rows = rows.withColumn("__q", pick(F.filter("objects", lambda o: ~o.eqNullSafe(F.col("__p"))), *salt("second")))
    x = {side: F.coalesce(F.get(F.col(side)["pixel_coords"], F.lit(0)), F.lit(50.0)) for side in ("__p", "__q")}
    rows = rows.withColumn("__r", F.when(x["__p"] < x["__q"], "left of").otherwise("right of"))
    relation, names, located = F.col("__r"), [], []
    for k, (side, color, shape) in enumerate((("__p", "red", "cube"), ("__q", "blue", "sphere"))):
        o = F.col(side)
        name = F.concat_ws(" ", F.coalesce(o["color"], F.lit(color)), F.coalesce(o["shape"], F.lit(shape)))
        seen = F.concat_ws(" ", F.coalesce(o["color"], F.lit("None")), F.coalesce(o["shape"], F.lit("None")))
        place = _say('"pixel_coords": [', F.array_join(F.transform(o["pixel_coords"], lambda c: c.cast("string")), ", "), "]")
        ref = _ref("object", place, id=F.lit(k), **{a: o[a] for a in ATTRIBUTES})
        names.append(name)
        located.append(("locate", _say("Locate the ", name), ref, seen))
    steps = _steps(
        *located,
        ("relate", _say("Determine spatial relation: object 1 is ", relation, " object 2"), _ref("spatial_relation", relation=relation), relation),
        ("answer", _say("The answer is ", relation), _ref("final_answer", value=relation), relation),
    )
    question = _say("What is the spatial relation between the ", names[0], " and the ", names[1], "?")
    return rows.where("__p is not null and __q is not null").withColumns({"question": question, "answer": relation, "steps": steps})


_SCENES = {"count": _count, "exist": _exist, "relation": _relation}


def scene_traces(scenes: DataFrame, kind: str, image_root: str = "images", seed: int = 42) -> DataFrame:
    """(image_filename, question_type, image_path, question, answer, steps): one trace for each scene that the kind fits.

    ``scenes`` holds image_filename and objects (structs of the four attributes
    and pixel_coords). Left out are scenes without objects, for counts those
    without the chosen attribute, for relations those whose objects are all alike.
    """
    rows = _SCENES[kind](scenes.select("image_filename", "objects"), lambda name: (F.lit(seed), F.lit(name), F.col("image_filename")))
    name = F.lower("image_filename")
    split = F.when(F.contains(name, F.lit("train")), "train").when(F.contains(name, F.lit("test")), "test").otherwise("val")
    path = F.concat_ws("/", F.lit(image_root), split, "image_filename")
    return rows.select("image_filename", F.lit(kind).alias("question_type"), path.alias("image_path"), "question", "answer", "steps")


# fixed values: the sentences of traces about documents and about photographs with text
_READING = {
    "docvqa": ("Locate the document in the image", "document_region", "document detected", "Read the document text to answer: ", "Extract the answer from the document text"),
    "textvqa": ("Locate text regions in the image", "text_region", "text detected", "Read the text content: ", "Extract the answer from the text"),
}


def most_given(answers: Column) -> Column:
    """The answer given most often; of equals the largest, null for none."""
    counted = F.transform(F.array_distinct(answers), lambda a: F.struct(F.size(F.filter(answers, lambda b: b == a)).alias("n"), a.alias("a")))
    return F.array_max(counted)["a"]


def reading_traces(questions: DataFrame, kind: str, image_root: str = "images") -> DataFrame:
    """``questions`` (question_id, image_id, question, answers) with image_path, answer and four steps; those without answers are left out.

    Questions about documents whose only answer is blank are left out too.
    """
    locate, region, seen, read, extract = _READING[kind]
    rows = questions.withColumns({"question": F.coalesce("question", F.lit("")), "image_id": F.coalesce("image_id", F.lit("")), "answer": most_given(F.col("answers"))})
    rows = rows.where(F.col("answer").isNotNull())
    rows = rows.where(F.col("answers") != F.array(F.lit(""))) if kind == "docvqa" else rows
    answer, short = F.col("answer"), F.substring("question", 1, 50)
    steps = _steps(
        ("locate", _say(locate), _ref(region, image_id=F.col("image_id")), _say(seen)),
        ("read", _say(read, short), _ref("ocr_text", question=short), short),
        ("extract", _say(extract), _ref("answer_extraction", answer=answer), answer),
        ("answer", _say("The answer is ", answer), _ref("final_answer", value=answer), answer),
    )
    path = F.concat_ws("/", F.lit(image_root), "image_id") if kind == "docvqa" else _say(image_root, "/", F.col("image_id"), ".jpg")
    return rows.select("question_id", "image_id", path.alias("image_path"), "question", "answer", steps.alias("steps"))


# fixed values: types of a stand-in trace's steps
STAND_IN_TYPES = ("locate", "read", "relate", "compute", "answer")


def stand_in_traces(examples: DataFrame, n_steps: int = 3) -> DataFrame:
    """Traces of ``examples`` (example_id, benchmark, answer) whose texts name only the example; for tests without a teacher."""
    key = F.col("example_id")
    types = [STAND_IN_TYPES[min(k, len(STAND_IN_TYPES) - 1)] for k in range(n_steps)]
    steps = _steps(*((t, _say(f"Step {k + 1} reasoning for ", key), _say(f"region_{k}_", key), F.lit(f"value_{k}")) for k, t in enumerate(types)))
    path = _say("/data/", F.col("benchmark"), "/", key, ".jpg")
    return examples.select(
        _say("trace_", key).alias("trace_id"), key, "benchmark", path.alias("image_path"), _say("Question for ", key).alias("question"),
        F.col("answer").alias("gold_answer"), F.col("answer").alias("predicted_answer"), F.lit("canonical").alias("trace_mode"), steps.alias("steps"),
    )


def for_training(traces: DataFrame) -> DataFrame:
    """Only the columns of the trace schema, typed; the mode is canonical and other columns go."""
    return traces.withColumn("trace_mode", F.lit("canonical")).to(traces.sparkSession.createDataFrame([], TRACE).schema)


def same_answer_pairs(traces: DataFrame) -> DataFrame:
    """Each trace beside its copy with wrong evidence in step 2 and the same answer: positive, negative, t_star and family."""
    both = traces.withColumn("__bad", prefix_corruption(F.col("steps")))
    both = both.withColumn("__bad", F.transform("__bad", lambda s: F.when(s["label"] == 0, s.withField("error_type", F.lit("wrong_intermediate_evidence"))).otherwise(s)))
    return both.select(
        F.col("trace_id").alias("positive_id"), F.concat("trace_id", F.lit("_f5")).alias("negative_id"), F.col("steps").alias("positive_steps"),
        F.col("__bad").alias("negative_steps"), first_difference(F.col("steps"), F.col("__bad")).alias("t_star"), F.lit("f5_correct_answer_wrong_evidence").alias("family"),
    )


def _wide_draw(*salts: Column) -> Column:
    """A 60-bit number from the salts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(s.cast("string") for s in salts))), 1, 15), 16, 10).cast("long")


def _ranges(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_by_share(rows: DataFrame, key: str, share: float = 0.8, salt: str = "pairs") -> DataFrame:
    """Adds split: exactly the integer part of ``share`` of the rows, in the order of a hash of the distinct ``key``, is train, the rest test."""
    shuffled = ordinals(rows.withColumn("__draw", _wide_draw(F.lit(salt), F.col(key))), "__draw", "__k", _ranges(rows))
    first = int(rows.count() * share)
    return shuffled.withColumn("split", F.when(F.col("__k") < first, "train").otherwise("test")).drop("__draw", "__k")


def with_seed(rows: DataFrame, order: str, base: int = 42) -> DataFrame:
    """Adds seed: ``base`` plus the row's place, from 0, in the order of the distinct number ``order``."""
    return ordinals(rows, order, "seed", _ranges(rows)).withColumn("seed", F.col("seed") + base)


def stand_in_score(*salts: Column) -> Column:
    """A number of [0, 1) that stands in for a model's score."""
    return draw(*salts) / F.lit(float(2**32))
