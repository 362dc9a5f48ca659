import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import text as T
from tracemill.operators import corrupt, traces, training, verify

SPANS = [("17", "INV-7", ""), ("18", "Total", ""), ("19", "12 EUR", "")]
SCENE = [("1", "cup", ["red", "small"], [("on", "2")]), ("2", "table", [], []), ("3", "plate", ["blue"], [])]
OBJECTS = "array<struct<object_id string, name string, attributes array<string>, relations array<struct<name string, target_object_id string>>>>"


def step(k, kind, ref="", value="", text="so it is"):
    return (k, text, kind, ref, value, 1, "none")


def trace_rows(spark, steps, **more):
    fields = {"trace_id": "t", "example_id": "e", "benchmark": "docvqa", "image_path": "/i", "question": "q", "gold_answer": "INV-7", "predicted_answer": "inv 7", "trace_mode": "canonical"} | more
    schema = ", ".join(f"{k} string" for k in fields) + f", steps array<{schemas.STEP}>, spans array<struct<span_id string, text string, normalized_text string>>, objects {OBJECTS}, "
    schema += "elements array<struct<element_id string, text string>>"
    return spark.createDataFrame([(*fields.values(), steps, SPANS, SCENE, [("a", "Buy"), ("b", "Sell")])], schema)


def issues(spark, s, kind="span"):
    check = {"span": lambda x: verify.span_issues(x, F.col("spans")), "object": lambda x: verify.object_issues(x, F.col("objects"))}[kind]
    return trace_rows(spark, [s]).select(F.transform("steps", check)).first()[0][0]


@pytest.mark.parametrize(
    ("s", "expected"),
    [
        (step(1, "read", "ocr_span:17", "inv 7"), []),
        (step(1, "read"), ["missing_grounding_ref", "missing_evidence_value"]),
        (step(1, "read", "ocr_span:ocr_word:0", "x"), ["unknown_grounding_ref"]),
        (step(1, "read", "ocr_span:17", "total"), ["evidence_mismatch"]),
        (step(1, "answer"), []),
        (step(1, "reason"), ["missing_grounding_ref"]),
        (step(1, "derive"), []),
        (step(1, "locate", "ocr_span:17"), []),
        (step(1, "compute", "ocr_span:17"), ["missing_evidence_value"]),
    ],
)
def test_span_issues(spark, s, expected):
    assert issues(spark, s) == expected


@pytest.mark.parametrize(
    ("s", "expected"),
    [
        (step(1, "count", "objects:1,2", "3"), ["evidence_mismatch"]), (step(1, "count", "objects:1,2", "two"), ["evidence_mismatch"]), (step(1, "count", "objects:1,2", "2"), []),
        (step(1, "identify", "object:1", "blue"), ["evidence_mismatch"]), (step(1, "identify", "object:1", "red"), []), (step(1, "identify", "object:2", "Table"), []),
        (step(1, "relate", "relation:on:1:2", "x"), []), (step(1, "relate", "relation:on:2:1", "x"), ["evidence_mismatch"]), (step(1, "relate", "relation:on:9:1", "x"), ["unknown_grounding_ref"]),
        (step(1, "relate", "relation::1:2", "x"), ["malformed_grounding_ref"]), (step(1, "identify", "object:", "x"), ["unknown_grounding_ref"]),
        (step(1, "relate", "foo:1", ""), ["malformed_grounding_ref"]), (step(1, "count", "objects:1,8", "2"), ["unknown_grounding_ref"]),
    ],
)
def test_object_issues(spark, s, expected):
    assert issues(spark, s, "object") == expected


def test_repeated_ids_keep_the_last(spark):
    row = spark.sql(
        "select struct('identify' step_type, 'object:1' grounding_ref, 'blue' evidence_value) s, struct('read' step_type, 'element:a' grounding_ref, 'new' evidence_value) w,"
        "array(named_struct('object_id', '1', 'name', 'red', 'attributes', cast(array() as array<string>), 'relations', cast(array() as array<struct<name string, target_object_id string>>)),"
        "named_struct('object_id', ' 1 ', 'name', 'blue', 'attributes', cast(array() as array<string>), 'relations', cast(array() as array<struct<name string, target_object_id string>>))) objects,"
        "array(named_struct('element_id', 'a', 'text', 'old'), named_struct('element_id', 'a', 'text', 'new')) elements"
    )
    assert row.select(verify.object_issues(F.col("s"), F.col("objects"))).first()[0] == []
    assert row.select(verify.element_issues(F.col("w"), F.col("elements"), F.lit("element"))).first()[0] == []


def test_weak_mode_checks_form_only(spark):
    rows = trace_rows(spark, [step(1, "read")])
    assert rows.select(verify.element_issues(F.col("steps")[0], F.col("elements"), F.lit("weak_answer"))).first()[0] == []


def test_wrong_answer_outranks_failed_step(spark):
    rows = trace_rows(spark, [step(1, "read")], predicted_answer="no").selectExpr("*", "'e' m_example_id", "'docvqa' m_benchmark", "gold_answer m_answer")
    out = verify.validate(rows, lambda s: verify.span_issues(s, F.col("spans")))
    row = out.first()
    assert (row["passed"], row["answer_correct"], row["rejection_reason"]) == (False, False, "wrong_answer")
    annotated = verify.annotate(out).first()["steps"][0]
    assert (annotated["label"], annotated["error_type"]) == (0, "missing_grounding_ref")


def test_schema_violations(spark):
    good = trace_rows(spark, [step(1, "read"), step(2, "answer")])
    assert schemas.violations(good).count() == 0
    bad = trace_rows(spark, [step(2, "read"), step(1, "nonsense")], benchmark="x", question=" ")
    assert {r["violation"] for r in schemas.violations(bad).collect()} == {"blank_question", "unknown_benchmark", "step_ids_not_contiguous", "unknown_step_type"}


STEPS = [step(1, "locate", "ocr_span:17", "INV-7", "Locate left of it."), step(2, "read", "ocr_span:18", "Total", "Read it."), step(3, "answer", "", "", "So 7.")]


@pytest.mark.parametrize("suite", ["main", "cross", "wrong_use"])
@pytest.mark.parametrize("benchmark", ["docvqa", "gqa", "visualwebbench"])
def test_corruptions_change_one_step(spark, suite, benchmark):
    refs = {"docvqa": ("ocr_span:17", "ocr_span:18"), "gqa": ("object:1", "relation:on:1:2"), "visualwebbench": ("element:a", "element:b")}[benchmark]
    steps = [step(1, "identify" if benchmark == "gqa" else "locate", refs[0], "red", "It is left of it."), step(2, "relate" if benchmark == "gqa" else "read", refs[1], "Buy", "Read it."), step(3, "answer", "", "", "So 7.")]
    source = trace_rows(spark, steps, benchmark=benchmark)
    out = corrupt.corrupt(source, benchmark, suite).collect()
    assert out and len({r["trace_id"] for r in out}) == len(out)
    for r in out:
        labels = [s["label"] for s in r["steps"]]
        assert labels.count(0) == 1 and labels[r["target_step_id"] - 1] == 0
        assert r["predicted_answer"] == "inv 7" and r["source_trace_id"] == "t" and r["target_step_id"] != 3
        before, after = steps[r["target_step_id"] - 1], r["steps"][r["target_step_id"] - 1]
        assert r["noop_corruption"] == (before[1:5] == (after["step_text"], after["step_type"], after["grounding_ref"], after["evidence_value"]))


def test_corruption_names_and_families(spark):
    source = trace_rows(spark, STEPS)
    out = corrupt.corrupt(source, "docvqa", families=["wrong_value"]).collect()
    assert [r["trace_id"] for r in out] == ["t__main__wrong_value__s2"]
    with pytest.raises(ValueError):
        corrupt.corrupt(source, "docvqa", families=["missing_step"])


def test_datasets(spark):
    clean = trace_rows(spark, STEPS).withColumn("o", F.lit(1))
    bad = corrupt.corrupt(clean, "docvqa")
    points = training.pointwise(clean, bad).collect()
    assert sum(p["trace_label"] for p in points) == 1 and all(p["record_id"] == "pointwise::" + p["trace_id"] for p in points)
    pairs = training.pairwise(clean, bad, "o")
    assert pairs.count() == bad.count()
    assert training.quality_profile(pairs.withColumn("t_star", corrupt.first_difference(F.col("preferred_steps"), F.col("rejected_steps")))).first()["with_wrong_step"] == bad.count()
    target = training.pointwise_target(F.array(F.lit(1), F.lit(0)), F.lit(0.5), F.lit(0))
    assert clean.select(target).first()[0] == '{"step_labels": [1, 0], "final_score": 0.5, "trace_label": 0}'


def test_pairs_of_corruptions_with_their_source(spark):
    """As the joins make them, of many traces of an example, with and without a verdict of the validation."""
    shorter = trace_rows(spark, STEPS[1:], trace_id="u", predicted_answer="8")
    clean = trace_rows(spark, STEPS).unionByName(shorter).withColumn("o", F.length("predicted_answer"))
    for rows in (clean, clean.withColumn("answer_correct", F.col("trace_id") == "u"), clean.drop("gold_answer")):
        want = training.pairwise(rows, corrupt.corrupt(rows, "docvqa"), "o")
        got = training.pairwise_of(corrupt.corrupt(rows, "docvqa", source_steps=True))
        assert got.columns == want.columns and got.count() > 2
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "source_steps" not in corrupt.corrupt(clean, "docvqa").columns


def test_first_difference(spark):
    row = spark.sql("SELECT array(struct(1 AS label), struct(1 AS label)) a, array(struct(1 AS label), struct(0 AS label)) b")
    assert row.select(corrupt.first_difference(F.col("a"), F.col("b")), corrupt.first_difference(F.col("a"), F.col("a"))).first()[:] == (2, 1)


def outputs(spark, mode, expects_json, text):
    cols = "request_id string, example_id string, benchmark string, image_path string, question string, answer string, trace_mode string, expects_json boolean, raw_text string"
    return spark.createDataFrame([("r", "e", "docvqa", "/i", "q", "a", mode, expects_json, text)], cols)


def test_parse_outputs(spark):
    good, bad = traces.parse_outputs(outputs(spark, "light", False, "1. Locate the header.\n2. The label shows INV-7.\nAnswer: INV-7."))
    row = good.first()
    assert [s["step_type"] for s in row["steps"]] == ["locate", "read", "derive"] and row["predicted_answer"] == "INV-7" and bad.count() == 0
    text = '```json\n{"predicted_answer": " x ", "steps": [{"step_id": 1, "step_text": "s", "step_type": "read"}]}\n```'
    row = traces.parse_outputs(outputs(spark, "canonical", True, text))[0].first()
    assert (row["parsing_mode"], row["predicted_answer"], row["steps"][0]["label"], row["steps"][0]["error_type"]) == ("json", "x", 1, "none")
    good, bad = traces.parse_outputs(outputs(spark, "light", False, None))
    assert good.count() == 0 and bad.first()["reason"] == "empty_text"
    assert traces.parse_outputs(outputs(spark, "canonical", True, '{"steps": []}'))[1].first()["reason"] == "no_steps"


def test_requests(spark):
    manifest = spark.createDataFrame([("e", "docvqa", "/i/{question}", "What {image_path}?")], "example_id string, benchmark string, image_path string, question string")
    row = traces.build_requests(manifest, "docvqa_canonical_v1", seed=3).first()
    assert row["user"] == "Question: What {image_path}?\nImage path: /i/{question}\nAnswer:" and row["request_id"] == "e__docvqa_canonical_v1__seed3"
    with pytest.raises(KeyError):
        traces.build_requests(manifest, "nope")
    with pytest.raises(Exception, match="targets gqa"):
        traces.build_requests(manifest, "gqa_free_v1").collect()
    assert traces.templates(spark, "gqa").count() == 3


def scene_rows(spark, steps, scene):
    rows = trace_rows(spark, steps, benchmark="gqa").drop("objects")
    return rows.crossJoin(spark.createDataFrame([(scene,)], f"objects {OBJECTS}"))


@pytest.mark.parametrize(("edges", "expected"), [(["on", "below"], "relation:below:1:2"), (["below", "on"], "relation:above:1:2")])
def test_relation_of_the_last_object_of_an_id(spark, edges, expected):
    """``above`` becomes ``below`` only where the last object of the source's id has such an edge."""
    scene = [("1", "cup", [], [(e, "2")]) for e in edges] + [("2", "table", [], [])]
    rows = scene_rows(spark, [step(1, "relate", "relation:above:1:2", text="The cup is above the table.")], scene)
    hit = corrupt.corrupt(rows, "gqa", families=["wrong_relation"]).first()["steps"][0]
    assert hit["grounding_ref"] == expected and "below" in hit["step_text"]


@pytest.mark.parametrize("suite", ["main", "cross"])
def test_references_without_ids(spark, suite):
    """An empty set of objects is swapped for an empty set: the reference stays, its value is 0 (main) or the evidence."""
    rows = scene_rows(spark, [step(1, "count", "objects:", "3")], SCENE)
    got = {r["family"]: r["steps"][0] for r in corrupt.corrupt(rows, "gqa", suite).collect()}
    assert got["wrong_region"]["grounding_ref"] == got["irrelevant_evidence"]["grounding_ref"] == "objects:"
    assert got["wrong_value"]["evidence_value"] == ("0" if suite == "main" else "3")
    assert got["irrelevant_evidence"]["evidence_value"] == "3"


def test_attribute_summaries_are_stripped(spark):
    from tracemill.functions.text import attribute_summary

    scene = [("1", " cup ", [" ", "red", "big"], []), (" 2 ", "table", [" oak "], []), ("3", " ", [" "], []), ("", "ghost", ["x"], []), ("2", "desk", None, [])]
    rows = scene_rows(spark, [step(1, "count")], scene)
    say = lambda *ids: rows.select(attribute_summary(F.col("objects"), F.array(*map(F.lit, ids)))).first()[0]
    assert say("1") == "red cup" and say("2", "3", "9", "1") == "desk, red cup" and say("") == "" and say("3") == ""


def test_datasets_take_the_verdict_of_the_validation(spark):
    """``INV 7`` equals ``inv-7!`` for the validation, which reads words, but not letter by letter."""
    clean = trace_rows(spark, [step(1, "derive")], gold_answer="INV 7", predicted_answer="inv-7!")
    judged = clean.withColumns({"m_example_id": F.col("example_id"), "m_benchmark": F.col("benchmark"), "m_answer": F.col("gold_answer")})
    judged = verify.validate(judged, lambda s: verify.span_issues(s, F.col("spans")))
    for rows, expected in ((clean, False), (judged, True)):
        bad = corrupt.corrupt(rows, "docvqa", families=["wrong_relation"])
        assert {r["answer_correct"] for r in training.pointwise(rows, bad).collect()} == {expected}
        pair = training.pairwise(rows, bad, "trace_id").first()
        assert (pair["preferred_answer_correct"], pair["rejected_answer_correct"]) == (expected, expected)


def python_choice(items, *salts):
    import random

    return items[random.Random("|".join(map(str, salts))).randrange(len(items))]


@pytest.mark.parametrize("benchmark", ["docvqa", "gqa", "visualwebbench"])
def test_choices_of_pythons_generator(spark, benchmark):
    """Steps and items are those that ``random.Random`` picks from the same strings; md5 stays the default."""
    import random

    ref = {"docvqa": "ocr_span:17", "gqa": "object:1", "visualwebbench": "element:a"}[benchmark]
    steps = [step(k, kind, ref, "x") for k, kind in enumerate(("read", "locate", "extract", "identify", "count", "answer"), 1)]
    rows = trace_rows(spark, steps, benchmark=benchmark)
    got = {}
    for seed in range(6):
        for r in corrupt.corrupt(rows, benchmark, seed=seed, families=["wrong_region"], rng="python").collect():
            liked = ("identify", "count", "relate", "extract") if benchmark == "gqa" else ("locate", "read", "extract")
            hit = python_choice([s for s in steps if s[2] in liked], seed, "t", "wrong_region", "step")
            if benchmark == "gqa":
                free = ["2", "3"]
                random.Random(f"{seed}|e|1|wrong_region").shuffle(free)
                new = f"object:{free[0]}"
            else:
                others = {"docvqa": ["ocr_span:18", "ocr_span:19"], "visualwebbench": ["element:b"]}[benchmark]
                new = python_choice(others, seed, "e", ref, "wrong_region")
            assert r["target_step_id"] == hit[0] and r["steps"][hit[0] - 1]["grounding_ref"] == new
            got[seed] = new, hit[0]
    assert len(got) == 6 and len(set(got.values())) > 1
    with pytest.raises(ValueError):
        corrupt.corrupt(rows, benchmark, rng="dice")


def test_python_takes(spark):
    import random

    from tracemill.functions import picks

    rows = spark.createDataFrame([(["c", "a", "b", "a"], 2), (["a"], 2), ([], 0), (None, 1)], "v array<string>, k int")
    with picks.generator("python"):
        chosen = picks.take(F.col("v"), F.col("k"), F.lit(7), F.lit("s"))
    items = ["c", "a", "b", "a"]
    random.Random("7|s").shuffle(items)
    assert [r[0] for r in rows.select(chosen).collect()] == [sorted(items[:2]), None, [], None]


def test_pointwise_texts_of_both_tables(spark):
    clean = trace_rows(spark, [step(1, "derive"), step(2, "answer")])
    bad = corrupt.corrupt(clean, "docvqa", families=["wrong_relation"])
    points = training.pointwise(clean, bad).join(clean.select("image_path", "question"))
    pairs = training.pairwise(clean, bad, "trace_id").join(clean.select("image_path", "question"))
    of_points = {r["record_id"]: r for r in training.pointwise_texts(points).collect()}
    pair = training.pointwise_texts(pairs).first()
    assert pair["record_id"] == "t" and pair["target"] == '{"step_labels": [1, 1], "final_score": 1.0, "trace_label": 1}'
    assert of_points["pointwise::t"]["prompt"] == pair["prompt"] and of_points["pointwise::t"]["target"] == pair["target"]


def test_profile_with_images(spark, tmp_path):
    from tracemill.sources import readers

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.png").write_bytes(b"x")
    rows = [(f"{tmp_path}/a/1.png", 1, [step(1, "read")[:5] + (0, "x")]), (f"{tmp_path}/a/2.png", 3, [step(1, "read")]), (None, 2, [step(1, "read")])]
    pairs = spark.createDataFrame(rows, f"image_path string, t_star int, rejected_steps array<{schemas.STEP}>")
    got = training.quality_profile(pairs, readers.existing_files(spark, f"file://{tmp_path}", "*.png")).first().asDict()
    assert got == {"n": 3, "min_t_star": 1, "max_t_star": 3, "with_wrong_step": 1, "with_image": 1, "image_share": pytest.approx(1 / 3)}


def test_texts_and_references_are_evaluated_once(spark):
    """A text, a reference and an object that rules read many times stand in the plan once, so expressions inside one another do not multiply."""
    rows = spark.createDataFrame([("so it is left of x", "relation:on:1:2")], "text string, ref string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    both = T.mutate_relation(T.mutate_inference(F.concat(F.lit("marked "), F.col("text"))))
    assert plan(both).count("marked") == 1
    assert rows.select(both.alias("x")).first().x == "marked still it is right of x"
    objects = F.array(F.struct(F.lit("1").alias("object_id"), F.lit("a").alias("name"), F.array(F.lit("red")).alias("attributes"), F.array(F.struct(F.lit("on").alias("name"), F.lit("2").alias("target_object_id"))).alias("relations")))
    step = F.struct(F.lit("relate").alias("step_type"), F.concat(F.col("ref"), F.lit("")).alias("grounding_ref"), F.lit("x").alias("evidence_value"))
    issues = verify.object_issues(F.col("s"), F.col("o"))
    rows = rows.withColumns({"s": step, "o": objects})
    assert plan(issues).count("split(") == 2  # the parts of a relation, and a list of ids
    assert rows.select(issues.alias("x")).first().x == []
