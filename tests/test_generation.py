import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import generate, requests, summary
from tracemill.schemas import TRACE
from tracemill.sources import adapters, readers

SCENE = "image_filename string, objects array<struct<size string, color string, material string, shape string, pixel_coords array<double>>>"


def test_scene_files_last_wins(spark, tmp_path):
    (tmp_path / "scenes").mkdir()
    cube = {"size": "small", "color": "red", "material": "metal", "shape": "cube", "pixel_coords": [1, 2, 3], "rotation": 4.5}
    for name, scenes in (
        ("CLEVR_train_scenes.json", [{"image_filename": "a.png", "objects": []}, {"image_filename": "b.png", "objects": [cube]}, {"image_filename": ""}, {}]),
        ("CLEVR_val_scenes.json", [{"image_filename": "a.png", "objects": [cube, cube]}]),
    ):
        (tmp_path / "scenes" / name).write_text(json.dumps({"scenes": scenes}, indent=1))
    rows = {r["image_filename"]: len(r["objects"]) for r in readers.read_scenes(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.png": 2, "b.png": 1}
    (tmp_path / "scenes.json").write_text(json.dumps({"scenes": [{"image_filename": "only.png", "objects": []}]}))
    assert [r["image_filename"] for r in readers.read_scenes(spark, f"file://{tmp_path}").collect()] == ["only.png"]
    with pytest.raises(FileNotFoundError):
        readers.read_scenes(spark, f"file://{tmp_path}/none")


def test_scene_traces_by_hand(spark):
    one = ("small", "red", None, "cube", None)
    rows = spark.createDataFrame([("x_train.png", [one, one]), ("empty.png", []), ("y.png", None)], SCENE)
    exist = generate.scene_traces(rows, "exist", "/i").collect()
    assert [(r["image_path"], r["question"], r["answer"]) for r in exist] == [("/i/train/x_train.png", "Is there a red cube?", "yes")]
    assert json.loads(exist[0]["steps"][1]["grounding_ref"]) == {"type": "existence_check", "result": True}
    assert generate.scene_traces(rows, "relation").count() == 0  # both objects are alike
    bare = spark.createDataFrame([("z.png", [(None, None, None, None, [1.0])])], SCENE)
    assert generate.scene_traces(bare, "count").count() == 0
    gone = generate.scene_traces(bare, "exist").first()
    assert (gone["answer"], gone["steps"][1]["evidence_value"]) == ("no", "False")
    two = spark.createDataFrame([("t.png", [("s", 'a"b', "m", "cube", [9.0, 1.0]), ("s", None, "m", None, [2.0, 1.0])])], SCENE)
    seen = generate.scene_traces(two, "relation").first()
    refs = [json.loads(s["grounding_ref"]) for s in seen["steps"]]
    assert {r["pixel_coords"][0] for r in refs[:2]} == {9.0, 2.0} and seen["answer"] == ("right of" if refs[0]["pixel_coords"][0] == 9 else "left of")
    assert "None None" in [s["evidence_value"] for s in seen["steps"][:2]]


def test_questions_and_their_images(spark, tmp_path):
    rows = [{"question_id": 1, "image_id": "p", "question": "q", "answers": ["a", "b", "a"]}, {"question_id": 2, "question": "r", "answers": []}]
    (tmp_path / "t.json").write_text(json.dumps({"data": rows}))
    photos = readers.read_photo_questions(spark, f"file://{tmp_path}/t.json")
    assert sorted(tuple(r) for r in readers.questions_of_images(photos).collect()) == [("", 1, "2"), ("p", 1, "1")]
    assert [(r["answer"], r["image_path"]) for r in generate.reading_traces(photos, "textvqa", "/i").collect()] == [("a", "/i/p.jpg")]
    docs = spark.sql("SELECT 5L AS questionId, 'd' AS docId, 'why' AS question, CAST(null AS ARRAY<STRING>) AS answers, 'x' AS answer, binary('img') AS image")
    docs.write.parquet(f"file://{tmp_path}/p")
    for k, part in enumerate((tmp_path / "p").glob("*.parquet")):
        part.rename(tmp_path / f"validation-{k}.parquet")
    read = readers.read_document_questions(spark, f"file://{tmp_path}")
    assert tuple(read.first()) == ("5", "d_5.png", "why", ["x"])
    assert "image:" not in read._jdf.queryExecution().toString().split("ReadSchema")[-1]


def test_manifest_and_traces_round_trip(spark, tmp_path):
    spans = F.expr("array(struct('1' AS span_id, 'T' AS text, 't' AS normalized_text, array(0.0D) AS bbox, 1 AS page, array('T') AS tokens))")
    flat = spark.sql("SELECT 'e' AS example_id, 'docvqa' AS benchmark, '/i' AS image_path, 'q' AS question, 'a' AS answer, 'dev' AS split, 3 AS pos").withColumn("spans", spans)
    readers.write_manifest(flat, f"file://{tmp_path}/m")
    row = readers.read_manifest(spark, f"file://{tmp_path}/m").first()
    assert (row["metadata"]["split"], row["metadata"]["ocr_spans"][0]["text"], row["metadata"]["objects"]) == ("dev", "T", None)
    readers.write_manifest(readers.read_manifest(spark, f"file://{tmp_path}/m"), f"file://{tmp_path}/m2")
    assert readers.read_manifest(spark, f"file://{tmp_path}/m2").first() == row
    made = generate.stand_in_traces(flat, 2).withColumn("scene", F.lit("gone")).withColumn("trace_mode", F.lit("free"))
    kept = generate.for_training(made)
    assert kept.columns == [f.name for f in spark.createDataFrame([], TRACE).schema] and kept.first()["trace_mode"] == "canonical"
    readers.write_traces(kept, f"file://{tmp_path}/t")
    assert readers.read_traces(spark, f"file://{tmp_path}/t").collect() == kept.collect()
    pair = generate.same_answer_pairs(kept).first()
    assert (pair["t_star"], pair["negative_steps"][1]["error_type"], pair["negative_steps"][1]["evidence_value"]) == (2, "wrong_intermediate_evidence", "wrong_value_1")
    assert pair["negative_steps"][0] == pair["positive_steps"][0]
    with pytest.raises(ValueError):
        readers.write_pairwise_dataset(kept, f"file://{tmp_path}/no")


def test_manifests_of_splits(spark):
    good = spark.createDataFrame([("b", 1), ("a", 0)], "example_id string, pos int")
    none, bad = spark.createDataFrame([], "example_id string, problem string"), spark.createDataFrame([("x", "missing_answer")], "example_id string, problem string")
    out = adapters.build_manifests({"train": (good, none), "val": (good, bad)}, {"train": 1})
    assert [r["example_id"] for r in out["train"].collect()] == ["a"] and out["val"].count() == 0
    with pytest.raises(ValueError):
        adapters.build_manifests({"train": (good, bad)})


def test_empty_tables(spark):
    scenes = spark.createDataFrame([], SCENE)
    assert all(generate.scene_traces(scenes, k).count() == 0 for k in generate.SCENE_KINDS)
    keys = spark.createDataFrame([], "k long")
    assert generate.split_by_share(keys, "k").count() == 0 and generate.with_seed(keys, "k").count() == 0
    gate = summary.training_gate(spark.createDataFrame([], "benchmark string, status string, include_in_training boolean, verified string, corrupted string"))
    assert tuple(gate.first()) == ("skipped", [], [])
    assert requests.outputs_with_defaults(spark.createDataFrame([], requests.OUTPUT)).count() == 0


def test_summary_without_families_or_steps(spark):
    main = spark.sql("SELECT 0.5D AS challenger, 0.4D AS challenger_low, 0.6D AS challenger_high, 0.5D AS baseline, 0.4D AS baseline_low, 0.6D AS baseline_high")
    out = summary.summary(main, spark.createDataFrame([], "family string, auroc double"), spark.createDataFrame([], "accuracy double"))
    row = out.first()
    assert (row["decision"], row["significant"]) == ("NO-GO", False)
    assert row["conclusion"] == "contrastive (AUROC=0.5000) does not show significant improvement over pointwise baseline (AUROC=0.5000), with delta=0.0000."
    assert [tuple(r) for r in summary.results_table(out).collect()] == [("pointwise", 0.5, 0.4, 0.6), ("contrastive", 0.5, 0.4, 0.6)]
