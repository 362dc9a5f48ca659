import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import adapters, readers


def files(spark, tmp_path, payload, name="train.json"):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return readers.read_json(spark, f"file://{path}")


def test_docvqa(spark, tmp_path):
    ocr = {"data": [{"image": "d1.png", "ocr_spans": [{"span_id": "17", "text": "INV-7", "bbox": [0, 0, 5, 2]}], "words": [{"text": "Total"}, {"text": " "}, {"text": "12"}]}]}
    lookup = adapters.ocr_lookup(files(spark, tmp_path, ocr, "ocr.json"))
    questions = {"split": "dev", "data": [{"questionId": 7, "image": "d1.png", "question": "Invoice no?", "answers": [" INV-7 ", "INV7"]}, {"image": "d2.png", "question": "x", "answers": []}]}
    good, bad = adapters.docvqa_manifest(files(spark, tmp_path, questions), lookup, "/img")
    row = good.first()
    assert (row["example_id"], row["answer"], row["image_path"]) == ("docvqa_dev_7", "INV-7", "/img/d1.png")
    assert [s["span_id"] for s in row["spans"]] == ["17", "ocr_word:0", "ocr_word:2"]
    assert bad.first()["problem"] == "missing_answer"
    with pytest.raises(ValueError):
        adapters.strict(good, bad)


def test_page_words_lose_to_lines(spark, tmp_path):
    ocr = [{"id": "q", "recognitionResults": [{"lines": [{"text": "a line"}], "words": [{"text": "lost"}, {"text": "kept"}]}]}]
    row = adapters.ocr_lookup(files(spark, tmp_path, ocr)).first()
    assert [(s["span_id"], s["text"]) for s in row["spans"]] == [("ocr_page0:0", "a line"), ("ocr_page0:1", "kept")]


def test_gqa(spark, tmp_path):
    scene = {"2407": {"width": 640, "objects": {
        "9": {"name": "cup", "attributes": ["red", "small"], "x": 1, "y": 2, "w": 0, "width": 3, "h": 4, "relations": [{"name": "on", "object": "2"}, {"name": "x"}]},
        "2": {"name": "table", "attributes": "old", "relations": []}}}}
    scenes = adapters.scene_lookup(files(spark, tmp_path, scene, "scenes.json"))
    questions = {"q1": {"imageId": "2407", "question": "What?", "answer": "", "fullAnswer": "a cup"}, "q0": {"imageId": "1", "question": "Why?", "answer": "b"}}
    good, _ = adapters.gqa_manifest(files(spark, tmp_path, questions), scenes, "/img")
    rows = {r["question_id"]: r for r in good.collect()}
    objects = rows["q1"]["objects"]
    assert rows["q1"]["answer"] == "a cup" and rows["q1"]["image_path"] == "/img/2407.jpg" and rows["q1"]["example_id"] == "gqa_train_q1"
    assert [o["object_id"] for o in objects] == ["9", "2"] and objects[0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert objects[0]["relations"][0].asDict() == {"name": "on", "target_object_id": "2"} and len(objects[0]["relations"]) == 1
    assert objects[1]["attributes"] == ["old"] and rows["q0"]["objects"] is None


def test_web(spark, tmp_path):
    payload = {"nav": [{"id": "1", "image": "s.png", "task_type": "click", "website": "x.org", "answer": "go", "elements": [{"id": "a", "text": "Go", "bbox": [1, 2, "z"]}, "Stop"]}],
               "ocr": [{"id": "2", "image": "t.png", "question": "?", "target": "t", "elem_desc": "a box"}, {"id": "3", "image": "u.png", "question": "?", "answer": "t"}]}
    good, _ = adapters.web_manifest(files(spark, tmp_path, payload))
    rows = {r["source_id"]: r for r in good.collect()}
    assert rows["1"]["question"] == "click on x.org" and rows["1"]["group"] == "nav"
    assert [(e["element_id"], e["text"]) for e in rows["1"]["elements"]] == [("a", "Go"), ("elements_1", "Stop")] and rows["1"]["elements"][0]["bbox"] == []
    assert rows["2"]["elements"][0]["element_id"] == "target" and rows["3"]["verification_mode"] == "weak_answer"


def test_jsonl_round_trip_and_quarantine(spark, tmp_path):
    out = f"file://{tmp_path}/rows"
    readers.write_jsonl(spark.createDataFrame([("a", None), ("b", "é")], "k string, v string"), out)
    assert {tuple(r) for r in readers.read_jsonl(spark, out, "k string, v string").collect()} == {("a", None), ("b", "é")}
    (tmp_path / "bad.jsonl").write_text('{"k": "a"}\n\n[1]\n{oops\n')
    bad = f"file://{tmp_path}/bad.jsonl"
    assert sorted((r["line"], r["raw"]) for r in readers.quarantine(spark, bad).collect()) == [(3, "[1]"), (4, "{oops")]
    assert readers.read_jsonl(spark, bad, "k string", strict=False).where("k = 'a'").count() == 1


def test_training_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("step=20 loss=0.81 eval_loss=0.77 learning_rate=1e-4\nnothing\neval_loss=0.5\n")
    rows = readers.read_training_log(spark, f"file://{tmp_path}/log.txt").collect()
    assert tuple(rows[0]) == (20, 0.81, 0.77, 0.0001) and (rows[1]["loss"], rows[1]["eval_loss"]) == (0.5, 0.5)


def test_question_shards(spark, tmp_path):
    path = f"file://{tmp_path}/q.parquet"
    spark.createDataFrame([(1, "q", "d", [" a ", "", None], b"x")], "questionId int, question string, docId string, answers array<string>, image binary").write.parquet(path)
    assert readers.read_question_shards(spark, path).first()["answers"] == ["a"]


def test_question_shards_of_a_folder(spark, tmp_path):
    for name, q in (("train-0", "t"), ("val-0", "v")):
        row = spark.createDataFrame([(1, q, "d", ["a"])], "questionId int, question string, docId string, answers array<string>")
        row.write.parquet(f"file://{tmp_path}/{name}.parquet")
    both = f"file://{tmp_path}"
    assert [r["question"] for r in readers.read_question_shards(spark, both).collect()] == ["t"]
    (tmp_path / "train-0.parquet").rename(tmp_path / "test-0.parquet")
    assert sorted(r["question"] for r in readers.read_question_shards(spark, both).collect()) == ["t", "v"]


def test_ascii_lines(spark, tmp_path):
    rows = [("plain \\ \"q\"", None), ("é中\u2028😀\n\x7f", "x")]
    out = f"file://{tmp_path}/rows"
    readers.write_jsonl(spark.createDataFrame(rows, "k string, v string"), out, ascii=True)
    lines = [line for f in (tmp_path / "rows").glob("part-*") for line in f.read_bytes().decode("ascii").splitlines()]
    assert sorted((json.loads(x)["k"], json.loads(x)["v"]) for x in lines) == sorted(rows)


def test_first_rows_of_numbered_lines(spark, tmp_path):
    from tracemill.operators import traces

    rows = [{"example_id": f"e{9 - i}", "benchmark": "docvqa", "question": "q", "image_path": "/i"} for i in range(9)]
    (tmp_path / "m.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    numbered = readers.read_numbered_jsonl(spark, f"file://{tmp_path}/m.jsonl", "example_id string, benchmark string, question string, image_path string")
    asked = traces.build_requests(numbered, "docvqa_canonical_v1", limit=2, order=["path", "line"])
    assert sorted((r["line"], r["example_id"]) for r in asked.collect()) == [(1, "e9"), (3, "e8")]


def test_manifests_of_split_files_equal_those_of_whole_files(spark, tmp_path):
    from tracemill.sources import splitting

    questions = {"data": [{"questionId": i, "image": f"d{i}.png", "question": "no?", "answers": ["x"] if i % 9 else []} for i in range(300)]}
    scenes = {"1": {"width": 1, "objects": {"9": {"name": "cup", "x": 1, "y": 2, "w": 3, "h": 4}}}, "2": {"width": 2, "objects": {}}}
    whole, scene_files = files(spark, tmp_path, questions), files(spark, tmp_path, scenes, "scenes.json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = splitting.read_records(spark, f"file://{tmp_path}/train.json", "data")
        assert split.rdd.getNumPartitions() > 5
        keyed = splitting.read_records(spark, f"file://{tmp_path}/scenes.json", keyed=True)
        nothing = adapters.ocr_lookup(files(spark, tmp_path, [], "ocr.json"))
        for a, b in zip(adapters.docvqa_manifest(whole, nothing, "/img"), adapters.docvqa_manifest(split, nothing, "/img")):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        a, b = (adapters.scene_lookup(x) for x in (scene_files, keyed))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["q_docvqa_manifest", "q_gqa_manifest", "q_web_manifest"])
def test_manifest_queries_read_their_files_once(spark, name):
    """Accepted and rejected rows come from one pass; no filter on the exploded records evaluates the file's JSON once more."""
    from tracemill.plans.catalogue import QUERIES
    from tracemill.plans import manifests  # noqa: F401

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") and sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) == 1
    assert not any("Filter" in line and "from_json" in line for line in plan.splitlines())


def test_filled_evaluates_its_text_once(spark):
    from tracemill.functions import text as T

    df = spark.createDataFrame([(" a ",), (" \t",), (None,)], "t string").select(T.filled(F.col("t")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["a", None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
