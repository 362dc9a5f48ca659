"""JSON files cut anywhere against Python's own reader."""

import json
import random

import pytest

from tracemill.sources import splitting


def odd_value(pick, deep=3):
    texts = ["", "a", "}", "{", "]", "[", ",", '"', "\\", '\\"', "},{", '"scenes": [', "é中😀", "\n", "x" * pick.randint(0, 60)]
    kind = pick.random()
    if deep and kind < 0.35:
        return {pick.choice(texts) + str(i): odd_value(pick, deep - 1) for i in range(pick.randint(0, 3))}
    if deep and kind < 0.6:
        return [odd_value(pick, deep - 1) for _ in range(pick.randint(0, 3))]
    return pick.choice([None, True, -1.5, 7, pick.choice(texts), pick.choice(texts) + pick.choice(texts)])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("field", [None, "scenes"])
@pytest.mark.parametrize("keyed", [False, True])
def test_elements_of_files_cut_anywhere(small_splits, tmp_path, seed, field, keyed):
    pick = random.Random(seed)
    want = []
    for f in range(3):
        values = [odd_value(pick) for _ in range(pick.choice([0, 1, 40]))]
        body = {f"k{i}": v for i, v in enumerate(values)} if keyed else values
        if field:
            body = {"info": {"scenes": [1, {"scenes": [2]}], "note": '"scenes": ['}, "empty": [], "scenes": body, "after": [odd_value(pick), [3, 4], {"scenes": [5]}]}
        (tmp_path / f"f{f}.json").write_text(json.dumps(body, indent=pick.choice([None, 1]), ensure_ascii=pick.random() < 0.5))
        want += [(f, i, f"k{i}" if keyed else None, v) for i, v in enumerate(values)]
    rows = splitting.read_records(small_splits, f"file://{tmp_path}", field, keyed).drop("payload", "record")
    assert rows.rdd.getNumPartitions() >= 3
    got = [(int(r["path"][-6]), r["pos"], r["key"], r["raw"]) for r in rows.collect()]
    if keyed:  # map<string,string> gives strings as they are, the rest as JSON
        want = [(*w[:3], w[3] if isinstance(w[3], str) else w[3] if w[3] is None else json.dumps(w[3], separators=(",", ":"), ensure_ascii=False)) for w in want]
        assert sorted((g[:3] for g in got)) == sorted((w[:3] for w in want))
    else:
        assert sorted((*g[:3], json.dumps(json.loads(g[3]))) for g in got) == sorted((*w[:3], json.dumps(w[3])) for w in want) if got else not want


def test_other_files(small_splits, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"x": 1}, "scenes": 5}')
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "c.json").write_text("")
    assert splitting.read_elements(small_splits, f"file://{tmp_path}", "scenes").count() == 0
    assert [r["raw"] for r in splitting.read_elements(small_splits, f"file://{tmp_path}", "data").collect()] == ['"x": 1']


def test_large_file_is_read_by_several_tasks(spark, tmp_path):
    scenes = [{"image_filename": f"i{i}.png", "objects": [{"shape": "cube", "xy": [i, j]} for j in range(5)]} for i in range(20_000)]
    (tmp_path / "scenes.json").write_text(json.dumps({"info": {}, "scenes": scenes}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        rows = splitting.read_elements(spark, f"file://{tmp_path}/scenes.json", "scenes")
        assert rows.rdd.getNumPartitions() >= 6
        assert [json.loads(r["raw"]) for r in rows.orderBy("pos").collect()] == scenes
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered(small_splits, tmp_path):
    want = set()
    for f in range(3):
        lines = [f"{f}-{i}" if i % 5 else "" for i in range(100)]
        (tmp_path / f"l{f}.jsonl").write_text("\n".join(lines) + "\n")
        want |= {(f, i + 1, v) for i, v in enumerate(lines)}
    got = splitting.read_lines(small_splits, f"file://{tmp_path}")
    assert {(int(r["path"][-7]), r["line"], r["value"]) for r in got.collect()} == want
