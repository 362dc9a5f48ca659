"""Stages run once, again after a change, and leave nothing half done."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import __main__ as cli
from tracemill.flow import flow, unanswered
from tracemill.runner import Runner, Stage


def write(path, rows):
    path.mkdir(exist_ok=True)
    (path / "rows.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    return f"file://{path}"


def steps(ref):
    return json.dumps({"steps": [{"step_id": 1, "step_text": "The part is above the line.", "step_type": "read", "grounding_ref": ref, "evidence_value": "inv 7"}], "predicted_answer": "INV-7"})


def data(tmp_path, n=3):
    spans = [{"span_id": "17", "text": "INV-7"}, {"span_id": "18", "text": "Total"}]
    manifest = write(tmp_path / "manifest", [{"example_id": f"e{i}", "benchmark": "docvqa", "image_path": "/i", "question": "no?", "answer": "inv-7", "spans": spans} for i in range(n)])
    said = [{"request_id": f"e{i}__docvqa_canonical_v1__seed0", "raw_text": "So it is.\nThe final answer is INV-7." if i else " "} for i in range(n - 1)]
    return manifest, write(tmp_path / "outputs", said + said[:1])


def test_flow_skips_what_is_done_and_reruns_what_follows_a_change(spark, tmp_path):
    manifest, outputs = data(tmp_path)
    make = lambda: flow(spark, f"file://{tmp_path}/root", manifest, outputs, "docvqa", "docvqa_canonical_v1")
    first = make().run()
    assert set(first.values()) == {"done"} and list(first)[:3] == ["requests", "answers", "parsed"]
    assert set(make().run().values()) == {"skipped"}
    counts = {(r["stage"], r["benchmark"]): r["n"] for r in make().counts().collect()}
    assert counts[("requests", "docvqa")] == 3 and counts[("answers", "docvqa")] == 2 and counts[("verified", "docvqa")] == 1
    assert tuple(make().gate().first()) == ("completed", ["docvqa"], [])
    assert [r["example_id"] for r in unanswered(make()).collect()] == ["e2"]
    assert make().table("pairwise").count() == counts[("corrupted", "docvqa")]
    # one more output: requests stay, the rest is made anew
    data(tmp_path, 4)
    write(tmp_path / "manifest", [json.loads(x) for x in (tmp_path / "manifest" / "rows.jsonl").read_text().splitlines()][:3])
    again = make().run()
    assert again["answers"] == again["pairwise"] == "done"
    assert make().table("verified").count() == 2


def test_a_dead_run_leaves_nothing_published(spark, tmp_path):
    source = write(tmp_path / "source", [{"benchmark": "gqa", "v": i} for i in range(5)])
    fail = []

    def second(first):
        if not fail:
            fail.append(1)
            return first.withColumn("v", F.raise_error(F.lit("killed")).cast("long"))
        return first.where("v > 2")

    stages = [Stage("first", ("source",), lambda source: spark.read.schema("benchmark string, v long").json(source)), Stage("second", ("first",), second), Stage("third", ("second",), lambda second: second, gate=lambda second: second.count() > 5)]
    make = lambda s=stages: Runner(spark, f"file://{tmp_path}/root", s, {"source": source})
    with pytest.raises(Exception, match="killed"):
        make().run()
    assert list(make().published()) == ["first"]
    assert make().run() == {"first": "skipped", "second": "done", "third": "closed"}
    assert make().table("second").count() == 2
    newer = [stages[0], Stage("second", ("first",), lambda first: first, version="2"), stages[2]]
    assert make(newer).run() == {"first": "skipped", "second": "done", "third": "closed"}
    with pytest.raises(ValueError, match="needs"):
        make([stages[1]])


def test_command_line(spark, tmp_path, capsys):
    manifest, outputs = data(tmp_path)
    given = ["--root", f"file://{tmp_path}/root", "--manifest", manifest, "--outputs", outputs, "--benchmark", "docvqa"]
    assert cli.main(["run", *given, "--only", "judged"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0] == dict.fromkeys(("requests", "answers", "parsed", "failures", "judged"), "done") and lines[1]["gate"]["status"] == "skipped"
    assert cli.main(["pending", *given, "--to", f"file://{tmp_path}/todo"]) == 0
    assert [r["request_id"] for r in spark.read.json(f"file://{tmp_path}/todo").collect()] == ["e2__docvqa_canonical_v1__seed0"]
    with pytest.raises(SystemExit):
        cli.arguments(["run"])
