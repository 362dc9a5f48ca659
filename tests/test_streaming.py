import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from pyspark.sql import functions as F

from tracemill.streaming import resume


def test_second_run_takes_new_files_only(spark, tmp_path):
    source, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    source.mkdir()
    (source / "a.jsonl").write_text(json.dumps({"request_id": "1"}) + "\nbroken\n")

    def run():
        resume.append_outputs(resume.stream_jsonl(spark, f"file://{source}", "request_id string"), out, state).awaitTermination()
        return sorted(r["request_id"] for r in spark.read.parquet(out).collect())

    assert run() == ["1"]
    (source / "b.jsonl").write_text(json.dumps({"request_id": "2"}) + "\n")
    assert run() == ["1", "2"]


def test_resume(spark):
    requests = spark.createDataFrame([("1",), ("2",)], "request_id string")
    assert [r[0] for r in resume.resume(requests, requests.where("request_id = '1'")).collect()] == ["2"]
    assert resume.resume(requests, None) is requests


def test_window_counts(spark, tmp_path):
    rows = spark.range(4).select((F.col("id") % 2).cast("string").alias("kind"), F.timestamp_seconds(F.col("id") * 40).alias("ts"))
    rows.write.parquet(f"file://{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/rows")
    counted = resume.counts_by_window(stream, "ts", "1 minute", ["kind"])
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 4


def drop_file(folder, name, rows):
    """Files are taken in the order of their times, here that of their names."""
    (folder / f".{name}").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    os.utime(folder / f".{name}", (1_700_000_000 + int(name),) * 2)
    (folder / f".{name}").rename(folder / f"{name}.jsonl")


def one_by_one(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def at(minute):
    return f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z"


def test_requests_meet_outputs(spark, tmp_path):
    from tracemill.streaming.answers import answered

    for d in ("asked", "said"):
        (tmp_path / d).mkdir()
    ask = lambda k, m: {"request_id": k, "asked_at": at(m)}
    say = lambda k, m, t: {"request_id": k, "said_at": at(m), "text": t}

    def run():
        requests = one_by_one(spark, tmp_path / "asked", "request_id string, asked_at timestamp")
        outputs = one_by_one(spark, tmp_path / "said", "request_id string, said_at timestamp, text string")
        both = answered(requests, outputs, within="60 minutes", delay="10 minutes")
        query = both.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query, {(r["request_id"], r["answered"], r["text"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    drop_file(tmp_path / "asked", "0", [ask("a", 0), ask("never", 1), ask("slow", 2)])
    drop_file(tmp_path / "said", "0", [say("a", 5, "x"), say("a", 6, "again"), say("nobody", 5, "y")])
    _, got = run()
    assert got == {("a", True, "x")}
    drop_file(tmp_path / "asked", "1", [ask("b", 50), ask("c", 100)])
    drop_file(tmp_path / "said", "1", [say("a", 20, "repeated"), say("slow", 62, "in time"), say("b", 111, "too late"), say("c", 99, "before")])
    assert run()[1] == {("a", True, "x"), ("slow", True, "in time"), ("never", False, None)}  # its hour has passed on both streams
    # time goes on: who was not answered comes out alone, and the state with it
    for k, m in ((2, 300), (3, 301), (4, 600), (5, 601)):
        drop_file(tmp_path / "asked", str(k), [ask(f"t{m}", m)])
        drop_file(tmp_path / "said", str(k), [say(f"u{m}", m, "")])
    query, got = run()
    assert got >= {("a", True, "x"), ("slow", True, "in time"), ("never", False, None), ("b", False, None), ("c", False, None)}
    assert sum(r[0] in "abc" for r in got) == 3 and not any(r[0] in ("nobody", "u300") for r in got)
    held = [s.numRowsTotal for s in query.lastProgress.stateOperators]
    assert sum(held) <= 12  # those of the last hours only


OUTPUT = "request_id string, example_id string, benchmark string, image_path string, question string, answer string, trace_mode string, expects_json boolean, raw_text string"


def test_verified_rejected_and_quarantined_once_after_a_crash(spark, tmp_path, monkeypatch):
    from tracemill.operators import verify
    from tracemill.streaming import sinks

    (tmp_path / "in").mkdir()
    steps = lambda ref: json.dumps({"steps": [{"step_id": 1, "step_text": "Read it.", "step_type": "read", "grounding_ref": ref, "evidence_value": "inv 7"}], "predicted_answer": "INV-7"})
    said = lambda k, e, text: dict(request_id=k, example_id=e, benchmark="docvqa", image_path="/i", question="q", answer="INV-7", trace_mode="canonical", expects_json=True, raw_text=text)
    drop_file(tmp_path / "in", "0", [said("good", "e", steps("ocr_span:17")), said("bad", "e", "```json\n" + steps("ocr_span:99") + "\n```"), "{broken", said("empty", "e", " ")])
    drop_file(tmp_path / "in", "1", [said("good2", "e", steps("ocr_span:17")), said("lost", "nobody", steps("ocr_span:17")), said("text", "e", "So it is INV-7.\nThe final answer is INV-7.")])
    manifest = spark.createDataFrame([("e", "docvqa", "inv-7", [("17", "INV-7", "")])], "example_id string, benchmark string, answer string, spans array<struct<span_id string, text string, normalized_text string>>")
    root, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def run():
        stream = spark.readStream.schema(OUTPUT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        sinks.judge_stream(stream, manifest, lambda s: verify.span_issues(s, F.col("spans")), root, state).awaitTermination()

    write, died = sinks.write_batch, []

    def dies(tables, path, batch_id):
        """The second batch dies after its first table, and again before it commits."""
        if batch_id == 1 and len(died) < 2:
            died.append(batch_id)
            for name in sinks.TABLES[: 1 if len(died) == 1 else 3]:
                tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
            raise RuntimeError("killed")
        write(tables, path, batch_id)

    monkeypatch.setattr(sinks, "write_batch", dies)
    read = lambda name: sorted(r[0] or "" for r in sinks.read_table(spark, root, name).select("trace_id" if name != "quarantined" else "request_id").collect())
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
        assert read("verified") == ["good"]  # nothing of the batch that died is seen
    run()
    assert (read("verified"), read("rejected"), read("quarantined")) == (["good", "good2", "text"], ["bad"], ["", "empty", "lost"])
    reasons = {r["reason"] for r in sinks.read_table(spark, root, "quarantined").collect()}
    assert reasons == {"broken_line", "empty_text", "unknown_example"}
    run()
    assert read("verified") == ["good", "good2", "text"]


@pytest.fixture
def rocks(spark):
    from tracemill.streaming.retention import STATE_STORE

    spark.conf.set(*STATE_STORE)
    yield spark
    spark.conf.unset(STATE_STORE[0])


def run_to(query_name, frame, tmp_path):
    query = frame.writeStream.format("parquet").option("path", f"file://{tmp_path}/{query_name}").option("checkpointLocation", f"file://{tmp_path}/{query_name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.read.parquet(f"file://{tmp_path}/{query_name}").collect()


def test_newest_of_each_key_across_restarts(rocks, tmp_path):
    from tracemill.streaming.retention import newest_of_each

    (tmp_path / "in").mkdir()
    row = lambda model, step, m: {"model": model, "step": step, "path": f"{model}-{step}", "ts": at(m)}

    def run():
        stream = one_by_one(rocks, tmp_path / "in", "model string, step long, path string, ts timestamp")
        kept = newest_of_each(stream, "model", "step", "path", "ts", keep=2, idle="100 minutes", delay="1 minute")
        return sorted((r["item"], r["state"]) for r in run_to("newest", kept, tmp_path))

    drop_file(tmp_path / "in", "0", [row("a", 10, 0), row("a", 9, 0), row("a", 100, 1), row("b", 5, 1)])
    assert run() == [("a-9", "evicted")]
    drop_file(tmp_path / "in", "1", [row("a", 11, 30), row("a", 100, 30), row("b", 4, 30)])
    assert run() == [("a-10", "evicted"), ("a-9", "evicted")]
    drop_file(tmp_path / "in", "2", [row("c", 1, 500)])
    drop_file(tmp_path / "in", "3", [row("c", 2, 501)])
    want = [("a-10", "evicted"), ("a-100", "kept"), ("a-11", "kept"), ("a-9", "evicted"), ("b-4", "kept"), ("b-5", "kept")]
    assert run() == want
    drop_file(tmp_path / "in", "4", [row("a", 1, 502), row("a", 2, 502)])  # forgotten: a begins anew
    assert run() == want


def test_first_of_each_key_across_restarts(rocks, tmp_path):
    import time

    from tracemill.streaming.retention import first_of_each

    (tmp_path / "in").mkdir()

    def run(until):
        frame = first_of_each(one_by_one(rocks, tmp_path / "in", "k string, n long, v string"), "k", "n", 8_000)
        query = frame.writeStream.format("parquet").option("path", f"file://{tmp_path}/first").option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="1 second").start()
        try:
            for _ in range(100):
                time.sleep(0.5)
                if (tmp_path / "first" / "_spark_metadata").exists():
                    got = {(r["k"], r["v"]) for r in rocks.read.schema("k string, n long, v string").parquet(f"file://{tmp_path}/first").collect()}
                    if until in got:
                        return got
            raise AssertionError(got)
        finally:
            query.stop()

    drop_file(tmp_path / "in", "0", [{"k": "a", "n": 2, "v": "second"}, {"k": "a", "n": 1, "v": "first"}, {"k": "b", "n": 1, "v": None}])
    assert run(("b", None)) == {("a", "first"), ("b", None)}
    drop_file(tmp_path / "in", "1", [{"k": "a", "n": 0, "v": "late"}, {"k": "c", "n": 3, "v": "x"}])
    assert ("c", "x") in run(("c", "x"))
    time.sleep(9)
    drop_file(tmp_path / "in", "2", [{"k": "b", "n": 9, "v": "after its time"}])
    run(("b", "after its time"))
