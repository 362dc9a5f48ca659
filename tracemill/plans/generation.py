"""Queries of the generators, requests, gates and summaries, each beside its DuckDB twin; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import generate, requests, summary
from tracemill.operators.traces import parse_outputs
from tracemill.plans import catalogue, frames
from tracemill.plans.catalogue import d_draw, query
from tracemill.plans.frames import STEPS_SQL, table

# --- scenes: an order is an image, its lines are the objects ---
_OBJECT = {
    "size": "CASE WHEN l_quantity % 2 = 0 THEN 'small' ELSE 'large' END",
    "color": "CASE l_linenumber % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' END",
    "material": "CASE WHEN l_tax > 0.04 THEN 'metal' ELSE 'rubber' END",
    "shape": "CASE WHEN l_discount > 0.07 THEN NULL WHEN l_discount > 0.03 THEN 'cube' ELSE 'sphere' END",
}
_IMAGE = "'CLEVR_' || CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'Test' ELSE 'new' END || '_' || l_orderkey || '.png'"


def _scenes(spark, sf_dir) -> DataFrame:
    coords = "CASE WHEN l_quantity % 10 <> 0 THEN array(l_quantity, cast(l_linenumber AS double)) END AS pixel_coords"
    one = F.struct(*(F.expr(sql).alias(a) for a, sql in _OBJECT.items()), F.expr(coords).alias("pixel_coords"))
    rows = frames.steps(spark, sf_dir).withColumn("o", one)
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("step_id", "o"))).alias("rows"))
    return grouped.select(F.expr(_IMAGE).alias("image_filename"), F.transform("rows", lambda r: r["o"]).alias("objects"))


def _digest(rows: DataFrame) -> DataFrame:
    """Steps as one digest: a line of five fields for each."""
    line = lambda s: F.concat_ws("|", s["step_id"].cast("string"), s["step_type"], s["step_text"], s["grounding_ref"], s["evidence_value"])
    return rows.withColumn("steps", F.md5(F.array_join(F.transform("steps", line), "\n")))


def _d_digest(*steps: tuple[str, str, str, str]) -> str:
    lines = [f"concat_ws('|', '{k}', '{kind}', {text}, {ref}, {value})" for k, (kind, text, ref, value) in enumerate(steps, 1)]
    return f"md5(concat_ws(chr(10), {', '.join(lines)}))"


_D_SCENES = f"""steps AS ({STEPS_SQL}), scenes AS (SELECT image, list({{{', '.join(f"'{a}': {a}" for a in _OBJECT)}, 'xs': xs, 'ys': ys}} ORDER BY step_id) AS objs
    FROM (SELECT {_IMAGE} AS image, step_id, {', '.join(f'{sql} AS {a}' for a, sql in _OBJECT.items())},
        CASE WHEN l_quantity % 10 <> 0 THEN l_quantity END AS xs, CASE WHEN l_quantity % 10 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS ys FROM steps) GROUP BY image)"""
_D_PATH = "'images/' || CASE WHEN contains(image, 'train') THEN 'train' WHEN contains(image, 'Test') THEN 'test' ELSE 'val' END || '/' || image"


def _d_at(items: str, name: str) -> str:
    return f"{items}[CAST({d_draw('42', chr(39) + name + chr(39), 'image')} % len({items}) AS BIGINT) + 1]"


def _d_scene_traces(kind: str, middle: str, question: str, answer: str, *steps) -> str:
    return f"""WITH {_D_SCENES}, {middle} SELECT image AS image_filename, '{kind}' AS question_type, {_D_PATH} AS image_path, {question} AS question, {answer} AS answer, {_d_digest(*steps)} AS steps FROM t"""


def _scene_query(spark, sf_dir, kind: str) -> DataFrame:
    return _digest(generate.scene_traces(_scenes(spark, sf_dir), kind))


@query(
    _d_scene_traces(
        "count",
        f"""a AS (SELECT *, {_d_at("['size', 'color', 'material', 'shape']", 'attribute')} AS a FROM scenes),
        b AS (SELECT *, list_transform(objs, lambda o: CASE a WHEN 'size' THEN o.size WHEN 'color' THEN o.color WHEN 'material' THEN o.material ELSE o.shape END) AS every FROM a),
        c AS (SELECT *, list_sort(list_distinct(list_filter(every, lambda e: e IS NOT NULL))) AS known FROM b),
        d AS (SELECT *, {_d_at('known', 'value')} AS v FROM c WHERE len(known) > 0),
        t AS (SELECT *, len(list_filter(every, lambda e: e = v)) AS n FROM d)""",
        "'How many objects are ' || v || '?'", "CAST(n AS VARCHAR)",
        ("locate", "'Locate all objects in the scene'", "'{\"type\": \"all_objects\", \"count\": ' || len(objs) || '}'", "len(objs) || ' objects'"),
        ("read", "'Filter objects by ' || a || '=' || v", "'{\"type\": \"attribute_filter\", \"attr\": \"' || a || '\", \"value\": \"' || v || '\"}'", "v"),
        ("compute", "'Count the filtered objects'", "'{\"type\": \"count\", \"result\": ' || n || '}'", "CAST(n AS VARCHAR)"),
        ("answer", "'The answer is ' || n", "'{\"type\": \"final_answer\", \"value\": ' || n || '}'", "CAST(n AS VARCHAR)"),
    )
)
def q_scene_count_traces(spark, sf_dir):
    return _scene_query(spark, sf_dir, "count")


@query(
    _d_scene_traces(
        "exist",
        f"""a AS (SELECT *, {_d_at('objs', 'target')} AS o FROM scenes),
        b AS (SELECT *, coalesce(o.color, 'red') AS c, coalesce(o.shape, 'cube') AS s FROM a),
        t AS (SELECT *, len(list_filter(objs, lambda p: p.color = c AND p.shape = s)) > 0 AS found, c || ' ' || s AS thing FROM b)""",
        "'Is there a ' || thing || '?'", "CASE WHEN found THEN 'yes' ELSE 'no' END",
        ("locate", "'Search for a ' || thing || ' in the scene'", "'{\"type\": \"object_search\", \"shape\": \"' || s || '\", \"color\": \"' || c || '\"}'", "thing"),
        ("read", "CASE WHEN found THEN 'Found a ' ELSE 'Did not find a ' END || thing", "'{\"type\": \"existence_check\", \"result\": ' || found || '}'", "CASE WHEN found THEN 'True' ELSE 'False' END"),
        ("answer", "CASE WHEN found THEN 'The answer is yes' ELSE 'The answer is no' END", "'{\"type\": \"final_answer\", \"value\": ' || found || '}'", "CASE WHEN found THEN 'yes' ELSE 'no' END"),
    )
)
def q_scene_exist_traces(spark, sf_dir):
    return _scene_query(spark, sf_dir, "exist")


def _d_object_ref(k: int, o: str) -> str:
    named = [f"'\"{a}\": \"' || {o}.{a} || '\"'" for a in _OBJECT]
    place = f"'\"pixel_coords\": [' || {o}.xs || ', ' || {o}.ys || ']'"
    return f"'{{' || concat_ws(', ', '\"type\": \"object\"', '\"id\": {k}', {', '.join(named)}, {place}) || '}}'"


@query(
    _d_scene_traces(
        "relation",
        f"""a AS (SELECT *, {_d_at('objs', 'first')} AS p FROM scenes), b AS (SELECT *, list_filter(objs, lambda o: o IS DISTINCT FROM p) AS others FROM a),
        c AS (SELECT *, {_d_at('others', 'second')} AS q FROM b WHERE len(others) > 0),
        t AS (SELECT *, CASE WHEN coalesce(p.xs, 50) < coalesce(q.xs, 50) THEN 'left of' ELSE 'right of' END AS r,
            coalesce(p.color, 'red') || ' ' || coalesce(p.shape, 'cube') AS pn, coalesce(q.color, 'blue') || ' ' || coalesce(q.shape, 'sphere') AS qn FROM c)""",
        "'What is the spatial relation between the ' || pn || ' and the ' || qn || '?'", "r",
        ("locate", "'Locate the ' || pn", _d_object_ref(0, "p"), "coalesce(p.color, 'None') || ' ' || coalesce(p.shape, 'None')"),
        ("locate", "'Locate the ' || qn", _d_object_ref(1, "q"), "coalesce(q.color, 'None') || ' ' || coalesce(q.shape, 'None')"),
        ("relate", "'Determine spatial relation: object 1 is ' || r || ' object 2'", "'{\"type\": \"spatial_relation\", \"relation\": \"' || r || '\"}'", "r"),
        ("answer", "'The answer is ' || r", "'{\"type\": \"final_answer\", \"value\": \"' || r || '\"}'", "r"),
    )
)
def q_scene_relation_traces(spark, sf_dir):
    return _scene_query(spark, sf_dir, "relation")


# --- questions with answers: an order asks about itself ---
_QUESTION = "'What \"state\" is order ' || o_orderkey || ' of customer ' || o_custkey || ' in, if any?'"


def _reading(kind: str, path: str, region: str, seen: str, locate: str, read: str, extract: str):
    sql = f"""WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS question_id, 'i' || o_custkey AS image_id, {_QUESTION} AS question,
        CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN greatest(o_orderstatus, o_orderpriority) WHEN 2 THEN {"''" if kind == "textvqa" else "NULL"} END AS answer FROM orders)
    SELECT question_id, image_id, {path} AS image_path, question, answer, {_d_digest(
        ("locate", f"'{locate}'", f"'{{\"type\": \"{region}\", \"image_id\": \"' || image_id || '\"}}'", f"'{seen}'"),
        ("read", f"'{read}' || question[:50]", "'{\"type\": \"ocr_text\", \"question\": ' || CAST(to_json(question[:50]) AS VARCHAR) || '}'", "question[:50]"),
        ("extract", f"'{extract}'", "'{\"type\": \"answer_extraction\", \"answer\": \"' || answer || '\"}'", "answer"),
        ("answer", "'The answer is ' || answer", "'{\"type\": \"final_answer\", \"value\": \"' || answer || '\"}'", "answer"),
    )} AS steps FROM t WHERE answer IS NOT NULL"""

    def run(spark, sf_dir):
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        key = F.col("o_orderkey") % 4
        answers = F.when(key == 0, F.array(status, priority, priority)).when(key == 1, F.array(status, priority)).when(key == 2, F.array(F.lit("")))
        asked = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").cast("string").alias("question_id"), F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("image_id"),
            F.expr(_QUESTION).alias("question"), F.coalesce(answers, F.array().cast("array<string>")).alias("answers"),
        )
        return _digest(generate.reading_traces(asked, kind))

    run.__name__ = f"q_{kind}_traces"
    return query(sql)(run)


q_docvqa_traces = _reading(
    "docvqa", "'images/' || image_id", "document_region", "document detected",
    "Locate the document in the image", "Read the document text to answer: ", "Extract the answer from the document text",
)
q_textvqa_traces = _reading(
    "textvqa", "'images/' || image_id || '.jpg'", "text_region", "text detected",
    "Locate text regions in the image", "Read the text content: ", "Extract the answer from the text",
)


# --- stand-ins, pairs, splits, seeds ---
@query(
    """SELECT 'trace_' || k AS trace_id, '/data/b' || k % 2 || '/' || k || '.jpg' AS image_path, a AS predicted_answer, md5(string_agg(concat_ws('|', i, kind, 'Step ' || i || ' reasoning for ' || k, 'region_' || (i - 1) || '_' || k, 'value_' || (i - 1)), chr(10) ORDER BY i)) AS steps
    FROM (SELECT o_orderkey AS k, o_orderstatus AS a FROM orders), (VALUES (1, 'locate'), (2, 'read'), (3, 'relate'), (4, 'compute'), (5, 'answer'), (6, 'answer')) s(i, kind) GROUP BY k, a"""
)
def q_stand_in_traces(spark, sf_dir):
    examples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("example_id"), F.expr("'b' || o_orderkey % 2").alias("benchmark"), F.col("o_orderstatus").alias("answer"))
    return _digest(generate.stand_in_traces(examples, 6)).select("trace_id", "image_path", "predicted_answer", "steps")


@query(
    f"""WITH steps AS ({STEPS_SQL}) SELECT 't' || l_orderkey AS positive_id, 't' || l_orderkey || '_f5' AS negative_id, CAST(CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS INTEGER) AS t_star,
    coalesce(max('wrong_' || grounding_ref || '/wrong_' || evidence_value) FILTER (step_id = 2), '') AS wrong FROM steps JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""
)
def q_same_answer_pairs(spark, sf_dir):
    """Traces as training keeps them, each beside its copy with wrong evidence."""
    pairs = generate.same_answer_pairs(generate.for_training(frames.traces(spark, sf_dir)))
    bad = F.get(F.filter("negative_steps", lambda s: (s["label"] == 0) & (s["error_type"] == "wrong_intermediate_evidence")), F.lit(0))
    return pairs.select("positive_id", "negative_id", "t_star", F.coalesce(F.concat(bad["grounding_ref"], F.lit("/"), bad["evidence_value"]), F.lit("")).alias("wrong"))


@query(
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5('pairs|' || o_orderkey), 1, 15) AS BIGINT)) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders"""
)
def q_pair_split(spark, sf_dir):
    return generate.split_by_share(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 41 AS seed FROM orders WHERE o_orderstatus = 'F'")
def q_row_seeds(spark, sf_dir):
    return generate.with_seed(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


@query(f"SELECT doc_id, round({d_draw(chr(39) + 'mock' + chr(39), 'doc_id')} / 4294967296.0, 9) AS score FROM documents")
def q_stand_in_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(generate.stand_in_score(F.lit("mock"), F.col("doc_id")), 9).alias("score"))


# --- requests and outputs ---
@query(
    """SELECT 'e' || o_orderkey AS example_id, 'docvqa' AS benchmark, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus ELSE '' END AS answer,
    CASE WHEN o_orderkey % 4 = 0 THEN 'm' ELSE '' END AS model_name, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 1024 END AS INTEGER) AS max_tokens, CASE WHEN o_orderkey % 4 = 0 THEN 0.2 ELSE 0.5 END AS temperature,
    0.95 AS top_p, CAST(0 AS INTEGER) AS seed, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'p' END AS provider, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS raw_text FROM orders"""
)
def q_outputs_with_defaults(spark, sf_dir):
    """Orders as lines of outputs, a quarter of them with the request inside."""
    lines = table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.expr("""CASE WHEN o_orderkey % 4 = 0 THEN struct(struct('e' || o_orderkey AS example_id, 'docvqa' AS benchmark, o_orderpriority AS answer) AS example,
                    struct(' m ' AS model_name, 7 AS max_tokens) AS config) END""").alias("request"),
                F.expr("CASE WHEN o_orderkey % 4 > 0 THEN 'e' || o_orderkey ELSE 'other' END").alias("example_id"), F.lit("docvqa").alias("benchmark"),
                F.expr("CASE o_orderkey % 4 WHEN 1 THEN o_orderpriority ELSE '' END").alias("gold_answer"), F.expr("CASE WHEN o_orderkey % 4 = 2 THEN o_orderstatus END").alias("answer"),
                F.expr("struct(0.5 AS temperature)").alias("config"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'p' END").alias("provider"),
                F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END").alias("raw_text"),
            )
        ).alias("line")
    )
    rows = lines.select(F.from_json("line", requests.OUTPUT).alias("r")).select("r.*")
    return requests.outputs_with_defaults(rows).drop("image_path", "question", "prompt_id", "prompt")


@query(
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey ELSE 'e' || o_orderkey END AS request_id, 'e' || o_orderkey AS example_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ask "' || o_orderstatus || '"' ELSE o_orderpriority END AS prompt, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 9 WHEN o_orderkey % 3 = 0 THEN 11 ELSE 1024 END AS INTEGER) AS max_tokens,
    CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 0.9 ELSE 0.2 END AS temperature, 0.95 AS top_p FROM orders"""
)
def q_batch_requests(spark, sf_dir):
    """Orders as requests: half with an example and a prompt of two texts, half ready."""
    lines = table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.expr("CASE WHEN o_orderkey % 2 = 0 THEN struct('e' || o_orderkey AS example_id) END").alias("example"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey END").alias("request_id"),
                F.expr("CASE WHEN o_orderkey % 2 = 1 THEN 'e' || o_orderkey END").alias("example_id"), F.expr("struct(9 AS max_tokens)").alias("config"),
                F.expr("CASE WHEN o_orderkey % 2 = 0 THEN to_json(struct('s' AS system, 'ask \"' || o_orderstatus || '\"' AS user)) ELSE o_orderpriority END").alias("prompt"),
                F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 11 END").alias("max_tokens"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN struct(0.9 AS temperature) END").alias("generation_config"),
            )
        ).alias("line")
    )
    return requests.batch_requests(lines.select(F.from_json("line", requests.REQUEST).alias("r")).select("r.*"))


# --- stages, gate, summary ---
_FENCE = "CASE o_orderkey % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || {p} || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN '  ' || {p} WHEN 2 THEN '```' || {p} || '```' ELSE '{{\"steps\": []}}' END"


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'no_steps' ELSE 'json' END AS outcome, CASE WHEN o_orderkey % 4 < 3 THEN o_orderpriority END AS predicted_answer,
    CASE WHEN o_orderkey % 4 < 3 THEN '1|Read "' || o_orderpriority || '".|read|element:' || o_custkey || '|' || o_orderstatus || '|1|none' || chr(10) || '2|So it is done.|answer||x|0|wrong_answer' END AS steps FROM orders"""
)
def q_parse_structured(spark, sf_dir):
    """Orders as structured answers: in fences with and without a language, bare, and without steps."""
    first = "named_struct('step_id', 1, 'step_text', concat('Read \"', o_orderpriority, '\".'), 'step_type', 'read', 'grounding_ref', concat('element:', o_custkey), 'evidence_value', o_orderstatus, 'label', cast(null as int), 'error_type', cast(null as string))"
    second = "named_struct('step_id', 2, 'step_text', 'So it is done.', 'step_type', 'answer', 'grounding_ref', '', 'evidence_value', 'x', 'label', 0, 'error_type', 'wrong_answer')"
    payload = f"to_json(named_struct('steps', array({first}, {second}), 'predicted_answer', concat(' ', o_orderpriority, ' ')))"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.lit("e").alias("example_id"), F.lit("visualwebbench").alias("benchmark"), F.lit("/i").alias("image_path"),
        F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("canonical").alias("trace_mode"), F.lit(True).alias("expects_json"), F.expr(_FENCE.format(p=payload)).alias("raw_text"),
    )
    found, failed = parse_outputs(rows)
    line = lambda s: F.concat_ws("|", *(s[c].cast("string") for c in ("step_id", "step_text", "step_type", "grounding_ref", "evidence_value", "label", "error_type")))
    parsed = found.select(F.col("trace_id").cast("long").alias("o_orderkey"), F.col("parsing_mode").alias("outcome"), "predicted_answer", F.array_join(F.transform("steps", line), "\n").alias("steps"))
    lost = failed.select(F.col("request_id").cast("long").alias("o_orderkey"), F.col("reason").alias("outcome"))
    return parsed.unionByName(lost, allowMissingColumns=True)


@query(
    f"""WITH {catalogue._TRACE_JUDGED} SELECT 'manifest' AS stage, 'docvqa' AS benchmark, count(*) AS n FROM orders UNION ALL SELECT 'parsed', 'docvqa', count(*) FROM r
    UNION ALL SELECT 'verified', 'docvqa', count(*) FROM r WHERE passed UNION ALL SELECT 'rejected', 'docvqa', count(*) FROM r WHERE NOT passed"""
)
def q_stage_counts(spark, sf_dir):
    """Each table passes once, into a sink that keeps nothing; the counts are observed on the way."""
    counts = summary.StageCounts()
    judged = catalogue.q_validate_trace(spark, sf_dir).withColumn("benchmark", F.lit("docvqa"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("docvqa").alias("benchmark"))
    for rows in (counts.watch(orders, manifest=F.lit(True)), counts.watch(judged, parsed=F.lit(True), verified=F.col("passed"), rejected=~F.col("passed"))):
        rows.write.format("noop").mode("overwrite").save()
    return counts.table(spark)


@query(
    """WITH s AS (SELECT n_name, n_nationkey % 5 AS k FROM nation) SELECT n_name, CASE k WHEN 0 THEN 'completed' WHEN 2 THEN 'completed' WHEN 3 THEN 'completed' ELSE 'skipped' END AS status,
    CASE k WHEN 0 THEN 'docvqa,gqa' WHEN 1 THEN 'gqa' WHEN 2 THEN 'docvqa' WHEN 3 THEN 'docvqa,gqa,visualwebbench' ELSE '' END AS ready, CASE k WHEN 1 THEN 'docvqa' ELSE '' END AS pending FROM s"""
)
def q_training_gate(spark, sf_dir):
    """A nation's number decides what its three benchmarks have come to: all there, one waiting, one disabled, web pages included, nothing."""
    cases = {
        0: [("docvqa", "completed", None), ("gqa", "completed", None), ("visualwebbench", "started", None)],
        1: [("docvqa", "waiting", None), ("gqa", "completed", None)],
        2: [("docvqa", "completed", None), ("gqa", "disabled", None)],
        3: [("docvqa", "completed", None), ("gqa", "completed", True), ("visualwebbench", "completed", True)],
        4: [("visualwebbench", "completed", None), ("gqa", "completed", False)],
    }
    out = None
    for k, rows in cases.items():
        stages = spark.createDataFrame(rows, "benchmark string, status string, include_in_training boolean").withColumns({"verified": F.lit("v"), "corrupted": F.lit("c")})
        gate = summary.training_gate(stages).withColumn("k", F.lit(k))
        out = gate if out is None else out.unionByName(gate)
    nations = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") % 5).alias("k"))
    return nations.join(out, "k").select("n_name", "status", F.array_join("ready", ",").alias("ready"), F.array_join("pending", ",").alias("pending"))


_GAIN = "CAST(c_custkey % 200 AS DOUBLE) / 1000 - 0.05"


@query(
    f"""WITH g AS (SELECT c_custkey, {_GAIN} AS d FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'mock' WHEN d >= 0.05 AND 0.5 + d - 0.04 > 0.52 THEN 'go' WHEN d >= 0.02 AND d < 0.05 THEN 'marginal'
    WHEN d < 0 THEN 'worse' WHEN d < 0.02 THEN 'small' WHEN 0.5 + d < 0.55 THEN 'chance' ELSE 'overlap' END AS reason, CASE WHEN d >= 0.05 AND 0.5 + d > 0.5 THEN 'GO' ELSE 'NO-GO' END AS full_decision FROM g"""
)
def q_decision_reasons(spark, sf_dir):
    """Customers as gains over a baseline of 0.5 that reaches up to 0.52; a seventh of the scores are stand-ins."""
    d = F.expr(_GAIN)
    why = summary.decision_reason(d, 0.5 + d, 0.5 + d - 0.04, F.lit(0.52), F.col("c_custkey") % 7 == 0, model="m")
    short = F.coalesce(*(F.when(why == text.format(model="m"), F.lit(name)) for name, text in summary._REASONS.items()))
    return table(spark, sf_dir, "customer").select("c_custkey", short.alias("reason"), summary.full_decision(d, 0.5 + d, F.lit(0.5)).alias("full_decision"))


@query(
    """WITH f AS (SELECT o_orderpriority AS family, avg(CASE WHEN o_orderkey % 7 > 2 THEN 1.0 ELSE 0.0 END) AS auroc FROM orders GROUP BY 1), s AS (SELECT avg(CASE WHEN o_orderkey % 5 > 0 THEN 1.0 ELSE 0.0 END) AS a FROM orders)
    SELECT 'GO' AS decision, true AS significant, printf('contrastive (AUROC=%.4f) significantly outperforms pointwise baseline (AUROC=%.4f), with delta=%.4f. Best performance on %s corruption (AUROC=%.4f). Step-level error detection accuracy: %.4f.',
        0.75, 0.5, 0.25, (SELECT arg_min(family, (-auroc, family)) FROM f), (SELECT max(auroc) FROM f), a) AS conclusion FROM s"""
)
def q_summary(spark, sf_dir):
    """Order priorities as families."""
    orders = table(spark, sf_dir, "orders")
    families = orders.groupBy(F.col("o_orderpriority").alias("family")).agg(F.avg((F.col("o_orderkey") % 7 > 2).cast("double")).alias("auroc"))
    steps = orders.agg(F.avg((F.col("o_orderkey") % 5 > 0).cast("double")).alias("accuracy"))
    main = spark.range(1).select(*(F.lit(v).alias(c) for c, v in (("challenger", 0.75), ("challenger_low", 0.7), ("challenger_high", 0.8), ("baseline", 0.5), ("baseline_low", 0.45), ("baseline_high", 0.55))))
    return summary.summary(main, families, steps).select("decision", "significant", "conclusion")
