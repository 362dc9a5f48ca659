"""Queries of the adapters, over JSON files made of orders and customers, each beside its DuckDB twin; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.plans.catalogue import query
from tracemill.plans.frames import table
from tracemill.sources import adapters


def _files(rows: DataFrame, path: str, raw: str) -> DataFrame:
    """One file for each row, its text by a SQL expression."""
    return rows.select(F.expr(path).alias("path"), F.expr(raw).alias("raw")).withColumn("payload", F.try_parse_json("raw"))


def _both(marked: DataFrame, detail) -> DataFrame:
    """Accepted rows with their detail, the others with their problem; one pass, where a union would parse every file twice."""
    kept = F.col("problem").isNull()
    return marked.select("example_id", *(F.when(kept, F.col(c)).alias(c) for c in ("image_path", "question", "answer")), F.when(kept, detail).otherwise(F.col("problem")).alias("detail"))


_QUESTIONS = """CASE o_orderkey % 4 WHEN 0 THEN '{"split":"dev","data":[{"questionId":' || o_orderkey || ',"image":"d' || o_custkey || '.png","question":"' || o_orderstatus || '","answers":["  ' || o_orderpriority || ' ","x"]}]}'
    WHEN 1 THEN '[{"question_id":"q' || o_orderkey || '","image_path":"/abs/' || o_orderkey || '.png","question":" ' || o_orderstatus || '","answer":"' || o_orderpriority || '"}]'
    WHEN 2 THEN '{"questions":[{"image":"i.png","question":"s","answers":[" "]},{"id":"' || o_orderkey || '","document":"i' || o_orderkey || '.png","question":"s","answer":"p"}]}'
    ELSE '{"dataset":[{"id":"","image":"","question":"s","answer":"p"},{"id":7,"image":"i.png","question":" ","answer":"p"}]}' END"""
_OCR = """'{"data":[{"image":"d' || c_custkey || '.png","ocr_spans":[{"span_id":"17","text":"' || c_name || '","bbox":[0,0,5,2]}],"words":[{"text":"Total"},{"text":" "},{"text":"' || c_nationkey || '"}]},
    {"id":"' || c_custkey || '","lines":[{"text":"' || c_name || '"}],"recognitionResults":[{"lines":[{"value":"a"}],"words":[{"text":"lost"},{"text":"b"}]}]}]}'"""


@query(
    """SELECT 'docvqa_dev_' || o_orderkey AS example_id, '/img/d' || o_custkey || '.png' AS image_path, o_orderstatus AS question, o_orderpriority AS answer,
        CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer) THEN 'ocr_line:0=' || (SELECT any_value(c_name) FROM customer WHERE c_custkey = o_orderkey) || ',ocr_page0:0=a,ocr_page0:1=b'
        ELSE coalesce('17=' || c_name || ',ocr_word:0=Total,ocr_word:2=' || c_nationkey, '') END AS detail FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 = 0
    UNION ALL SELECT 'docvqa_train_q' || o_orderkey, '/abs/' || o_orderkey || '.png', o_orderstatus, o_orderpriority, '' FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT 'docvqa_train_' || o_orderkey, '/img/i' || o_orderkey || '.png', 's', 'p',
        coalesce((SELECT any_value('ocr_line:0=' || c_name || ',ocr_page0:0=a,ocr_page0:1=b') FROM customer WHERE c_custkey = o_orderkey), '') FROM orders WHERE o_orderkey % 4 = 2
    UNION ALL SELECT 'docvqa_train_0', NULL, NULL, NULL, 'missing_answer' FROM orders WHERE o_orderkey % 4 = 2
    UNION ALL SELECT 'docvqa_train_0', NULL, NULL, NULL, 'missing_image_path' FROM orders WHERE o_orderkey % 4 = 3
    UNION ALL SELECT 'docvqa_train_7', NULL, NULL, NULL, 'missing_question' FROM orders WHERE o_orderkey % 4 = 3"""
)
def q_docvqa_manifest(spark, sf_dir):
    """Orders as files of questions in four layouts, customers as files of text spans."""
    questions = _files(table(spark, sf_dir, "orders"), "'/f/train.json'", _QUESTIONS)
    lookup = adapters.ocr_lookup(_files(table(spark, sf_dir, "customer"), "'/o/' || c_custkey", _OCR))
    marked = adapters.docvqa_rows(questions, lookup, "/img")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("=", s["span_id"], s["text"])), ",")
    return _both(marked, F.coalesce(spans, F.lit("")))


_SCENES = """'{"' || c_custkey || '":{"objects":{"2":{"name":"cup","attributes":["red","n' || c_nationkey || '"," "],"x":1,"y":2,"w":3,"height":4,"relations":[{"name":"on","object":"1"},{"relation":"by","target_id":"1"},{"name":"","object":"1"}]},
    "1":{"label":"table","attributes":"' || c_name || '","bbox":[0,0,1,1]}}}}'"""


@query(
    """SELECT 'gqa_val_' || o_orderkey AS example_id, '/img/' || o_custkey || '.jpg' AS image_path, o_orderstatus AS question, o_orderpriority AS answer,
        coalesce('2:cup:red+n' || c_nationkey || ':on>1:1.0 2.0 3.0 4.0,1:table:' || c_name || '::0.0 0.0 1.0 1.0', '') AS detail FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 > 0
    UNION ALL SELECT 'gqa_val_' || o_orderkey, NULL, NULL, NULL, 'missing_answer' FROM orders WHERE o_orderkey % 3 = 0"""
)
def q_gqa_manifest(spark, sf_dir):
    """Orders as dictionaries of questions, customers as dictionaries of scenes."""
    asked = """'{"' || o_orderkey || '":{"imageId":"' || o_custkey || '","question":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"fullAnswer":" ' || o_orderpriority || '"' END || '}}'"""
    scenes = adapters.scene_lookup(_files(table(spark, sf_dir, "customer"), "'/s/' || c_custkey", _SCENES))
    marked = adapters.gqa_rows(_files(table(spark, sf_dir, "orders"), "'/f/val.json'", asked), scenes, "/img")
    one = lambda o: F.concat_ws(
        ":", o["object_id"], o["name"], F.array_join(o["attributes"], "+"),
        F.array_join(F.transform(o["relations"], lambda r: F.concat_ws(">", r["name"], r["target_object_id"])), "+"), F.array_join(o["bbox"].cast("array<string>"), " "),
    )
    return _both(marked, F.coalesce(F.array_join(F.transform("objects", one), ","), F.lit("")))


@query(
    """SELECT 'visualwebbench_web_' || o_orderkey AS example_id, '/img/' || o_orderkey || '.png' AS image_path, CASE o_orderkey % 3 WHEN 0 THEN 'tap on site' ELSE o_orderstatus END AS question, o_orderpriority AS answer,
        CASE o_orderkey % 3 WHEN 0 THEN 'element elements_0=' || o_orderstatus || ',e9=last,targets_0=t' WHEN 1 THEN 'element target=' ELSE 'weak_answer ' END AS detail FROM orders"""
)
def q_web_manifest(spark, sf_dir):
    """Orders as page tasks: with elements under a group, with a box alone, and with neither."""
    raw = """CASE o_orderkey % 3 WHEN 0 THEN '{"grp":[{"id":' || o_orderkey || ',"image":"' || o_orderkey || '.png","task_type":"tap","website":"site","target_action":"' || o_orderpriority || '","elements":["' || o_orderstatus || '"," ",{"label":"last","id":"e9"}],"targets":["t"]}]}'
        WHEN 1 THEN '[{"example_id":"' || o_orderkey || '","screenshot":"' || o_orderkey || '.png","query":"' || o_orderstatus || '","label":"' || o_orderpriority || '","bbox":[1,2,3,4]}]'
        ELSE '{"items":[{"sample_id":"' || o_orderkey || '","file_name":"' || o_orderkey || '.png","question":"' || o_orderstatus || '","answer":"' || o_orderpriority || '"}]}' END"""
    marked = adapters.web_rows(_files(table(spark, sf_dir, "orders"), "'/f/web.json'", raw), "/img")
    listed = F.array_join(F.transform("elements", lambda e: F.concat_ws("=", e["element_id"], e["text"])), ",")
    return _both(marked, F.concat_ws(" ", "verification_mode", listed))
