"""Trace-shaped tables made of the driver's tables, in expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.schemas import STEP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: sentences that meet every rule of the text functions
TEXT = (
    "CASE p_partkey % 12 WHEN 0 THEN 'Locate the ' || p_name WHEN 1 THEN 'Read the header of ' || p_brand || '.' "
    "WHEN 2 THEN 'Count ' || p_size || ' left of ' || p_brand WHEN 3 THEN 'the ' || p_name || ' is Before ' || p_brand || ' and after.' "
    "WHEN 4 THEN 'Therefore so be ' || p_name WHEN 5 THEN 'The reason is clear.' WHEN 6 THEN 'so the answer is ' || p_size "
    "WHEN 7 THEN 'click ' || p_name WHEN 8 THEN 'It implies ' || p_brand || '...' WHEN 9 THEN 'thus the discount' "
    "WHEN 10 THEN 'nothing here' ELSE 'Behind the ' || p_name END"
)
CHUNK = (
    "CASE p_partkey % 7 WHEN 0 THEN '1. Locate the ' || p_name WHEN 1 THEN 'Step 10) ' || p_brand || ';' WHEN 2 THEN '  - item  ' || p_size || ' ;' "
    "WHEN 3 THEN p_size || '.5 million units,' WHEN 4 THEN '3-4 items: ' WHEN 5 THEN 'step' || p_size || ': ' || p_name ELSE '* ' || p_name || ' -' END"
)
ANSWER = (
    "CASE p_partkey % 6 WHEN 0 THEN 'foo' || chr(10) || 'Answer: ' || p_name || '.' WHEN 1 THEN 'Answer: a' || chr(10) || 'rest' "
    "WHEN 2 THEN 'Thus the  answer is ' || p_size || ' .' WHEN 3 THEN 'final answer - ' || p_brand WHEN 4 THEN 'no such phrase' ELSE 'so the answer is  ' || p_name END"
)
REF = (
    "CASE p_partkey % 9 WHEN 0 THEN 'object:' || p_size WHEN 1 THEN 'objects:' || p_size || ', ' || p_partkey || ',' WHEN 2 THEN 'relation:on:' || p_size || ':7' "
    "WHEN 3 THEN 'relation:on:' || p_size WHEN 4 THEN 'foo:' || p_size WHEN 5 THEN '' WHEN 6 THEN 'element:e' || p_size WHEN 7 THEN 'elements:a, b,' || p_size "
    "ELSE 'relation:left of:1:2:3' END"
)
STEP_TYPE = (
    "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'locate' WHEN 'AO' THEN 'read' WHEN 'NF' THEN 'reason' WHEN 'NO' THEN 'extract' "
    "WHEN 'RF' THEN 'derive' ELSE 'answer' END"
)
STEP_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
SAYS = "CASE WHEN l_quantity % 4 = 0 THEN 'Read the header ' || p_name || '.' WHEN l_quantity % 4 = 1 THEN 'It is left of ' || p_brand WHEN l_quantity % 4 = 2 THEN 'so it must be ' || p_name ELSE 'The reason is ' || p_brand || '.' END"
EVIDENCE = "CASE WHEN l_quantity % 5 = 0 THEN p_brand WHEN l_quantity % 7 = 0 THEN '' ELSE upper(p_name) END"
GROUND = "CASE WHEN l_quantity % 11 = 0 THEN '' WHEN l_quantity % 13 = 0 THEN 'ocr_span:99' ELSE 'ocr_span:' || l_linenumber END"
PREDICTED = "CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 3 = 1 THEN CAST(NULL AS VARCHAR(20)) ELSE o_orderstatus END"

#: one row per step, for DuckDB
STEPS_SQL = (
    f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {STEP_ORDER}) AS INTEGER) AS step_id, l_linenumber, {STEP_TYPE} AS step_type, "
    f"{SAYS} AS step_text, {GROUND} AS grounding_ref, {EVIDENCE} AS evidence_value, p_name, l_quantity, l_discount, l_tax "
    "FROM lineitem JOIN part ON l_partkey = p_partkey"
)
#: spans of an order: a line's number and its part's name; the last line of a number counts
SPANS_SQL = "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS span_id, arg_max(p_name, step_id) AS span_text FROM steps GROUP BY l_orderkey, l_linenumber"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step: lineitems with their part; many lines repeat a number, so steps are numbered anew."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy(*[c.strip() for c in STEP_ORDER.split(",")])
    return lines.withColumn("step_id", F.row_number().over(order)).select(  # texts are made once the lines have moved
        "l_orderkey", "step_id", "l_linenumber", F.expr(STEP_TYPE).alias("step_type"), F.expr(SAYS).alias("step_text"),
        F.expr(GROUND).alias("grounding_ref"), F.expr(EVIDENCE).alias("evidence_value"), "p_name", "l_quantity", "l_discount", "l_tax",
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: steps, spans, and the answer fields."""
    step = F.struct("step_id", "step_text", "step_type", "grounding_ref", "evidence_value", F.lit(1).alias("label"), F.lit("none").alias("error_type"))
    span = F.struct(F.col("l_linenumber").cast("string").alias("span_id"), F.col("p_name").alias("text"), F.lit("").alias("normalized_text"))
    grouped = steps(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("step_id", step.alias("s"), span.alias("p")))).alias("rows"))
    orders = table(spark, sf_dir, "orders").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trace_id"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("example_id"),
        F.lit("docvqa").alias("benchmark"), F.lit("/i/" ).alias("image_path"), F.col("o_orderstatus").alias("question"), F.col("o_orderpriority").alias("gold_answer"),
        F.expr(PREDICTED).alias("predicted_answer"), F.lit("canonical").alias("trace_mode"),
        F.transform("rows", lambda r: r["s"]).cast(f"array<{STEP}>").alias("steps"), F.transform("rows", lambda r: r["p"]).alias("spans"),
        "o_orderkey", "o_custkey", "o_totalprice",
    )
