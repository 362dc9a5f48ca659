"""A training corpus from ``documents``: toxicity, line dedup, n-gram join, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and
read again as the next stage's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import line_dedup, ngram_join, packing, toxicity
from tracemill.llm.staging import stage

#: a table of pieces comes from a trained model, a similarity join and a tokenizer, which SQL cannot express
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxicity_score(F.col("text"), model) < 0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; a document goes if every line of it with words did."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # in a struct, where no name can clash
    cut = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")))
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.HAS_WORD.__self__.pattern))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar documents; of rows with equal ids and texts one."""
    return ngram_join.one_of_each_class(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else stage(out, f"pipeline-{name}")
    return docs
