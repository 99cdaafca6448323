"""From raw documents to token ids: quality rules, near duplicates, decontamination, secrets, encoding.

Every stage reads what its predecessor wrote and decides on all of it. Defined results: a null text counts as empty and falls to the quality
rules; a row without doc_id is never a near duplicate and passes on its text's own merits; rows that repeat a doc_id are judged each by its own text,
as documents after all others: none is lost but to a near duplicate; an empty table gives an empty table; columns beside those of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, decontaminate, ngram_join, quality_rules, secrets
from veritrail.operators import ranks
from veritrail.sources.catalog import materialise, table, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the quality rules."""
    return quality_rules.judge(docs.select(COLUMNS)).where("quality_rules.kept").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `_number`, the doc_id, or where several rows have that a number of their own after all ids, by the order of their texts."""
    several = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id"), "repeated")
    alone = docs.withColumn("_number", F.col("doc_id"))
    if several.isEmpty():
        return alone
    last = docs.agg(F.max("doc_id")).first()[0]
    # repeated rows are ranks of ranges, so that an id which very many rows share is not one task's; equal rows are near duplicates in any order
    again = docs.join(several, "doc_id", "left_semi").withColumn("_one", F.lit(1))
    ranked = ranks.running(again, ["doc_id", "text", "lang", "source", "n_chars"], {"_before": "_one"}).withColumn("_number", F.col("_before") + last + 1)
    return alone.join(several, "doc_id", "left_anti").unionByName(ranked.drop("_one", "_before"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similar shingle sets link, the document with the smallest doc_id; rows that repeat a doc_id come after all others."""
    docs = _numbered(docs.select(COLUMNS))
    heads = ngram_join.similar_sets(docs, "_number").where("_number = component_id").select("_number")
    kept = docs.join(heads, "_number", "left_semi").select(COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(COLUMNS))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.annotate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("passages") == 0).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; n_chars follows the text."""
    found = secrets.scan(docs.select(COLUMNS), mask=True)
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers."""
    ids = bpe.encode(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", keep_distinct),
    ("decontamination", keep_clean),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
