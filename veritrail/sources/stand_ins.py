"""The roles of users, submissions and reports, played by the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.sources.catalog import table


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each event: two scores, subject, student and time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"), F.col("user_id").alias("student_id"), F.col("event_type").alias("subject"), F.col("value").alias("plagiarism_score"),
        F.get_json_object("props", "$.k").cast("double").alias("ai_score"), F.col("ts").alias("created_at"),
    )


def submissions(spark: SparkSession, sf_dir: str, students: int) -> DataFrame:
    """A submission for each document, by one of `students` students, 37 minutes after the one before."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("submission_id"), (F.col("doc_id") % students).alias("student_id"), F.col("source").alias("subject"), "text",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 37).cast("int"))).alias("created_at"),
    )


#: The same in SQL, as common table expressions.
REPORTS = """reports AS (
    SELECT event_id AS report_id, user_id AS student_id, event_type AS subject, value AS plagiarism_score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ai_score, ts AS created_at
    FROM events)"""


def submissions_sql(students: int) -> str:
    return f"""submissions AS (
    SELECT doc_id AS submission_id, doc_id % {students} AS student_id, source AS subject, text, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS created_at
    FROM documents)"""
