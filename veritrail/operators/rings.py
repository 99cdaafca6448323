"""Collusion rings: students whose texts are alike, or who handed in the same picture, and who hang together by that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import stripped
from veritrail.operators import ranks, similarity
from veritrail.operators.graph import connected_components
from veritrail.sources.catalog import materialise


def edges(submissions: DataFrame, hash: str = "visual_hash") -> DataFrame:
    """(src, dst, weight, subject) for each pair of students: the greatest similarity and the subject where it is; equal hashes weigh 1.

    Students with the same hash are tied to the first of them, which joins the same rings as all pairs would.
    """
    long = submissions.where(F.length(stripped(F.col("text"))) > similarity.LEAST_LENGTH)
    text = similarity.linked_owners(long, "subject", "submission_id", "student_id", "text", similarity.PAIR_TERMS, similarity.EDGE, overall=True).withColumnsRenamed({"a": "src", "b": "dst"})
    seen = submissions.where(F.col(hash).isNotNull()).select(hash, "student_id", "subject").distinct()
    first = seen.groupBy(hash).agg(F.min("student_id").alias("first"))
    visual = seen.join(first, hash).select(F.col("first").alias("src"), F.col("student_id").alias("dst"), F.lit(1.0).alias("cosine"), "subject")
    both = text.select("src", "dst", "cosine", "subject").unionByName(visual).where("src <> dst")
    ends = both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.round("cosine", 9).alias("cosine"), "subject")
    return ends.groupBy("src", "dst").agg(F.max("cosine").alias("weight"), F.max_by("subject", F.struct("cosine", "subject")).alias("subject"))


def rings(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ring, students, links, max_similarity in percent, subjects), numbered by their smallest student; and (ring, student_id)."""
    kept = materialise(edges, "ring-edges")
    member = connected_components(kept)
    size = member.groupBy("component").agg(F.count("*").alias("students"))
    link = kept.join(member.withColumnRenamed("node", "src"), "src").groupBy("component").agg(
        F.count("*").alias("links"), F.round(100 * F.max("weight"), 1).alias("max_similarity"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects")
    )
    numbered = ranks.running(size.join(link, "component").withColumn("one", F.lit(1)), ["component"], {"before": "one"})
    named = numbered.withColumn("ring", F.format_string("RING-%02d", F.col("before") + 1))
    return named.select("ring", "students", "links", "max_similarity", "subjects"), named.join(member, "component").select("ring", F.col("node").alias("student_id"))


def with_details(members: DataFrame, students: DataFrame, id: str) -> DataFrame:
    """Each member of a ring with what the roster says of them; a student whom the roster doesn't know stays, with nulls."""
    return members.join(students.withColumnRenamed(id, "student_id"), "student_id", "left")
