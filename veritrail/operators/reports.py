"""Relational reads: rosters with optional filters and paging, report lists, joins of submissions with their reports, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for an account's state.
ACTIVE, INACTIVE = ("active", "verified", "1", "true"), ("inactive", "deactivated", "0", "false")


def contains_any(columns: list[str], q: str | None) -> Column:
    """Case-insensitive substring of any column; without a query every row. % and _ in `q` are wildcards, as in SQL."""
    if not q or not q.strip():
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{q.strip()}%"), F.lit(False))
    return found


def has_status(active: Column, status: str | None) -> Column:
    """The words for active and inactive; any other word, or none, is no filter."""
    word = (status or "").strip().lower()
    return active if word in ACTIVE else ~active if word in INACTIVE else F.lit(True)


def equal_to(**wanted) -> Column:
    """All equalities whose value was supplied."""
    every = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            every = every & (F.col(column) == value)
    return every


def page(df: DataFrame, order: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest key first, with the number of rows and pages of the whole; one page if there are none."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("a page has 1 to 100 rows and a number from 1")
    total = df.agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return df.orderBy(F.desc(order)).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total)).withColumn("total_pages", pages)


def summary(reports: DataFrame) -> DataFrame:
    """Reports with their defaults: a full recognition score and the first assignment where nothing is known."""
    return reports.withColumns({"ocr_score": F.coalesce("ocr_score", F.lit(100.0)), "assignment_title": F.coalesce("assignment_title", F.lit("Assignment 1"))})


def with_optional_report(submissions: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Every submission, with nulls where it has no report: one outer join in place of a look-up a row."""
    return submissions.join(reports, key, "left")


def in_section(df: DataFrame, section: str, subject: str | None = None) -> DataFrame:
    found = F.col("section").ilike(f"%{section}%")
    return df.where(found & (F.col("subject") == subject) if subject else found)


def first_of_equals(df: DataFrame, columns: list[str], id: str) -> DataFrame:
    """The smallest id of each distinct combination of `columns`, null as a value; aggregated before rows move."""
    return df.groupBy(*columns).agg(F.min(id).alias(id), F.count("*").alias("copies"))


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Combinations that break uniqueness."""
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each key's newest row: a maximum over structs, no sort of a key's rows."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("newest")
    return df.groupBy(key).agg(newest).select(key, "newest.*")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, into: str) -> DataFrame:
    """`left` with the latest `value` of `right` at or before its time. The two are sorted together by key and time, not joined pair by pair."""
    from pyspark.sql import Window

    names = left.columns
    a = left.select(F.struct(*names).alias("row"), F.col(key).alias("k"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy("k").orderBy("at", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(into, F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", into)
