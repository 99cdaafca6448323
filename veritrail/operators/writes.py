"""Changes of tables as rewrites: the result is the table after the change, to be written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a submission, in the order of its life.
STATES = ("pending", "processing", "completed", "failed")


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """With more rows; columns that either side lacks are null, which is also how a schema grows."""
    return table.unionByName(rows, allowMissingColumns=True)


def new_only(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Those of `rows` whose key isn't taken: seeds, and conflict checks before an insert."""
    return rows.join(table.select(*key).distinct(), key, "left_anti")


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """With `rows` in place of those of the same key: the rest is kept by an anti join, nothing is sorted."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, where: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """(table, one row with how many rows changed): a conditional update. Plain Parquet has no locks: the condition holds for the version that was read."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), table.agg(F.count_if(hit).alias("changed"))


def supplied_only(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """With each change's values where they aren't null."""
    columns = [c for c in changes.columns if c != key]
    both = table.join(changes.withColumnsRenamed({c: f"new_{c}" for c in columns}), key, "left")
    return both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: str, *, guard: Column | None = None) -> DataFrame:
    """Without the rows of `keys`, but for those that `guard` protects."""
    if guard is None:
        return table.join(keys.select(key).distinct(), key, "left_anti")
    gone = table.where(~F.coalesce(guard, F.lit(False))).join(keys.select(key).distinct(), key, "left_semi").select(key).distinct()
    return table.join(gone, key, "left_anti")


def locked(submissions: DataFrame, keys: DataFrame, at: Column, suffix: Column) -> DataFrame:
    """With locks and receipts for `keys`; failed submissions, and those that are locked, stay as they are."""
    wanted = submissions.join(keys.select("submission_id").distinct().withColumn("wanted", F.lit(True)), "submission_id", "left")
    hit = F.coalesce("wanted", F.lit(False)) & (F.col("status") != "failed") & ~F.coalesce("is_locked", F.lit(False))
    receipt = F.concat_ws("-", F.lit("PLAG-SEC"), F.format_string("%04d", "submission_id"), F.date_format(at, "yyyyMMdd"), F.upper(F.left(suffix, F.lit(8))))
    return wanted.withColumns({"is_locked": F.when(hit, True).otherwise(F.col("is_locked")), "verification_token": F.when(hit, receipt).otherwise(F.col("verification_token"))}).drop("wanted")


def current_state(events: DataFrame, key: str = "submission_id") -> DataFrame:
    """Each submission's last state; of equal times the later in its life."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    return events.groupBy(key).agg(F.max_by("status", F.struct("at", rank)).alias("status"))


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """With `rows` in place of all that their keys had: a list is replaced as a whole."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def without_conflicts(table: DataFrame, changes: DataFrame, key: str, unique: str | list[str]) -> DataFrame:
    """Those of `changes` whose new value of `unique` no other row has; a change that leaves it alone has no conflict.

    `unique` may be several columns: what a change leaves null stays as the row has it, and the values that follow are compared, with those of the
    table as it was. Nulls are equal to nothing.
    """
    columns = [unique] if isinstance(unique, str) else unique
    if isinstance(unique, str):
        after = changes
    else:
        held = table.select(key, *(F.col(c).alias(f"_held_{c}") for c in columns))
        supplied = [c for c in columns if c in changes.columns]
        full = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in supplied)).join(held, key)
        after = full.select(key, *((F.coalesce(f"_new_{c}", f"_held_{c}") if c in supplied else F.col(f"_held_{c}")).alias(c) for c in columns))
        after = after.join(table.select(key, *columns), [key, *columns], "left_anti")  # what it has already is no change
    taken = table.select(F.col(key).alias("_holder"), *(F.col(c).alias(f"_value_{c}") for c in columns))
    same = (F.col(key) != F.col("_holder"))
    for c in columns:
        same = same & (F.col(c) == F.col(f"_value_{c}"))
    clash = after.join(taken, same).select(key).distinct()
    return changes.join(clash, key, "left_anti")
