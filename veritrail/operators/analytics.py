"""Aggregates over reports: subjects, hours, buckets, sections, and each student's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators import ranks

#: Thresholds of the scores and weights of the vulnerability.
PLAGIARISM_FLAG, AI_FLAG = 30, 50
PLAGIARISM_WEIGHT, AI_WEIGHT = 0.6, 0.4
HIGH_PLAGIARISM, HIGH_AI = 25, 40
HOURS_SAVED = 0.25
CLEAN_BELOW, DANGER_ABOVE = 20, 25
STYLE_METRICS = ("word_length", "sentence_length", "ttr", "punctuation_density")
MILLION = 1_000_000
STYLE_Z, STYLE_EPSILON, STYLE_HISTORY = 2.0, 0.0001, 3


def flagged(plagiarism: str = "plagiarism_score", ai: str = "ai_score") -> Column:
    return (F.col(plagiarism) > PLAGIARISM_FLAG) | (F.col(ai) > AI_FLAG)


def percent(condition: Column) -> Column:
    """Share of rows, of all rows, in percent."""
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def exact_sum(column: str) -> Column:
    """The sum in whole millionths: no order of addition changes it. Values are taken to six digits."""
    return F.sum(F.round(F.col(column) * MILLION).cast("decimal(18,0)"))


def mean(column: str) -> Column:
    """The mean as a double, from the exact sum."""
    return exact_sum(column).cast("double") / F.count(column) / MILLION


def rounded_mean(column: str, digits: int) -> Column:
    """The mean rounded half up in whole numbers, so that a mean half way between two results has one result; null without values."""
    total, n, step = exact_sum(column), F.count(column), MILLION // 10**digits
    whole = F.call_function("div", F.abs(total) * 2 + n * step, F.nullif(n * 2 * step, F.lit(0)))
    return whole * F.signum(total.cast("double")) / 10.0**digits


def subject_vulnerability(reports: DataFrame, key: str = "subject") -> DataFrame:
    """Per subject: reports, mean scores, share flagged and the weighted risk, which is taken from means that are not rounded."""
    plagiarism, ai = mean("plagiarism_score"), mean("ai_score")
    return reports.groupBy(key).agg(
        F.count("*").alias("total"), rounded_mean("plagiarism_score", 1).alias("avg_plagiarism"), rounded_mean("ai_score", 1).alias("avg_ai"), F.round(percent(flagged()), 1).alias("flagged_rate"),
        F.round(plagiarism * PLAGIARISM_WEIGHT + ai * AI_WEIGHT, 1).alias("vulnerability"),
    ).orderBy(F.desc("vulnerability"), key)


def evaluation_savings(reports: DataFrame) -> DataFrame:
    """How many reports there are and the hours of reading that they saved."""
    n = F.count("*")
    return reports.agg(n.alias("total_evaluated"), (n * HOURS_SAVED).alias("hours_saved"), F.when(n > 0, "computed from reports").otherwise("no reports yet").alias("note"))


def hour_risk_bins(spark_range: DataFrame, reports: DataFrame, at: str = "created_at") -> DataFrame:
    """All 24 hours, empty ones too: count, mean scores and risk level. Rows without a time belong to no hour. `spark_range`: ids 0 to 23."""
    by = reports.where(F.col(at).isNotNull()).groupBy(F.hour(at).alias("hour")).agg(
        F.count("*").alias("n"), mean("plagiarism_score").alias("p"), mean("ai_score").alias("a"), rounded_mean("plagiarism_score", 1).alias("p1"), rounded_mean("ai_score", 1).alias("a1"),
    )
    hours = spark_range.select(F.col("id").cast("int").alias("hour"))
    n = F.coalesce("n", F.lit(0))
    high = (n > 0) & ((F.col("p") > HIGH_PLAGIARISM) | (F.col("a") > HIGH_AI))
    return hours.join(F.broadcast(by), "hour", "left").select(
        F.format_string("%02d:00", "hour").alias("hour"), n.alias("submissions"), F.coalesce("p1", F.lit(0.0)).alias("avg_plagiarism"),
        F.coalesce("a1", F.lit(0.0)).alias("avg_ai"), F.when(high, "High").otherwise("Normal").alias("risk"),
    ).orderBy("hour")


def score_buckets(reports: DataFrame, score: str = "plagiarism_score") -> DataFrame:
    """Reports below 15, from 15 to 30 inclusive, and above 30."""
    c, count = F.col(score), lambda when: F.count_if(when)
    return reports.agg(count(c < 15).alias("original"), count((c >= 15) & (c <= 30)).alias("moderate"), count(c > 30).alias("high"))


def section_comparison(reports: DataFrame, section: str = "section", default: str = "CSE-A") -> DataFrame:
    """Per section, null ones counted with `default`: clean and flagged reports, and the flagged share in whole percent."""
    bad = F.count_if(F.col("plagiarism_score") >= CLEAN_BELOW)
    share = F.round(bad * 100.0 / F.count("*")).cast("long")
    return reports.groupBy(F.coalesce(section, F.lit(default)).alias(section)).agg(
        F.count_if(F.col("plagiarism_score") < CLEAN_BELOW).alias("clean"), bad.alias("flagged"), share.alias("flagged_percent"), (share > DANGER_ABOVE).alias("danger"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value and their share in percent, null as a value of its own. One window over the values' counts, not over the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation and quartiles of a column; NaN and null values don't count."""
    known = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("v"))
    got = known.agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    cut = ranks.quantiles(known, "v", (0.25, 0.5, 0.75))
    return got.crossJoin(F.broadcast(cut)).select("n", "mean", "std", "least", *(F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)), "most")


def risk_cube(reports: DataFrame) -> DataFrame:
    """Counts and mean score by subject and hour, and over all of either or both."""
    r = reports.select("subject", F.hour("created_at").alias("hour"), "plagiarism_score")
    grouped = r.cube("subject", "hour").agg(F.count("*").alias("n"), rounded_mean("plagiarism_score", 4).alias("avg_plagiarism"), F.grouping_id().alias("level"))
    return grouped.withColumn("level", F.col("level").cast("int"))


def risk_rollup(reports: DataFrame) -> DataFrame:
    """Counts and highest score by subject and hour, by subject, and over all."""
    r = reports.select("subject", F.hour("created_at").alias("hour"), "plagiarism_score")
    return r.rollup("subject", "hour").agg(F.count("*").alias("n"), F.max("plagiarism_score").alias("most"))


def risk_sets(reports: DataFrame) -> DataFrame:
    """Counts by subject, by hour, and over all, in one pass."""
    r = reports.select("subject", F.hour("created_at").alias("hour"))
    return r.groupingSets([("subject",), ("hour",), ()], "subject", "hour").agg(F.count("*").alias("n"))


def drill_down(reports: DataFrame, section: str, wanted: str, default: str = "CSE-A") -> DataFrame:
    """Reports of one section, those without counted with `default`."""
    return reports.where(F.coalesce(section, F.lit(default)) == wanted)


def style_anomalies(fingerprints: DataFrame, student: str = "student_id", at: str = "created_at", id: str = "submission_id") -> DataFrame:
    """Students whose latest text is unlike their earlier ones.

    A student needs three texts. Mean and population deviation of the four metrics over all but the latest; its distance in deviations,
    averaged over the metrics, must exceed 2. The metric farthest off is named, the first of equals in the metrics' order.
    """
    row = F.struct(F.col(at).alias("at"), F.col(id).alias("id"), *STYLE_METRICS)
    power = {(m, k): F.sum(F.col(m).cast("decimal(38,12)") if k == 1 else F.pow(F.col(m), F.lit(2.0))).cast("double") for m in STYLE_METRICS for k in (1, 2)}
    # one row a student, with partial sums: the latest row is taken out of them afterwards
    per = fingerprints.groupBy(student).agg(F.count("*").alias("n"), F.max_by(row, F.struct(at, id)).alias("last"), *(c.alias(f"{m}_{k}") for (m, k), c in power.items()))
    per = per.where(F.col("n") >= STYLE_HISTORY).withColumn("before", F.col("n") - 1)
    for m in STYLE_METRICS:
        left, squares = F.col(f"{m}_1") - F.col(f"last.{m}"), F.col(f"{m}_2") - F.col(f"last.{m}") * F.col(f"last.{m}")
        spread = squares / F.col("before") - F.pow(left / F.col("before"), F.lit(2.0))
        # what is left of equal values after subtraction is rounding, not spread
        per = per.withColumns({f"{m}_mean": left / F.col("before"), f"{m}_std": F.when(spread > 1e-12 * F.greatest(F.lit(1.0), F.col(f"{m}_2")), F.sqrt(F.abs(spread))).otherwise(F.lit(0.0))})
    seen = per.select(student, F.col("last.id").alias(id), "before", *(F.col(f"last.{m}").alias(m) for m in STYLE_METRICS), *(f"{m}_{k}" for m in STYLE_METRICS for k in ("mean", "std")))
    z = {m: F.abs(F.col(m) - F.col(f"{m}_mean")) / (F.col(f"{m}_std") + STYLE_EPSILON) for m in STYLE_METRICS}
    scored = seen.withColumns({f"{m}_z": z[m] for m in STYLE_METRICS})
    off = sum((F.col(f"{m}_z") for m in STYLE_METRICS), F.lit(0.0)) / len(STYLE_METRICS)
    most = F.greatest(*(f"{m}_z" for m in STYLE_METRICS))
    named = F.coalesce(*(F.when(F.col(f"{m}_z") == most, m) for m in STYLE_METRICS))
    return scored.where(off > STYLE_Z).select(student, id, F.round(off, 2).alias("deviation"), named.alias("metric"), (F.col("before") + 1).alias("history")).orderBy(F.desc("deviation"), student)
