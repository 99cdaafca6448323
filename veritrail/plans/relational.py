"""Queries over reports, rosters and joins, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import access, analytics, reports
from veritrail.sources import stand_ins
from veritrail.sources.catalog import table


def subject_vulnerability(spark: SparkSession, d: str) -> DataFrame:
    """A1: subjects ranked by risk."""
    return analytics.subject_vulnerability(stand_ins.reports(spark, d))


def evaluation_savings(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return analytics.evaluation_savings(stand_ins.reports(spark, d))


def hour_risk_bins(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return analytics.hour_risk_bins(spark.range(24), stand_ins.reports(spark, d))


def forensic_totals(spark: SparkSession, d: str) -> DataFrame:
    """A4: several one-row results side by side."""
    r = stand_ins.reports(spark, d)
    return r.agg(F.count("*").alias("reports"), F.countDistinct("student_id").alias("students"), F.countDistinct("subject").alias("subjects"), F.count_if(analytics.flagged()).alias("flagged"))


def value_counts_pct(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    return analytics.value_counts(table(spark, d, "documents"), "lang")


def score_describe(spark: SparkSession, d: str) -> DataFrame:
    """A6, A9."""
    return analytics.describe(table(spark, d, "events"), "value")


def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return analytics.score_buckets(stand_ins.reports(spark, d))


def section_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh student has no section."""
    section = F.when(F.col("student_id") % 7 != 0, F.concat(F.lit("CSE-"), F.substring(F.lit("ABCDE"), (F.col("student_id") % 5 + 1).cast("int"), F.lit(1))))
    return analytics.section_comparison(stand_ins.reports(spark, d).withColumn("section", section))


def role_totals(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("n"))


def display_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags and the overall status of each report."""
    p, a = F.col("plagiarism_score"), F.col("ai_score")
    return stand_ins.reports(spark, d).select("report_id", (p > 30).alias("plagiarism_flag"), (a > 50).alias("ai_flag"), F.when((a < 40) & (p < 30), "original").otherwise("suspicious").alias("status"))


def roster_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a search."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    found = c.where(reports.equal_to(c_mktsegment="BUILDING") & reports.contains_any(["c_name", "c_mktsegment"], "00") & reports.has_status(F.col("c_acctbal") >= 0, "Verified"))
    return reports.page(found, "c_custkey", 2, 20)


def nation_or_segment(spark: SparkSession, d: str) -> DataFrame:
    """either of two columns."""
    return table(spark, d, "customer").where((F.col("c_nationkey") == 7) | (F.col("c_mktsegment") == "AUTOMOBILE")).select("c_custkey", "c_nationkey", "c_mktsegment")


def batch_reports(spark: SparkSession, d: str) -> DataFrame:
    """Submissions, reports and users in one; the joins' sides are left to the planner."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    both = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return both.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), analytics.rounded_mean("l_discount", 6).alias("avg_discount"))


def section_reports(spark: SparkSession, d: str) -> DataFrame:
    """Filters that reach the scan, then joins."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    named = o.join(c, o.o_custkey == c.c_custkey).withColumnsRenamed({"c_mktsegment": "section", "o_orderpriority": "subject"})
    return reports.in_section(named, "hold", "1-URGENT").select("o_orderkey", "c_custkey", "section", "subject")


def my_submissions(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their labels, where there are any."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    return reports.with_optional_report(docs, labels, "doc_id").select("doc_id", "source", "quality", "toxic", F.col("quality").isNotNull().alias("has_report"))


def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal texts."""
    return reports.first_of_equals(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "copies")


def dedup_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first of files with equal digests."""
    digest = table(spark, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))
    return reports.first_of_equals(digest, ["digest"], "page_id")


def top_flagged(spark: SparkSession, d: str) -> DataFrame:
    """The first five above the limit."""
    return stand_ins.reports(spark, d).where("plagiarism_score > 30").orderBy(F.desc("plagiarism_score"), "report_id").limit(5).select("report_id", "subject", "plagiarism_score")


def distinct_sections(spark: SparkSession, d: str) -> DataFrame:
    """Values that are set, and a constant one."""
    return table(spark, d, "customer").where("c_mktsegment <> ''").select("c_mktsegment").distinct().unionByName(spark.range(1).select(F.lit("Other").alias("c_mktsegment")))


def intersect_except_groups(spark: SparkSession, d: str) -> DataFrame:
    """Users of two kinds of events, in both and in one only."""
    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2)
    ends = kinds.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))
    a, b = (e.join(F.broadcast(ends), e.event_type == ends[k], "left_semi").select("user_id") for k in ("first", "last"))
    return a.intersect(b).select("user_id", F.lit("both").alias("side")).unionByName(a.distinct().exceptAll(b.distinct()).select("user_id", F.lit("first").alias("side")))


def semi_anti_roster(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders, and how many of each."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = c.c_custkey == o.o_custkey
    count = lambda how, side: c.join(o, on, how).groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


def asof_last_score(spark: SparkSession, d: str) -> DataFrame:
    """2.19: for each purchase the latest view's value at or before it."""
    e = table(spark, d, "events")
    kinds = ("purchase", "view")
    left = e.where(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == kinds[1]).select("user_id", "ts", "value")
    return reports.as_of(left, right, "user_id", "ts", "ts", "value", "last_value").select("event_id", "user_id", "last_value")


def cube_risk(spark: SparkSession, d: str) -> DataFrame:
    """2.19."""
    return analytics.risk_cube(stand_ins.reports(spark, d))


def rollup_subject_hour(spark: SparkSession, d: str) -> DataFrame:
    """2.19."""
    return analytics.risk_rollup(stand_ins.reports(spark, d))


def approx_students(spark: SparkSession, d: str) -> DataFrame:
    """2.19: distinct students, exactly, and whether the approximate count is within a fifth of that."""
    seen = stand_ins.reports(spark, d).groupBy("subject").agg(F.count_distinct("student_id").alias("students"), F.approx_count_distinct("student_id", 0.03).alias("about"))
    return seen.select("subject", "students", (F.abs(F.col("about") - F.col("students")) <= 0.2 * F.col("students")).alias("close"))


def gated_vulnerability(spark: SparkSession, d: str) -> DataFrame:
    """What each role gets to see of the ranking of subjects; students and those without a role see nothing."""
    found = [access.gated(subject_vulnerability(spark, d), r).withColumn("asked_by", F.lit(r)) for r in (*access.ROLES, "guest")]
    return reduce(DataFrame.unionByName, found)


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last state."""
    return reports.latest_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


def key_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Combinations that are there more than once."""
    return reports.repeated_keys(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


QUERIES = {
    f.__name__: f
    for f in (
        subject_vulnerability, evaluation_savings, hour_risk_bins, forensic_totals, value_counts_pct, score_describe, score_buckets, section_comparison, role_totals, display_flags,
        roster_page, nation_or_segment, batch_reports, section_reports, my_submissions, dedup_documents, dedup_pages, top_flagged, distinct_sections, intersect_except_groups,
        semi_anti_roster, asof_last_score, cube_risk, rollup_subject_hour, approx_students, gated_vulnerability, latest_status, key_conflicts,
    )
}
_R = f"WITH {stand_ins.REPORTS}"


def _mean(column: str, digits: int) -> str:
    """The mean in whole numbers, rounded half up."""
    step = 10 ** (6 - digits)
    total, n = f"sum(CAST(round({column} * 1000000) AS BIGINT))", f"count({column})"
    return f"((2 * abs({total}) + {step} * {n}) // nullif({2 * step} * {n}, 0)) * sign({total}) / {10.0**digits}::DOUBLE"


def _avg(column: str) -> str:
    return f"CAST(sum(CAST(round({column} * 1000000) AS BIGINT)) AS DOUBLE) / count({column}) / 1000000"


SQL = {
    "subject_vulnerability": f"""{_R} SELECT subject, count(*) AS total, {_mean("plagiarism_score", 1)} AS avg_plagiarism, {_mean("ai_score", 1)} AS avg_ai,
        round(avg(CASE WHEN plagiarism_score > 30 OR ai_score > 50 THEN 100.0 ELSE 0.0 END), 1) AS flagged_rate, round(0.6::DOUBLE * ({_avg("plagiarism_score")}) + 0.4::DOUBLE * ({_avg("ai_score")}), 1) AS vulnerability
        FROM reports GROUP BY subject""",
    "evaluation_savings": f"""{_R} SELECT count(*) AS total_evaluated, CAST(count(*) * 0.25 AS DOUBLE) AS hours_saved,
        CASE WHEN count(*) > 0 THEN 'computed from reports' ELSE 'no reports yet' END AS note FROM reports""",
    "hour_risk_bins": f"""{_R}, h AS (SELECT hour(created_at) AS hour, count(*) AS n, {_avg("plagiarism_score")} AS p, {_avg("ai_score")} AS a, {_mean("plagiarism_score", 1)} AS p1, {_mean("ai_score", 1)} AS a1 FROM reports WHERE created_at IS NOT NULL GROUP BY 1)
        SELECT printf('%02d:00', r.hour) AS hour, coalesce(n, 0) AS submissions, coalesce(p1, 0) AS avg_plagiarism, coalesce(a1, 0) AS avg_ai,
            CASE WHEN n > 0 AND (p > 25 OR a > 40) THEN 'High' ELSE 'Normal' END AS risk
        FROM (SELECT unnest(range(24)) AS hour) r LEFT JOIN h ON h.hour = r.hour""",
    "forensic_totals": f"""{_R} SELECT count(*) AS reports, count(DISTINCT student_id) AS students, count(DISTINCT subject) AS subjects,
        count(*) FILTER (plagiarism_score > 30 OR ai_score > 50) AS flagged FROM reports""",
    "value_counts_pct": "SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang",
    "score_describe": """SELECT count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, round(quantile_cont(value, 0.25), 4) AS q1,
        round(quantile_cont(value, 0.5), 4) AS q2, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS most FROM events""",
    "score_buckets": f"""{_R} SELECT count(*) FILTER (plagiarism_score < 15) AS original, count(*) FILTER (plagiarism_score BETWEEN 15 AND 30) AS moderate,
        count(*) FILTER (plagiarism_score > 30) AS high FROM reports""",
    "section_comparison": f"""{_R}, s AS (SELECT CASE WHEN student_id % 7 <> 0 THEN 'CSE-' || substr('ABCDE', student_id % 5 + 1, 1) ELSE 'CSE-A' END AS section, plagiarism_score FROM reports)
        SELECT section, count(*) FILTER (plagiarism_score < 20) AS clean, count(*) FILTER (plagiarism_score >= 20) AS flagged,
            CAST(round(count(*) FILTER (plagiarism_score >= 20) * 100.0 / count(*)) AS BIGINT) AS flagged_percent,
            round(count(*) FILTER (plagiarism_score >= 20) * 100.0 / count(*)) > 25 AS danger FROM s GROUP BY section""",
    "role_totals": "SELECT c_mktsegment AS role, count(*) AS n FROM customer GROUP BY 1",
    "display_flags": f"""{_R} SELECT report_id, plagiarism_score > 30 AS plagiarism_flag, ai_score > 50 AS ai_flag,
        CASE WHEN ai_score < 40 AND plagiarism_score < 30 THEN 'original' ELSE 'suspicious' END AS status FROM reports""",
    "roster_page": """WITH f AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
            WHERE c_mktsegment = 'BUILDING' AND (c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%') AND c_acctbal >= 0), n AS (SELECT count(*) AS total FROM f)
        SELECT *, greatest(1, CAST(ceil(total / 20.0) AS BIGINT)) AS total_pages FROM (SELECT * FROM f ORDER BY c_custkey DESC LIMIT 20 OFFSET 20), n""",
    "nation_or_segment": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 7 OR c_mktsegment = 'AUTOMOBILE'",
    "batch_reports": f"""SELECT c_mktsegment, o_orderpriority, count(*) AS n, {_mean("l_discount", 6)} AS avg_discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "section_reports": """SELECT o_orderkey, c_custkey, c_mktsegment AS section, o_orderpriority AS subject FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment ILIKE '%hold%' AND o_orderpriority = '1-URGENT'""",
    "my_submissions": "SELECT doc_id, source, quality, toxic, quality IS NOT NULL AS has_report FROM documents LEFT JOIN labels USING (doc_id)",
    "dedup_documents": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "dedup_pages": "SELECT md5(html) AS digest, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
    "top_flagged": f"{_R} SELECT report_id, subject, plagiarism_score FROM reports WHERE plagiarism_score > 30 ORDER BY plagiarism_score DESC, report_id LIMIT 5",
    "distinct_sections": "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> '' UNION ALL SELECT 'Other'",
    "intersect_except_groups": """WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2),
        a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM k)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM k))
        SELECT user_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "semi_anti_roster": """SELECT c_mktsegment, count(*) AS n, 'with' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1
        UNION ALL SELECT c_mktsegment, count(*), 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1""",
    "asof_last_score": """SELECT p.event_id, p.user_id, max_by(v.value, (v.ts, v.value)) AS last_value FROM events p
        LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1, 2""",
    "cube_risk": f"""{_R} SELECT subject, hour(created_at) AS hour, count(*) AS n, {_mean("plagiarism_score", 4)} AS avg_plagiarism, grouping(subject, hour(created_at)) AS level
        FROM reports GROUP BY CUBE (subject, hour(created_at))""",
    "rollup_subject_hour": f"{_R} SELECT subject, hour(created_at) AS hour, count(*) AS n, max(plagiarism_score) AS most FROM reports GROUP BY ROLLUP (subject, hour(created_at))",
    "latest_status": "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "approx_students": f"{_R} SELECT subject, count(DISTINCT student_id) AS students, true AS close FROM reports GROUP BY 1",
    "key_conflicts": "SELECT c_nationkey, c_mktsegment, count(*) AS copies FROM customer GROUP BY 1, 2 HAVING count(*) > 1",
}
SQL["gated_vulnerability"] = f"SELECT * FROM ({SQL['subject_vulnerability']}), (VALUES {', '.join(f"('{r}')" for r in access.STAFF)}) r(asked_by)"
