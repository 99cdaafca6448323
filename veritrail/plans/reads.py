"""Queries over everyday reads, access and state changes, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import access, analytics, reads, reports, rings, scoring, writes
from veritrail.plans import similarity as similarity_plans
from veritrail.plans import text as text_plans
from veritrail.plans.decisions import limits_sql
from veritrail.sources import stand_ins
from veritrail.sources.catalog import table

NOW = "2024-01-31 00:00:00"
MAPPINGS = (("urgent", "build"), ("4-NOT SPECIFIED", ""), ("low", "MACHINERY-A"))


def _mappings():
    return F.array(*(F.struct(F.lit(a).alias("subject"), F.lit(b).alias("section")) for a, b in MAPPINGS))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        key.alias("subject_id"), F.col("p_type").alias("subject_code"), F.when(key % 9 != 0, F.col("p_name")).otherwise(F.lit(" x ")).alias("subject_name"),
        F.when(key % 11 != 0, F.col("p_brand")).alias("branch"), (F.col("p_size") % 14).cast("int").alias("semester"), F.when(key % 4 == 0, "Inactive").otherwise("active").alias("status"),
    )


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """F3."""
    return reads.by_id(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderpriority")


def email_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The address of a customer as they typed it."""
    users = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit("@Mail.EDU ")).alias("email"))
    return reads.by_email(users, "email", " CUSTOMER#000000011@mail.edu").select("c_custkey", reads.normal_email(F.col("email")).alias("email"))


def active_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects in use of one semester, by branch, semester and code."""
    return reads.active_subjects(_subjects(spark, d), semester=3).orderBy("branch", "semester", "subject_code", "subject_id")


def newest_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders, newest first."""
    return reads.newest_first(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


def latest_named(spark: SparkSession, d: str) -> DataFrame:
    """F22."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("subject"), F.concat(F.lit("scan-"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return reads.latest_named(o, "filename", "-1", "2-HIGH", "o_orderkey")


def readable_lines(spark: SparkSession, d: str) -> DataFrame:
    """lines of conversations, as wide as their text."""
    c, n = table(spark, d, "conversations"), F.length("text")
    keep = reads.readable(F.col("text"), n % 101, n % 97, n % 29) & reads.teachable(F.col("text"))
    return c.where(keep).select("conv_id", "turn")


def subject_violations(spark: SparkSession, d: str) -> DataFrame:
    """F37 for subjects."""
    return reads.violations(_subjects(spark, d), reads.subject_rules(), "subject_id")


def user_violations(spark: SparkSession, d: str) -> DataFrame:
    """F37, C14 for users."""
    key = F.col("c_custkey")
    u = table(spark, d, "customer").select(
        "c_custkey", F.when(key % 10 == 0, " a ").otherwise(F.col("c_name")).alias("name"), F.when(key % 5 == 0, "guest").otherwise("student").alias("role"),
        F.when(key % 3 == 0, "short1").when(key % 7 == 0, "letters only").otherwise(F.concat(F.lit("pass-"), F.col("c_name"))).alias("password"),
    )
    return reads.violations(u.withColumn("repeated", F.when(key % 8 != 0, F.col("password")).otherwise(F.lit("other"))), reads.user_rules(), "c_custkey")


def report_details(spark: SparkSession, d: str) -> DataFrame:
    """An order's summary, and of equal names what its items say; some orders have no detail of a name, or none at all."""
    o = table(spark, d, "orders")
    s = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("ocr_score"), F.lit(None).cast("string").alias("assignment_title"), F.col("o_orderstatus").alias("label"))
    detail = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_linenumber") > 3, F.col("l_returnflag"))).alias("label"), F.count("*").alias("items"))
    return reads.detail_over_summary(reports.summary(s), detail, "o_orderkey")


def content_labels(spark: SparkSession, d: str) -> DataFrame:
    """V14."""
    name = F.element_at(F.array(*map(F.lit, ("Mixed", "AI-generated", "odd", "Original"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(reads.label_of(name).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    """V17."""
    id = F.col("event_id")
    forwarded = F.when(id % 3 == 0, F.concat(F.lit(" 10.0.0."), (id % 250).cast("string"), F.lit(" , 10.1.1.1"))).when(id % 3 == 1, "")
    return table(spark, d, "events").select("event_id", reads.client_address(forwarded, F.when(id % 5 != 0, F.concat(F.lit("192.168.0."), F.col("user_id").cast("string")))).alias("address"))


def section_subjects(spark: SparkSession, d: str) -> DataFrame:
    """F31, F32."""
    c, m = table(spark, d, "customer"), _mappings()
    return c.select("c_custkey", reads.subject_of_section(m, F.when(F.col("c_custkey") % 2 == 0, "build").otherwise("nowhere")).alias("subject"), reads.has_mapping(m, F.lit("URGENT"), F.substring("c_mktsegment", 1, 5)).alias("taken"))


def submission_access(spark: SparkSession, d: str) -> DataFrame:
    """each order against a user of each role and two actions."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(a).alias("action")) for r in (*reads.ROLES, "guest") for a in ("read", "delete")))
    every = o.join(c, o.o_custkey == c.c_custkey).select("*", F.explode(roles).alias("r"))
    may = reads.reaches_submission(F.col("r.role"), F.lit(7), F.col("r.action"), F.col("o_custkey"), _mappings(), F.col("c_mktsegment"), F.col("o_orderpriority"))
    return every.groupBy("r.role", "r.action").agg(F.count_if(may).alias("allowed"), F.count("*").alias("n"))


def visible_users(spark: SparkSession, d: str) -> DataFrame:
    """of all users, those that user 7 sees, who is an administrator for one half of them."""
    role = F.when(F.col("c_custkey") % 2 == 0, "admin").otherwise("student")
    return table(spark, d, "customer").where(reads.sees_user(role, F.lit(7), F.col("c_custkey"))).select("c_custkey")


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """A7, F19."""
    essays = text_plans.essays(spark, d).withColumn("text", F.when(F.col("doc_id") % 13 != 0, F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("<b>"), F.col("text"), F.lit("</b>"))).otherwise(F.col("text"))))
    return reads.row_quality(essays, "text", text.without_leakage, text.has_tags)


def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A24."""
    return reads.page_confidence(table(spark, d, "events").withColumn("confidence", F.when(F.col("event_id") % 9 != 0, F.col("value"))), "user_id", "confidence")


def ring_details(spark: SparkSession, d: str) -> DataFrame:
    """Members of rings with what the roster knows."""
    roster = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rings.with_details(similarity_plans.ring_members(spark, d), roster, "c_custkey")


def forensic_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4: rings, style anomalies, reports and flagged ones."""
    n_rings = similarity_plans.collusion_rings(spark, d).agg(F.count("*").alias("rings"))
    n_odd = text_plans.style_anomalies(spark, d).agg(F.count("*").alias("anomalies"))
    totals = stand_ins.reports(spark, d).agg(F.count("*").alias("reports"), F.count_if(analytics.flagged()).alias("flagged"))
    return totals.crossJoin(n_rings).crossJoin(n_odd)


def logout_all(spark: SparkSession, d: str) -> DataFrame:
    """users' sessions after some logged out everywhere, and how many each lost."""
    e = table(spark, d, "events").select(F.col("event_id").alias("session_id"), "user_id", (F.col("event_id") % 4 == 0).alias("is_revoked"))
    return access.revoked_all(e, e.where("user_id % 3 = 0").select("user_id").distinct(), "user_id")[1]


def rotated_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last session is revoked and a fresh one opened."""
    e = table(spark, d, "events").select(F.col("event_id").alias("session_id"), "user_id", (F.col("event_id") % 4 == 0).alias("is_revoked"), "ts")
    last = reports.latest_per_key(e, "user_id", ["ts", "session_id"], ["session_id"])
    fresh = last.select((-F.col("session_id")).alias("session_id"), "user_id", F.lit(False).alias("is_revoked"), F.lit(NOW).cast("timestamp").alias("ts"))
    return access.rotated(e, last, fresh, "session_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(~F.col("is_revoked")).alias("live"), F.min("session_id").alias("fresh"))


def reset_state(spark: SparkSession, d: str) -> DataFrame:
    """What a reset attempt leads to."""
    id, now = F.col("event_id"), F.lit(NOW).cast("timestamp")
    s = access.reset_outcome(
        id % 7 == 0, F.col("ts") + F.expr("INTERVAL 25 DAYS"), F.when(id % 2 == 0, "10.0.0.1"), F.when(id % 4 == 0, "10.0.0.1").otherwise("10.0.0.2"),
        now - F.make_dt_interval(mins=(id % 20).cast("int")), (id % 6).cast("int"), F.when(id % 5 != 0, id % 3 == 0), now,
    )
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


def escalation(spark: SparkSession, d: str) -> DataFrame:
    """Which recognisers read a region."""
    id = F.col("event_id")
    category = F.element_at(F.array(*map(F.lit, ("NORMAL", "COMPLEX", "UNCERTAIN"))), (id % 3 + 1).cast("int"))
    s = scoring.escalation(category, F.when(id % 11 != 0, F.least(F.col("value") / 100, F.lit(1.0))), id % 5 != 0, id % 2 == 0, id % 7 != 0, id % 13 == 0)
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


def statistics_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each event, the fixed ones where a text was too short."""
    e = table(spark, d, "events")
    s = scoring.with_fallback(F.struct(F.col("value").alias("mean_perplexity"), (F.col("value") / 10).alias("perplexity_variance"), F.lit(2.0).alias("entropy")), F.col("event_id") % 60 + 10)
    return e.select("event_id", s.alias("s")).select("event_id", "s.*")


def replaced_mappings(spark: SparkSession, d: str) -> DataFrame:
    """U8: the mappings of some teachers are replaced as a whole."""
    have = table(spark, d, "customer").select(F.col("c_nationkey").alias("teacher"), F.col("c_mktsegment").alias("subject")).distinct()
    fresh = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("teacher"), F.col("n_name").alias("subject"))
    return writes.replaced(have, fresh, "teacher")


def supplied_fields(spark: SparkSession, d: str) -> DataFrame:
    """Supplied fields of users change, unless the new name is another one's."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("c_custkey")
    changes = c.where(key % 3 == 0).select("c_custkey", F.when(key % 2 == 0, F.concat(F.lit("Customer#"), F.lpad((key + F.when(key % 4 == 0, 1).otherwise(1_000_000)).cast("string"), 9, "0"))).alias("c_name"), F.when(key % 5 == 0, "MOVED").alias("c_mktsegment"))
    return writes.supplied_only(c, writes.without_conflicts(c, changes, "c_custkey", "c_name"), "c_custkey")


def subject_updates(spark: SparkSession, d: str) -> DataFrame:
    """Subjects after changes of codes, branches or semesters, those left out that would take another subject's three."""
    s = _subjects(spark, d).select("subject_id", "subject_code", "branch", "semester")
    id = F.col("subject_id")
    changes = s.where(id % 3 == 0).select(
        "subject_id", F.when(id % 2 == 0, F.concat(F.lit("NEW-"), id % 40)).otherwise(F.when(id % 5 == 0, F.col("subject_code"))).alias("subject_code"),
        F.when(id % 4 == 0, F.lit("Brand#11")).alias("branch"), F.when(id % 7 == 0, (id % 14).cast("int")).alias("semester"),
    )
    seeded = s.unionByName(s.where(id % 9 == 0).select((-id - 1).alias("subject_id"), F.concat(F.lit("NEW-"), id % 40).alias("subject_code"), F.lit("Brand#11").alias("branch"), "semester"))
    return writes.supplied_only(seeded, writes.without_conflicts(seeded, changes, "subject_id", ["subject_code", "branch", "semester"]), "subject_id")


def dual_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """A request has to pass the limit of its address and that of its account."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 37).alias("ip"), F.col("user_id").alias("account"), "ts")
    return access.limited_by_both(e, "ip", "account", "ts", "event_id", (40, 86_400), (5, 86_400 * 2)).select("event_id", "limited_by")


def history_search(spark: SparkSession, d: str) -> DataFrame:
    """a word in any of four fields; a blank one is no filter, as the second half shows."""
    fields = ["p_name", "p_brand", "p_type", "label"]
    p = table(spark, d, "part").withColumn("label", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    found = lambda q, side: p.where(reports.contains_any(fields, q)).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last")).withColumn("query", F.lit(side))
    return found("Size 1", "word").unionByName(found("  ", "blank"))


def section_drill_down(spark: SparkSession, d: str) -> DataFrame:
    """F25."""
    section = F.when(F.col("student_id") % 7 != 0, F.concat(F.lit("CSE-"), F.substring(F.lit("ABCDE"), (F.col("student_id") % 5 + 1).cast("int"), F.lit(1))))
    return analytics.drill_down(stand_ins.reports(spark, d).withColumn("section", section), "section", "CSE-A").select("report_id", "student_id")


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """2.19."""
    return analytics.risk_sets(stand_ins.reports(spark, d))


def text_previews(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of a text, and what goes to a model."""
    return table(spark, d, "documents").select("doc_id", reads.preview(F.col("text"), 400).alias("preview"), F.md5(F.left("text", F.lit(5000)).cast("binary")).alias("model_md5"))


def engine_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Three engines' readings of a part's label, of more or fewer words, the first with enough words."""
    p, id = table(spark, d, "part"), F.col("p_partkey")
    times = lambda c, n: F.trim(F.repeat(F.concat(F.col(c), F.lit(" ")), n.cast("int")))
    readings = [("page", F.when(id % 3 != 0, times("p_name", id % 7)), 10), ("line", times("p_type", F.col("p_size") % 8), 15), ("plain", F.when(id % 5 != 0, F.concat_ws(" ", "p_name", "p_brand", "p_type")), 10)]
    return p.select("p_partkey", scoring.first_accepted(readings).alias("s")).select("p_partkey", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        point_lookup, email_lookup, active_subjects, newest_orders, latest_named, readable_lines, subject_violations, user_violations, report_details, content_labels, client_addresses, section_subjects,
        submission_access, visible_users, text_quality, page_confidence, ring_details, forensic_counts, logout_all, rotated_sessions, reset_state, escalation, statistics_fallback, replaced_mappings,
        supplied_fields, subject_updates, dual_rate_limits, history_search, section_drill_down, grouping_sets, text_previews, engine_cascade,
    )
}
_SUBJECTS = """s AS (SELECT p_partkey AS subject_id, p_type AS subject_code, CASE WHEN p_partkey % 9 <> 0 THEN p_name ELSE ' x ' END AS subject_name, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS branch,
    CAST(p_size % 14 AS INT) AS semester, CASE WHEN p_partkey % 4 = 0 THEN 'Inactive' ELSE 'active' END AS status FROM part)"""
_SCOPE = """EXISTS (SELECT 1 FROM (VALUES ('urgent', 'build'), ('4-not specified', ''), ('low', 'machinery-a')) m(subject, section)
    WHERE (section = '' OR contains(section, lower(c_mktsegment)) OR contains(lower(c_mktsegment), section)) AND (contains(subject, lower(o_orderpriority)) OR contains(lower(o_orderpriority), subject)))"""


def _broken(rules: dict[str, str], source: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {source} WHERE NOT coalesce({holds}, false)" for name, holds in rules.items())


SQL = {
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 7",
    "email_lookup": "SELECT c_custkey, lower(trim(c_name || '@Mail.EDU')) AS email FROM customer WHERE lower(c_name) = 'customer#000000011'",
    "active_subjects": f"WITH {_SUBJECTS} SELECT * FROM s WHERE status = 'active' AND semester = 3",
    "newest_orders": "SELECT o_orderkey, o_orderdate FROM orders",
    "latest_named": """SELECT o_orderkey, o_orderpriority AS subject, 'scan-' || o_custkey || '.pdf' AS filename FROM orders WHERE contains('scan-' || o_custkey, '-1') AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey DESC LIMIT 1""",
    "readable_lines": r"SELECT conv_id, turn FROM conversations WHERE length(text) >= 3 AND length(text) % 101 >= 30 AND length(text) % 97 > 35 AND length(text) % 29 > 14 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 1",
    "subject_violations": f"""WITH {_SUBJECTS} {_broken({"subject_code": "length(trim(subject_code)) >= 2", "subject_name": "length(trim(subject_name)) >= 2", "branch": "length(trim(branch)) > 0", "semester": "semester BETWEEN 1 AND 12", "status": "lower(trim(status)) IN ('active', 'inactive')"}, "s", "subject_id")}""",
    "user_violations": f"""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN ' a ' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'guest' ELSE 'student' END AS role,
            CASE WHEN c_custkey % 3 = 0 THEN 'short1' WHEN c_custkey % 7 = 0 THEN 'letters only' ELSE 'pass-' || c_name END AS password FROM customer),
        v AS (SELECT *, CASE WHEN c_custkey % 8 <> 0 THEN password ELSE 'other' END AS repeated FROM u)
        {_broken({"name": "length(trim(name)) >= 2", "role": "role IN ('student', 'teacher', 'hod', 'admin')", "password": "length(password) BETWEEN 8 AND 128 AND regexp_matches(password, '[A-Za-z]') AND regexp_matches(password, '[0-9]')", "password_match": "password = repeated"}, "v", "c_custkey")}""",
    "report_details": """WITH l AS (SELECT l_orderkey, max(l_returnflag) FILTER (l_linenumber > 3) AS label, count(*) AS items FROM lineitem GROUP BY 1)
        SELECT s.o_orderkey, CASE WHEN s.o_orderkey % 4 <> 0 THEN s.o_totalprice ELSE 100.0 END AS ocr_score, 'Assignment 1' AS assignment_title, coalesce(l.label, s.o_orderstatus) AS label, items
        FROM orders s LEFT JOIN l ON l_orderkey = s.o_orderkey""",
    "content_labels": "SELECT CASE event_id % 4 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'AI-generated' ELSE 'Original' END AS label, count(*) AS n FROM events GROUP BY 1",
    "client_addresses": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || event_id % 250 WHEN event_id % 5 <> 0 THEN '192.168.0.' || user_id ELSE 'unknown' END AS address FROM events",
    "section_subjects": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'urgent' ELSE 'No subjects assigned' END AS subject, lower(substr(c_mktsegment, 1, 5)) = 'build' AS taken FROM customer",
    "submission_access": f"""WITH o AS (SELECT *, {_SCOPE} AS taught FROM orders JOIN customer ON o_custkey = c_custkey),
        r AS (SELECT role, action, o.* FROM o, (VALUES ('student'), ('teacher'), ('hod'), ('admin'), ('guest')) x(role), (VALUES ('read'), ('delete')) y(action))
        SELECT role, action, count(*) FILTER (CASE role WHEN 'admin' THEN true WHEN 'hod' THEN action <> 'delete' WHEN 'student' THEN o_custkey = 7 WHEN 'teacher' THEN action <> 'delete' AND taught ELSE false END) AS allowed,
            count(*) AS n FROM r GROUP BY 1, 2""",
    "visible_users": "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey = 7",
    "text_quality": f"""WITH {text_plans._ESSAYS}, q AS (SELECT CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 6 = 0 THEN '<b>' || text || '</b>' ELSE text END END AS text FROM essays)
        SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (regexp_matches(text, '<[^>]+>')) AS tagged, count(*) FILTER ({text_plans._STRIP.format(text_plans._LEAKED)} <> {text_plans._STRIP.format("text")}) AS changed FROM q""",
    "page_confidence": """SELECT user_id, count(*) AS lines, (2 * sum(CAST(round(c * 100) AS BIGINT)) + 10 * count(c)) // nullif(20 * count(c), 0) / 10.0::DOUBLE AS confidence
        FROM (SELECT user_id, CASE WHEN event_id % 9 <> 0 THEN value END AS c FROM events) GROUP BY 1""",
    "ring_details": f"SELECT ring, student_id, c_name, c_mktsegment FROM ({similarity_plans.SQL['ring_members']}) LEFT JOIN customer ON c_custkey = student_id",
    "forensic_counts": f"""WITH {stand_ins.REPORTS} SELECT (SELECT count(*) FROM ({similarity_plans.SQL["collusion_rings"]})) AS rings, (SELECT count(*) FROM ({text_plans.SQL["style_anomalies"]})) AS anomalies,
        count(*) AS reports, count(*) FILTER (plagiarism_score > 30 OR ai_score > 50) AS flagged FROM reports""",
    "logout_all": "SELECT user_id, count(*) FILTER (event_id % 4 <> 0) AS revoked FROM events WHERE user_id % 3 = 0 GROUP BY 1",
    "rotated_sessions": """WITH l AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS id FROM events GROUP BY 1)
        SELECT e.user_id, count(*) + 1 AS sessions, count(*) FILTER (event_id % 4 <> 0 AND event_id <> id) + 1 AS live, -max(id) AS fresh FROM events e JOIN l USING (user_id) GROUP BY 1""",
    "reset_state": f"""WITH a AS (SELECT event_id, event_id % 7 = 0 AS used, TIMESTAMP '{NOW}' > ts + INTERVAL 25 DAY AS late, event_id % 2 = 0 AND event_id % 4 <> 0 AS risky, event_id % 20 > 10 AS stale, CAST(event_id % 6 AS INT) AS tries,
            CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 END AS good FROM events),
        b AS (SELECT *, CASE WHEN used THEN 'used' WHEN late THEN 'expired' WHEN NOT risky THEN 'accepted' WHEN good IS NULL THEN 'code needed' WHEN stale THEN 'code expired' WHEN good THEN 'accepted' ELSE 'wrong code' END AS outcome FROM a)
        SELECT event_id, outcome, tries + CASE WHEN outcome = 'wrong code' THEN 1 ELSE 0 END AS attempts, outcome = 'wrong code' AND tries + 1 >= 5 AS burnt FROM b""",
    "escalation": """WITH a AS (SELECT event_id, event_id % 3 AS c, CASE WHEN event_id % 11 <> 0 THEN least(value / 100, 1.0::DOUBLE) END AS sure, event_id % 5 <> 0 AS line, event_id % 2 = 0 AS page, event_id % 7 <> 0 AS vision, event_id % 13 = 0 AS first FROM events),
        b AS (SELECT *, c <> 1 AND NOT (first AND vision) AND line AS l, c = 0 AND NOT (first AND vision) AND (NOT line OR coalesce(sure, 0) < 0.80) AS up FROM a)
        SELECT event_id, l AS line, CASE c WHEN 0 THEN up AND NOT vision AND page ELSE page END AS page, CASE c WHEN 0 THEN (first AND vision) OR (up AND vision) WHEN 1 THEN NOT page AND vision ELSE first AND vision END AS vision FROM b""",
    "statistics_fallback": """SELECT event_id, CASE WHEN event_id % 60 + 10 < 50 THEN 50.0 ELSE value END AS mean_perplexity, CASE WHEN event_id % 60 + 10 < 50 THEN 1.0 ELSE value / 10 END AS perplexity_variance,
        CASE WHEN event_id % 60 + 10 < 50 THEN 3.0 ELSE 2.0 END::DOUBLE AS entropy, event_id % 60 + 10 < 50 AS fallback FROM events""",
    "replaced_mappings": """SELECT DISTINCT c_nationkey AS teacher, c_mktsegment AS subject FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0""",
    "supplied_fields": """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 1000000 END AS VARCHAR), 9, '0') END AS fresh FROM customer),
        t AS (SELECT x.c_custkey FROM x JOIN customer c ON c.c_name = fresh AND c.c_custkey <> x.c_custkey)
        SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT c_custkey FROM t) THEN coalesce(fresh, c_name) ELSE c_name END AS c_name,
            CASE WHEN c_custkey % 15 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM t) THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN x USING (c_custkey)""",
}
SQL["dual_rate_limits"] = f"""WITH RECURSIVE e AS (SELECT *, user_id % 37 AS ip FROM events), {limits_sql("e", "ip", 40, 86_400, "one")},
    p AS (SELECT e.* FROM e JOIN one USING (event_id) WHERE NOT limited), {limits_sql("p", "user_id", 5, 86_400 * 2, "two")}
    SELECT one.event_id, CASE WHEN one.limited THEN 'ip' WHEN two.limited THEN 'account' END AS limited_by FROM one LEFT JOIN two USING (event_id)"""
_SEARCH = " OR ".join(f"{c} ILIKE '%size 1%'" for c in ("p_name", "p_brand", "p_type", "'size ' || p_size"))
_COUNT = lambda t: rf"len(list_filter(string_split_regex(coalesce({t}, ''), '[\s\x0B\x{{00A0}}]+'), lambda x: x <> ''))"
SQL |= {
    "history_search": f"SELECT count(*) AS n, max(p_partkey) AS last, 'word' AS query FROM part WHERE {_SEARCH} UNION ALL SELECT count(*), max(p_partkey), 'blank' FROM part",
    "section_drill_down": f"WITH {stand_ins.REPORTS} SELECT report_id, student_id FROM reports WHERE student_id % 7 = 0 OR student_id % 5 = 0",
    "grouping_sets": f"WITH {stand_ins.REPORTS} SELECT subject, hour(created_at) AS hour, count(*) AS n FROM reports GROUP BY GROUPING SETS ((subject), (hour(created_at)), ())",
    "text_previews": "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END AS preview, md5(left(text, 5000)) AS model_md5 FROM documents",
    "subject_updates": f"""WITH {_SUBJECTS}, b AS (SELECT subject_id, subject_code, branch, semester FROM s),
        t AS (SELECT * FROM b UNION ALL SELECT -subject_id - 1, 'NEW-' || subject_id % 40, 'Brand#11', semester FROM b WHERE subject_id % 9 = 0),
        c AS (SELECT subject_id, CASE WHEN subject_id % 2 = 0 THEN 'NEW-' || subject_id % 40 WHEN subject_id % 5 = 0 THEN subject_code END AS code, CASE WHEN subject_id % 4 = 0 THEN 'Brand#11' END AS br,
            CASE WHEN subject_id % 7 = 0 THEN CAST(subject_id % 14 AS INT) END AS sem FROM b WHERE subject_id % 3 = 0),
        n AS (SELECT t.*, coalesce(code, subject_code) AS code, coalesce(br, branch) AS br, coalesce(sem, semester) AS sem FROM t JOIN c USING (subject_id)),
        x AS (SELECT n.subject_id FROM n WHERE (code, br, sem) IS DISTINCT FROM (subject_code, branch, semester) AND EXISTS (SELECT 1 FROM t WHERE t.subject_id <> n.subject_id AND t.subject_code = code AND t.branch = br AND t.semester = sem))
        SELECT t.subject_id, CASE WHEN k.subject_id IS NOT NULL THEN k.code ELSE t.subject_code END AS subject_code, CASE WHEN k.subject_id IS NOT NULL THEN k.br ELSE t.branch END AS branch,
            CASE WHEN k.subject_id IS NOT NULL THEN k.sem ELSE t.semester END AS semester FROM t LEFT JOIN (SELECT * FROM n WHERE subject_id NOT IN (SELECT subject_id FROM x)) k USING (subject_id)""",
    "engine_cascade": f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN trim(repeat(p_name || ' ', p_partkey % 7)) END AS a, trim(repeat(p_type || ' ', p_size % 8)) AS b,
            CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || p_brand || ' ' || p_type END AS c FROM part),
        n AS (SELECT *, {_COUNT("a")} AS x, {_COUNT("b")} AS y, {_COUNT("c")} AS z FROM r),
        e AS (SELECT *, CASE WHEN x >= 10 THEN 'page' WHEN y >= 15 THEN 'line' WHEN z >= 10 THEN 'plain' WHEN x >= y AND x >= z THEN 'page' WHEN y >= z THEN 'line' ELSE 'plain' END AS engine FROM n)
        SELECT p_partkey, engine, CASE engine WHEN 'page' THEN a WHEN 'line' THEN b ELSE c END AS text FROM e""",
}
