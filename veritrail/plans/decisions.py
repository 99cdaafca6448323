"""Queries over decision rules, access and ordered state, and the same in SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import access, scopes, scoring
from veritrail.sources.catalog import table

NOW = "2024-01-31 00:00:00"
CLEARED = ("2024-01-05 00:00:00", "2024-01-05 06:30:00", "2024-01-20 12:00:00")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def ai_label(spark: SparkSession, d: str) -> DataFrame:
    """R1, R4."""
    e = _events(spark, d)
    return e.select("event_id", scoring.model_decision(F.col("k") / 100, F.col("event_id") % 60 + 40).alias("s")).select("event_id", "s.*")


def ai_label_fusion(spark: SparkSession, d: str) -> DataFrame:
    """R2, R3."""
    pattern, align = F.element_at(F.array(*map(F.lit, ("uniform", "mixed", "irregular"))), (F.col("event_id") % 3 + 1).cast("int")), F.when(F.col("event_id") % 2 == 0, "high").otherwise("low")
    s = scoring.fused_layers(F.least(F.col("value"), F.lit(100.0)), F.col("k").cast("double"), F.col("k") / 100, F.lit(0.5), pattern, align)
    return _events(spark, d).select("event_id", s.alias("s")).select("event_id", "s.*")


def statistical_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """R5."""
    return _events(spark, d).select("event_id", scoring.statistical_likelihood(F.col("value"), F.col("k") / 100).alias("s")).select("event_id", "s.*")


def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    """R7, R8."""
    words = (F.col("event_id") % 25).cast("int")
    s = scoring.ocr_gate(F.col("k"), words, F.col("event_id") % 2 == 0)
    return _events(spark, d).select("event_id", s.alias("s"), scoring.recogniser_confidence(words).alias("confidence")).select("event_id", "s.*", "confidence")


def region_routing(spark: SparkSession, d: str) -> DataFrame:
    """R9, R10, A27."""
    s = scoring.region_route(F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0, F.col("k") / 100, F.col("value") / 500, F.col("value"))
    return _events(spark, d).select(s.alias("s")).groupBy("s.category", "s.kind").agg(F.count("*").alias("n"))


def fusion_decision(spark: SparkSession, d: str) -> DataFrame:
    """A part's name and its type as what two recognisers read."""
    p, name, kind = table(spark, d, "part"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")), F.when(F.col("p_partkey") % 13 != 0, F.col("p_type"))
    s = scoring.fused_recognisers(name, F.col("p_size") / 50, F.when(F.col("p_partkey") % 3 == 0, name).otherwise(kind), F.lit(0.75))
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


def permission_matrix(spark: SparkSession, d: str) -> DataFrame:
    """users' requests, each for one of all permissions, and whether the user's role holds it; customers are the users, some without a role."""
    wanted = sorted({p for held in access.ROLES.values() for p in held} | {"user:delete:all"})
    roles = [*access.ROLES, "guest", None]
    c = table(spark, d, "customer")
    role = F.element_at(F.array(*(F.lit(r).cast("string") for r in roles)), (F.col("c_custkey") % len(roles) + 1).cast("int"))
    asked = F.element_at(F.array(*map(F.lit, wanted)), (F.floor(F.col("c_custkey") / len(roles)) % len(wanted) + 1).cast("int"))
    users = c.select("c_custkey", role.alias("role"), asked.alias("permission"))
    return users.withColumns({"allowed": access.permitted(F.col("role"), F.col("permission")), "staff": access.has_role(F.col("role"), access.STAFF)})


#: Priorities and segments of which teachers' mappings are made.
SUBJECTS, SECTIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _teachers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as teachers, whose mappings are JSON lists: parts of subjects and sections, longer texts that contain them, blank ones, and bad JSON."""
    k = F.col("s_suppkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    some = F.struct(F.substring(pick(SUBJECTS, k), F.lit(3), (k % 6 + 1).cast("int")).alias("subject"), F.substring(pick(SECTIONS, k * 3), (k % 3 + 1).cast("int"), (k % 7).cast("int")).alias("section"))
    more = F.struct(F.concat(F.lit(" "), pick(SUBJECTS, k + 2), F.lit(" course")).alias("subject"), F.when(k % 4 != 0, F.concat(F.lit("the "), pick(SECTIONS, k), F.lit("s"))).alias("section"))
    text = F.to_json(F.when(k % 2 == 0, F.array(some, more)).otherwise(F.array(some)))
    bad = F.when(k % 11 == 0, "{oops").when(k % 13 == 0, None).when(k % 17 == 0, "[]").when(k % 19 == 0, F.to_json(more)).otherwise(text)
    return table(spark, d, "supplier").select("s_suppkey", bad.alias("mapping"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderpriority", "c_mktsegment")


def teacher_scope(spark: SparkSession, d: str) -> DataFrame:
    """How many orders of each kind lie inside each teacher's mapping, and the first of them."""
    kinds = _orders(spark, d).groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))
    found = scopes.scope(kinds, scopes.mappings(_teachers(spark, d), "s_suppkey", "mapping"), "o_orderpriority", "c_mktsegment")
    return kinds.join(found, ["o_orderpriority", "c_mktsegment"]).withColumnRenamed("teacher", "s_suppkey")


def orders_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """J11 as a semi-join: orders that lie inside any teacher's mapping of one subject and section; F28."""
    narrow = _teachers(spark, d).where("mapping like '%,%'")
    found = scopes.scope(_orders(spark, d), scopes.mappings(narrow, "s_suppkey", "mapping").where("length(subject) > 3 and length(section) > 5"), "o_orderpriority", "c_mktsegment")
    return _orders(spark, d).join(found, ["o_orderpriority", "c_mktsegment"], "left_semi").select("o_orderkey", "c_mktsegment", "o_orderpriority")


def token_purge(spark: SparkSession, d: str) -> DataFrame:
    """F11 to F13."""
    used, now = F.col("value") > 50, F.lit(NOW).cast("timestamp")
    expires, used_at = F.col("ts") + F.expr("INTERVAL 10 DAYS"), F.when(used, F.col("ts") + F.expr("INTERVAL 5 HOURS"))
    return table(spark, d, "events").select("event_id", access.token_state(used, expires, now).alias("state"), access.to_purge(used, used_at, expires, now).alias("purge"))


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One key."""
    most, seconds = access.POLICIES["resend_verification"]
    return access.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", most, seconds * 40).select("event_id", "limited", "retry_after")


def rate_limit_resets(spark: SparkSession, d: str) -> DataFrame:
    """A purchase resets its user's limit; what it is itself is no request."""
    most, seconds = access.POLICIES["resend_verification"]
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("reset"))
    return access.rate_limited(e, "user_id", "ts", "event_id", most, seconds * 40, "reset").select("event_id", "limited", "retry_after")


def rate_limits_cleared(spark: SparkSession, d: str) -> DataFrame:
    """All limits are cleared at some moments."""
    most, seconds = access.POLICIES["resend_verification"]
    moments = [datetime.fromisoformat(x).replace(tzinfo=UTC) for x in CLEARED]
    return access.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", most, seconds * 40, cleared=moments).select("event_id", "limited", "retry_after")


def session_validity(spark: SparkSession, d: str) -> DataFrame:
    """Z4, Z5."""
    return access.sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", idle=access.IDLE * 24).select("event_id", "session", "opened")


QUERIES = {
    f.__name__: f
    for f in (
        ai_label, ai_label_fusion, statistical_likelihood, ocr_gate, region_routing, fusion_decision, permission_matrix, teacher_scope, orders_in_scope, token_purge, rate_limit_decisions, rate_limit_resets, rate_limits_cleared, session_validity,
    )
}
_E = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
_LABEL = "CASE WHEN {0} > 70 THEN 'AI-generated' WHEN {0} < 30 THEN 'Original' ELSE 'Mixed' END"
_NEAR = "CASE WHEN a >= 0.85 THEN least(0.99::DOUBLE, own + 0.05 * a) WHEN a < 0.40 THEN greatest(0.20::DOUBLE, own - 0.15 * (1 - a)) ELSE own END"
SQL = {
    "ai_label": f"""{_E} SELECT event_id, CASE WHEN event_id % 60 + 40 < 50 THEN 0.0 ELSE round(k / 100 * 100, 2) END AS ai_score,
        CASE WHEN event_id % 60 + 40 < 50 THEN 'Original' ELSE {_LABEL.format("(k / 100 * 100)")} END AS label, CASE WHEN event_id % 60 + 40 < 50 THEN 0.0 ELSE round(abs(k / 100 - 0.5) * 2, 2) END AS confidence FROM e""",
    "ai_label_fusion": f"""{_E}, s AS (SELECT event_id, least(value, 100.0::DOUBLE) AS st, k::DOUBLE AS se, k / 100 AS c, event_id % 3 = 0 AND event_id % 2 = 0 AND least(value, 100.0) > 80 AS o FROM e),
        m AS (SELECT *, st * 0.6::DOUBLE + se * 0.4::DOUBLE AS mixed, abs(st - se) > 40 AS apart FROM s), f AS (SELECT *, CASE WHEN apart THEN 50 + (mixed - 50) * 0.5 ELSE mixed END AS score FROM m)
        SELECT event_id, round(CASE WHEN o THEN greatest(score, 85.0::DOUBLE) ELSE score END, 6) AS ai_score, CASE WHEN o THEN 'AI-generated' WHEN apart THEN 'Mixed' ELSE {_LABEL.format("mixed")} END AS label,
            round(CASE WHEN apart THEN least(c, 0.5::DOUBLE) * 0.5 ELSE (c + 0.5) / 2 END, 4) AS confidence, CASE WHEN apart THEN 'disagreement' ELSE 'agreement' END AS basis FROM f""",
    "statistical_likelihood": f"""{_E}, s AS (SELECT event_id, CASE WHEN value < 18 THEN 85.0::DOUBLE WHEN value > 50 THEN 15.0::DOUBLE ELSE 85 - (value - 18) * (70.0::DOUBLE / 32) END AS p,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - k / 100 / 0.8::DOUBLE)) AS u FROM e), t AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, p * 0.4::DOUBLE + u * 60)) AS l FROM s)
        SELECT event_id, round(l, 6) AS likelihood, round(u, 4) AS uniformity, CASE WHEN u > 0.65 THEN 'uniform' WHEN u < 0.35 THEN 'irregular' ELSE 'mixed' END AS pattern,
            CASE WHEN l > 70 THEN 'high' WHEN l > 40 THEN 'moderate' ELSE 'low' END AS risk FROM t""",
    "ocr_gate": f"""{_E} SELECT event_id, k < 50 AND event_id % 25 < 15 AS rejected, CASE WHEN k >= CASE WHEN event_id % 2 = 0 THEN 60 ELSE 65 END THEN 'good' ELSE 'low' END AS status,
        CASE WHEN event_id % 25 >= 15 THEN 96.0 WHEN event_id % 25 >= 5 THEN 85.0 ELSE 50.0 END::DOUBLE AS confidence FROM e""",
    "region_routing": f"""{_E} SELECT CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'COMPLEX' WHEN k / 100 < 0.60 OR value / 500 > 0.45 OR value < 15 THEN 'UNCERTAIN' ELSE 'NORMAL' END AS category,
        CASE WHEN event_id % 7 = 0 THEN 'TABLE' WHEN event_id % 5 = 0 THEN 'FORMULA' ELSE 'TEXT' END AS kind, count(*) AS n FROM e GROUP BY 1, 2""",
    "fusion_decision": rf"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS x, p_size / 50 AS cx, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 11 <> 0 THEN p_name END WHEN p_partkey % 13 <> 0 THEN p_type END AS y FROM part),
        v AS (SELECT *, lower(trim(coalesce(x, ''))) AS lx, lower(trim(coalesce(y, ''))) AS ly FROM r),
        l AS (SELECT *, CASE WHEN greatest(length(lx), length(ly)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(lx, ly) / greatest(length(lx), length(ly)) END AS a, regexp_matches(y, '[\\^_{{|]') AS marked FROM v),
        b AS (SELECT *, CASE WHEN y IS NULL THEN true WHEN x IS NULL THEN false WHEN a >= 0.82 THEN cx >= 0.75 WHEN marked THEN false ELSE cx >= 0.75 END AS by_line FROM l),
        o AS (SELECT *, CASE WHEN by_line THEN cx ELSE 0.75 END AS own FROM b),
        c AS (SELECT *, round(CASE WHEN x IS NULL OR y IS NULL THEN own WHEN NOT by_line AND marked THEN least(0.99::DOUBLE, {_NEAR} + 0.04) ELSE {_NEAR} END, 3) AS sure FROM o)
        SELECT p_partkey, CASE WHEN by_line THEN x ELSE y END AS text, sure AS confidence, CASE WHEN by_line THEN 'line' ELSE 'page' END AS model,
            coalesce(x IS NOT NULL AND y IS NOT NULL AND a < 0.60, false) OR sure < 0.70 AS needs_review FROM c""",
    "teacher_scope": """WITH {teachers}, k AS (SELECT o_orderpriority, c_mktsegment, count(*) AS orders, min(o_orderkey) AS first_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT k.*, s_suppkey FROM k, (SELECT DISTINCT s_suppkey FROM m) t WHERE EXISTS (SELECT 1 FROM m WHERE m.s_suppkey = t.s_suppkey AND {inside})""",
    "orders_in_scope": """WITH {teachers} SELECT o_orderkey, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE EXISTS (SELECT 1 FROM m WHERE mapping LIKE '%,%' AND length(subject) > 3 AND length(section) > 5 AND {inside})""",
    "token_purge": f"""SELECT event_id, CASE WHEN value > 50 THEN 'used' WHEN TIMESTAMP '{NOW}' > ts + INTERVAL 10 DAY THEN 'expired' ELSE 'valid' END AS state,
        ts + INTERVAL 10 DAY < TIMESTAMP '{NOW}' - INTERVAL 7 DAY OR (value > 50 AND ts + INTERVAL 5 HOUR < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS purge FROM events""",
}
_HELD = ", ".join(f"('{r}', '{p}')" for r, held in access.ROLES.items() for p in held)
_WANTED = "list_sort(list_distinct(list_concat(['user:delete:all'], (SELECT list(permission) FROM held))))"
SQL["permission_matrix"] = f"""WITH held(role, permission) AS (VALUES {_HELD}), w AS (SELECT {_WANTED} AS w),
    u AS (SELECT c_custkey, [{", ".join(f"'{r}'" for r in [*access.ROLES, "guest"])}, NULL][c_custkey % {len(access.ROLES) + 2} + 1] AS role, w[c_custkey // {len(access.ROLES) + 2} % len(w) + 1] AS permission FROM customer, w)
    SELECT *, EXISTS (SELECT 1 FROM held h WHERE h.role = u.role AND h.permission IN ('*', u.permission)) AS allowed, coalesce(role IN ({", ".join(f"'{r}'" for r in access.STAFF)}), false) AS staff FROM u"""
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TEACHERS = f"""p AS (SELECT s_suppkey AS k, substr({_LIST(SUBJECTS)}[s_suppkey % 5 + 1], 3, s_suppkey % 6 + 1) AS a, substr({_LIST(SECTIONS)}[s_suppkey * 3 % 5 + 1], s_suppkey % 3 + 1, s_suppkey % 7) AS b,
        ' ' || {_LIST(SUBJECTS)}[(s_suppkey + 2) % 5 + 1] || ' course' AS c, CASE WHEN s_suppkey % 4 <> 0 THEN 'the ' || {_LIST(SECTIONS)}[s_suppkey % 5 + 1] || 's' END AS d FROM supplier),
    j AS (SELECT k, '{{"subject":"' || a || '","section":"' || b || '"}}' AS one, '{{"subject":"' || c || '"' || coalesce(',"section":"' || d || '"', '') || '}}' AS two FROM p),
    t AS (SELECT k AS s_suppkey, CASE WHEN k % 11 = 0 THEN '{{oops' WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '[]' WHEN k % 19 = 0 THEN two WHEN k % 2 = 0 THEN '[' || one || ',' || two || ']' ELSE '[' || one || ']' END AS mapping FROM j),
    e AS (SELECT s_suppkey, mapping, unnest(CASE WHEN json_type(mapping) = 'ARRAY' THEN CAST(json(mapping) AS JSON[]) ELSE [json(mapping)] END) AS x FROM t WHERE json_valid(mapping)),
    m AS (SELECT s_suppkey, mapping, lower(trim(coalesce(json_extract_string(x, '$.subject'), ''))) AS subject, lower(trim(coalesce(json_extract_string(x, '$.section'), ''))) AS section FROM e)"""
_INSIDE = "(section = '' OR contains(section, lower(c_mktsegment)) OR contains(lower(c_mktsegment), section)) AND (contains(subject, lower(o_orderpriority)) OR contains(lower(o_orderpriority), subject))"
for _name in ("teacher_scope", "orders_in_scope"):
    SQL[_name] = SQL[_name].replace("{teachers}", _TEACHERS).replace("{inside}", _INSIDE)


def limits_sql(events: str, key: str, most: int, seconds: int, name: str, reset: str = "false", epoch: str = "0") -> str:
    """Common table expressions that end with `name` (event_id, limited, retry_after): each key's requests in order, with the times that count."""
    return f"""{name}_o AS (SELECT event_id, {key} AS key, epoch_us(ts) / 1000000 AS sec, {reset} AS reset, {epoch} AS epoch, row_number() OVER (PARTITION BY {key} ORDER BY ts, {reset}, event_id) AS k FROM {events}),
        {name}_s AS (SELECT key, 0::BIGINT AS k, []::DOUBLE[] AS kept, NULL::BIGINT AS event_id, false AS limited, NULL::BIGINT AS retry_after, 0::BIGINT AS epoch FROM (SELECT DISTINCT key FROM {name}_o)
            UNION ALL SELECT key, k, CASE WHEN reset THEN [] WHEN len(live) >= {most} THEN live ELSE list_append(live, sec) END, event_id, CASE WHEN NOT reset THEN len(live) >= {most} END,
                CASE WHEN NOT reset AND len(live) >= {most} THEN greatest(1, CAST(floor(live[1] + {seconds} - sec) AS BIGINT) + 1) END, epoch
            FROM (SELECT o.key, o.k, o.sec, o.event_id, o.reset, o.epoch, CASE WHEN o.epoch <> s.epoch THEN [] ELSE list_filter(s.kept, lambda x: x > o.sec - {seconds}) END AS live FROM {name}_s s JOIN {name}_o o ON o.key = s.key AND o.k = s.k + 1)),
        {name} AS (SELECT event_id, limited, retry_after FROM {name}_s WHERE event_id IS NOT NULL)"""


_MOST, _SECONDS = access.POLICIES["resend_verification"]
SQL["rate_limit_decisions"] = f"WITH RECURSIVE {limits_sql('events', 'user_id', _MOST, _SECONDS * 40, 'one')} SELECT * FROM one"
SQL["session_validity"] = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, k, event_id, sec AS since, sec AS last, 1::BIGINT AS session, true AS opened FROM o WHERE k = 1
        UNION ALL SELECT user_id, k, event_id, CASE WHEN fresh THEN sec ELSE since END, sec, session + CASE WHEN fresh THEN 1 ELSE 0 END, fresh
        FROM (SELECT o.*, s.since, s.session, o.sec - s.last > {access.IDLE * 24} OR o.sec - s.since > {access.ABSOLUTE} AS fresh FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1))
    SELECT event_id, session, opened FROM s"""
_RESET = "event_type = 'purchase'"
SQL["rate_limit_resets"] = f"WITH RECURSIVE {limits_sql('events', 'user_id', _MOST, _SECONDS * 40, 'one', reset=_RESET)} SELECT * FROM one"
_EPOCH = " + ".join(f"CASE WHEN ts > TIMESTAMP '{x}' THEN 1 ELSE 0 END" for x in CLEARED)
SQL["rate_limits_cleared"] = f"WITH RECURSIVE {limits_sql('events', 'user_id', _MOST, _SECONDS * 40, 'one', epoch=_EPOCH)} SELECT * FROM one"
