"""Queries over rewrites of tables, corpus statistics and relevance, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import models, writes
from veritrail.sources.catalog import table

KEYWORDS = {"src0": ("tion", "the", "und"), "src1": ("for", "xyz", "para"), "src2": ("que", "heit")}


def upsert_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the documents of one source are set anew, and missing ones come in."""
    fresh = table(spark, d, "documents").where("source = 'src1'").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return writes.upserted(table(spark, d, "labels").withColumns({"quality": F.col("quality").cast("int"), "toxic": F.col("toxic").cast("int")}), fresh, "doc_id")


def guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment go, but for those in debt."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return writes.deleted(c, c.where("c_mktsegment = 'BUILDING'"), "c_custkey", guard=F.col("c_acctbal") < 0)


def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    """U3, U4, U6."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return writes.updated(o, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100_000), o_orderstatus=F.lit("P"))[0]


def lock_receipts(spark: SparkSession, d: str) -> DataFrame:
    """U7, V3."""
    e = table(spark, d, "events").select(F.col("event_id").alias("submission_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), (F.col("event_id") % 5 == 0).alias("is_locked"), F.lit(None).cast("string").alias("verification_token"), "ts")
    got = writes.locked(e, e.where("submission_id % 2 = 0"), F.col("ts"), F.md5(F.col("submission_id").cast("string")))
    return got.select("submission_id", "is_locked", "verification_token")


def bigram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """N1's stand-in."""
    return models.perplexity(models.bigram_losses(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id").select("doc_id", "mean_token_loss", "greatest")


def subject_relevance(spark: SparkSession, d: str) -> DataFrame:
    """X21."""
    keywords = spark.createDataFrame([(s, k) for s, ks in KEYWORDS.items() for k in ks], "subject string, keyword string")
    return models.subject_relevance(table(spark, d, "documents"), keywords, "doc_id", "source", "text")


QUERIES = {f.__name__: f for f in (upsert_labels, guarded_delete, conditional_update, lock_receipts, bigram_perplexity, subject_relevance)}
_K = ", ".join(f"('{s}', '{k}')" for s, ks in KEYWORDS.items() for k in ks)
SQL = {
    "upsert_labels": """SELECT doc_id, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')
        UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE source = 'src1'""",
    "guarded_delete": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal < 0",
    "conditional_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "lock_receipts": """WITH e AS (SELECT event_id AS id, event_type <> 'error' AND event_id % 5 <> 0 AND event_id % 2 = 0 AS hit, ts FROM events)
        SELECT id AS submission_id, hit OR id % 5 = 0 AS is_locked, CASE WHEN hit THEN printf('PLAG-SEC-%04d-', id) || strftime(ts, '%Y%m%d') || '-' || upper(left(md5(CAST(id AS VARCHAR)), 8)) END AS verification_token FROM e""",
    "bigram_perplexity": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS ab FROM t WHERE len(w) > 1),
        c AS (SELECT ab, count(*) AS nab FROM p GROUP BY 1), a AS (SELECT ab[1] AS a, sum(nab) AS na FROM c GROUP BY 1), v AS (SELECT count(DISTINCT x) AS v FROM (SELECT unnest(w) AS x FROM t)),
        l AS (SELECT ab, -ln((nab + 1) / (na + v)) AS loss FROM c JOIN a ON ab[1] = a.a, v)
        SELECT doc_id, round(avg(loss), 4) AS mean_token_loss, round(max(loss), 4) AS greatest FROM p JOIN l USING (ab) GROUP BY 1""",
    "subject_relevance": f"""WITH k(subject, keyword) AS (VALUES {_K}), n AS (SELECT subject, count(*) AS n FROM k GROUP BY 1),
        h AS (SELECT doc_id, source, text, n, (SELECT count(*) FROM k WHERE k.subject = source AND contains(lower(text), keyword)) AS hits FROM documents LEFT JOIN n ON n.subject = source),
        s AS (SELECT doc_id, n, CASE WHEN n IS NULL OR length(trim(text)) < 50 THEN NULL ELSE CAST(hits AS INT) END AS hits FROM h)
        SELECT doc_id, hits, CASE WHEN hits IS NULL THEN 1.0 WHEN hits >= 2 THEN round(least(1.0::DOUBLE, hits / n), 4) ELSE 0.8 END AS confidence FROM s""",
}
