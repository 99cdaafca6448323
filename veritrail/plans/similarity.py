"""Queries over similarity and rings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import fixed
from veritrail.operators import peers, rings, similarity
from veritrail.plans.text import _STRIP as STRIP
from veritrail.sources import stand_ins


def _submissions(spark: SparkSession, d: str, students: int) -> DataFrame:
    return stand_ins.submissions(spark, d, students).withColumn("visual_hash", F.md5(F.col("text").cast("binary")))


def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one subject above the threshold."""
    docs = _submissions(spark, d, 397)
    found = similarity.linked(docs, "subject", "submission_id", "text", similarity.PAIR_TERMS, similarity.EDGE)
    return found.select("subject", "a", "b", F.round("cosine", 6).alias("cosine"))


def peer_similarity_max(spark: SparkSession, d: str) -> DataFrame:
    """Each submission against other students' of its subject, fitted to it and these."""
    return peers.scores(_submissions(spark, d, 33), "subject", "submission_id", "student_id", "text")


def visual_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """G5, J9, J10, V9 by equality."""
    return similarity.visual_duplicates(_submissions(spark, d, 33), "visual_hash", "submission_id", "student_id")


def collusion_edges(spark: SparkSession, d: str) -> DataFrame:
    """G6, A20."""
    return rings.edges(_submissions(spark, d, 397)).select("src", "dst", F.round("weight", 6).alias("weight"))


def collusion_rings(spark: SparkSession, d: str) -> DataFrame:
    """G7, G8, A21."""
    return rings.rings(rings.edges(_submissions(spark, d, 397)))[0]


def ring_members(spark: SparkSession, d: str) -> DataFrame:
    """G7."""
    return rings.rings(rings.edges(_submissions(spark, d, 397)))[1]


QUERIES = {f.__name__: f for f in (pairwise_similarity, peer_similarity_max, visual_duplicates, collusion_edges, collusion_rings, ring_members)}


def _tokens(students: int, bigrams: bool, where: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
    terms = "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))" if bigrams else "tokens"
    return rf"""{stand_ins.submissions_sql(students)},
        k AS (SELECT subject, submission_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop})) AS tokens FROM submissions WHERE {where}),
        t AS (SELECT subject, id, unnest({terms}) AS term FROM k), tf AS (SELECT subject, id, term, count(*) AS tf FROM t GROUP BY ALL)"""


def _weights(students: int, bigrams: bool, cap: int, where: str = "true") -> str:
    return rf"""{_tokens(students, bigrams, where)},
        known AS (SELECT subject, term, count(*) AS df FROM tf GROUP BY subject, term QUALIFY row_number() OVER (PARTITION BY subject ORDER BY sum(tf) DESC, term) <= {cap}),
        size AS (SELECT subject, count(*) AS n FROM k GROUP BY 1), raw AS (SELECT subject, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN known USING (subject, term) JOIN size USING (subject)),
        weights AS (SELECT subject, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM raw),
        pairs AS (SELECT a.subject, a.id AS a, b.id AS b, sum(a.x * b.x) AS cosine FROM weights a JOIN weights b ON a.subject = b.subject AND a.term = b.term AND a.id < b.id GROUP BY ALL)"""


_EDGES = f"""WITH RECURSIVE {_weights(397, False, similarity.PAIR_TERMS, f"length({STRIP.format('text')}) > {similarity.LEAST_LENGTH}")},
    s AS (SELECT submission_id, student_id FROM submissions), h AS (SELECT DISTINCT md5(text) AS hash, student_id, subject FROM submissions WHERE text IS NOT NULL),
    every AS (SELECT x.student_id AS p, y.student_id AS q, round(cosine, 9) AS cosine, subject FROM pairs JOIN s x ON x.submission_id = a JOIN s y ON y.submission_id = b WHERE round(cosine, 9) > 0.3
        UNION ALL SELECT min(student_id) OVER (PARTITION BY hash), student_id, 1.0, subject FROM h),
    edges AS (SELECT least(p, q) AS src, greatest(p, q) AS dst, max(cosine) AS weight, max_by(subject, (cosine, subject)) AS subject FROM every WHERE p <> q GROUP BY 1, 2)"""
_MEMBERS = f"""{_EDGES}, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
    member AS (SELECT node, min(other) AS component FROM reach GROUP BY 1), number AS (SELECT component, printf('RING-%02d', row_number() OVER (ORDER BY component)) AS ring FROM member GROUP BY 1)"""
SQL = {
    "pairwise_similarity": f"WITH {_weights(397, False, similarity.PAIR_TERMS)} SELECT subject, a, b, round(cosine, 6) AS cosine FROM pairs WHERE round(cosine, 9) > 0.3",
    "peer_similarity_max": f"""WITH {_tokens(33, True, "text <> ''")},
        s AS (SELECT submission_id AS id, student_id, subject, length({STRIP.format("text")}) >= {peers.LEAST_LENGTH} AS compared FROM submissions WHERE text <> ''),
        corpus AS (SELECT a.id AS target, b.id FROM s a JOIN s b ON a.subject = b.subject AND (a.id = b.id OR a.student_id <> b.student_id) WHERE a.compared),
        size AS (SELECT target, count(*) AS n FROM corpus GROUP BY 1), every AS (SELECT target, id, term, tf FROM corpus JOIN tf USING (id)),
        known AS (SELECT target, term, count(*) AS df FROM every GROUP BY target, term QUALIFY row_number() OVER (PARTITION BY target ORDER BY sum(tf) DESC, term) <= {peers.TERMS}),
        raw AS (SELECT target, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM every JOIN known USING (target, term) JOIN size USING (target)),
        norm AS (SELECT target, id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1, 2),
        dot AS (SELECT a.target, b.id, sum(a.w * b.w) AS dot FROM raw a JOIN raw b ON a.target = b.target AND a.term = b.term AND a.id = a.target AND b.id <> a.target GROUP BY 1, 2),
        best AS (SELECT target AS id, max(dot / x.norm / y.norm) AS most, count(*) FILTER (round(dot / x.norm / y.norm, 9) > {peers.MATCH}) AS matches
            FROM dot JOIN norm y USING (target, id) JOIN (SELECT target, norm FROM norm WHERE id = target) x USING (target) GROUP BY 1)
        SELECT submission_id, round(100 * coalesce(most, 0), 2) AS similarity_score, round(coalesce(most, 0), 4) AS max_similarity, coalesce(matches, 0) AS matches FROM submissions LEFT JOIN best ON id = submission_id""",
    "visual_duplicates": f"""WITH {stand_ins.submissions_sql(33)} SELECT submission_id,
        coalesce(min(student_id) OVER (PARTITION BY text) <> max(student_id) OVER (PARTITION BY text), false) AND text IS NOT NULL AS duplicate FROM submissions""",
    "collusion_edges": f"{_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "collusion_rings": f"""{_MEMBERS}, n AS (SELECT component, count(*) AS students FROM member GROUP BY 1),
        l AS (SELECT component, count(*) AS links, round(100 * max(weight), 1) AS max_similarity, array_to_string(list_sort(list_distinct(list(subject))), ',') AS subjects FROM edges JOIN member ON node = src GROUP BY 1)
        SELECT ring, students, links, max_similarity, subjects FROM number JOIN n USING (component) JOIN l USING (component)""",
    "ring_members": f"{_MEMBERS} SELECT ring, node AS student_id FROM member JOIN number USING (component)",
}
