"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, centroids, conversations, decontaminate, language_id, minhash, ngram_join, quality_model, quality_rules, secrets, sharding, token_files, warc
from veritrail.sources.catalog import table, work_dir

WORD_BPE, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN, keep=False)
    both = bpe.decode(ids, BYTE_RANKS)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    number = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*(r.kind for r in secrets.BASE)))
    return found.select(
        "doc_id", *(number(r.kind) for r in secrets.BASE),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals that together are the table, then compaction; the rows as the last version's shards hold them."""
    docs, at, arrivals = table(spark, sf_dir, "documents"), work_dir(spark, "shards"), 4
    for k in range(arrivals):
        sharding.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(arrivals)) == k), at, k)
    sharding.settle(spark, at)
    sharding.vacuum(spark, at)
    return sharding.read(spark, at).select("doc_id", F.col("_arrival").alias("arrival"), "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "warc")
    archives = warc.write(warc.classified(table(spark, sf_dir, "pages")), out)
    warc.normalise(archives, out)
    return warc.read(spark, archives, out).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _fold(parts: int):
    """The remainder that folds are made by; a row without id counts as one with an empty id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_fold(5) != 0))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").where(_fold(4) != 2))
    found = quality_model.score(docs, model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "tokens")
    shards = token_files.write(table(spark, sf_dir, "documents"), out, WORD_BPE, END_ID)
    return token_files.read(spark, out, shards).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"quality_rules.figures.{c}").alias(c) for c in base), "quality_rules.base_failed", "quality_rules.kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), present="present")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_sharding, op4_warc, op5_decontaminate, op6_language_id, op7_quality_model, op8_token_files, op9_ngram_join, op10_quality_rules, op11_conversation_repair, op12_minhash_dedup, op13_centroid_clusters)}


def _similar_sql(width: int, percent: int, more: str = "") -> str:
    """All pairs of shingle sets that share a shingle, those that link, and what links reach."""
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS shingles FROM w
        ),
        n AS (SELECT doc_id, len(shingles) AS n FROM s),
        u AS (SELECT doc_id, unnest(shingles) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
        ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
        least AS (SELECT node, min(other) AS least FROM reach GROUP BY 1)
        SELECT doc_id, n AS n_shingles, coalesce(least, doc_id) AS component_id{more} FROM n LEFT JOIN least ON node = doc_id
    """


def _clusters_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS, width: int = centroids.WIDTH) -> str:
    """Each round as two common tables: the nearest centroid of each vector, and the centroids after it."""
    far = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    steps = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT r, min((CAST({far} AS BIGINT), c)) AS near FROM kept k, c{n} c GROUP BY r)")
        if n < rounds:
            steps.append(f"""t{n} AS (SELECT near[2] AS c, unnest(range(1, {width + 1})) AS i, unnest(v) AS x FROM a{n} JOIN kept USING (r)),
        m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM t{n} GROUP BY c, i), f{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{n} GROUP BY c),
        c{n + 1} AS (SELECT c, coalesce(f.v, o.v) AS v FROM c{n} o LEFT JOIN f{n} f USING (c))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(near[2] AS INTEGER) AS cluster, near[1] AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
            CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = near[2]"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clusters": _clusters_sql(),
    "op3_sharding": """
        SELECT doc_id, (coalesce(doc_id, 0) % 4 + 4) % 4 AS arrival, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5
        FROM documents
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS least FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN least IS NULL OR least IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN least IS NULL OR least IS NOT DISTINCT FROM page_id THEN NULL ELSE least END AS refers_to
        FROM h LEFT JOIN f USING (payload_digest)
    """,
    "op9_ngram_join": _similar_sql(ngram_join.WIDTH, ngram_join.PERCENT),
    "op12_minhash_dedup": _similar_sql(minhash.WIDTH, minhash.PERCENT, ", coalesce(least, doc_id) = doc_id AS kept"),
    "op10_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ),
        places AS (
            SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i, words FROM w
        ),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM places),
        again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        reach AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM again),
        repeated AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM reach GROUP BY doc_id),
        m AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                length(text) - length(replace(text, '!', '')) AS n_shouts, len(lines) AS n_lines,
                len(list_filter(string_split_regex(lower(translate(text, '.,;:!?', '')), '[\x20\x09-\x0D]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))}))) AS n_stop,
                len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes,
                len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]|(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_marks
            FROM w LEFT JOIN repeated USING (doc_id)
        ),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words AND n_shouts <= 0.5 * n_words
                AND n_stop + 1 >= 0.01 * n_words AND n_echoes <= 0.3 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_marks <= 0.9 * n_lines AS kept
        FROM b
    """.replace("\\\\", "\\"),
}
