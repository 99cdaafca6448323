"""Queries over training data and evaluation, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import fixed
from veritrail.functions.text import let, stripped, tag_shares, words
from veritrail.operators import features, forest, models, training
from veritrail.plans import text
from veritrail.sources import readers
from veritrail.sources.catalog import table, work_dir

FEATURES = features.FEATURES


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text"), table(spark, d, "labels")
    return docs.join(labels, "doc_id")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The 18 features of labelled essays; what a language model gives is counted over all of them."""
    essays, known = text.essays(spark, d), _labelled(spark, d).select("doc_id", "source", "quality")
    return features.all_features(essays.join(known, "doc_id", "left_semi"), "doc_id", "text", models.bigram_losses(essays, "doc_id", "text")).join(known, "doc_id")


def all_features(spark: SparkSession, d: str) -> DataFrame:
    """X15."""
    return features.all_features(text.essays(spark, d), "doc_id", "text")


def feature_map(spark: SparkSession, d: str) -> DataFrame:
    """How many features each document's map holds, and one of them."""
    found = features.as_map(features.all_features(text.essays(spark, d), "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.size("features").alias("n"), F.element_at("features", "type_token_ratio").alias("type_token_ratio"))


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Five rows as if at random."""
    return training.sampled(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5)


def class_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return training.class_ratio(table(spark, d, "labels"), "quality")


def undersample_counts(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, A8, T9."""
    kept = training.undersampled(_labelled(spark, d).select("doc_id", "source", "quality"), "quality", "source", "doc_id")
    return kept.groupBy("quality", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """M4, D5."""
    return training.group_split(table(spark, d, "documents").select("doc_id", "source"), "source").groupBy("part", "source").agg(F.count("*").alias("n"))


def standardise(spark: SparkSession, d: str) -> DataFrame:
    """M5, A12."""
    e = training.standardised(table(spark, d, "events").select("event_id", "value"), ["value"])
    return e.select("event_id", F.round("value", 6).alias("value"))


def impute(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh value is missing and every thirteenth infinite."""
    id, nan, inf = F.col("event_id"), F.lit(float("nan")), F.lit(float("inf"))
    e = table(spark, d, "events").select("event_id", F.when(id % 11 == 0, nan).when(id % 13 == 0, inf).otherwise(F.col("value")).alias("value"))
    return training.imputed(e, ["value"])


def class_means_top5(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    top = training.class_differences(_features(spark, d), "quality", FEATURES)
    return top.select("feature", *(F.round(c, 4).alias(c) for c in ("mean_0", "mean_1", "difference")))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Short texts as the prediction."""
    y = _labelled(spark, d).withColumn("predicted", F.when(F.col("n_chars") > 1000, 1).otherwise(0))
    return training.passes_gates(training.confusion(y, "quality", "predicted"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    return training.auc(_labelled(spark, d), "quality", "n_chars")


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    """A14, S7."""
    return training.roc(_labelled(spark, d), "quality", "n_chars")


#: What a session has built for a folder of tables, so that queries that share it build it once: places of tables and models.
_BUILT: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        at = work_dir(spark, name)
        build(at)
        _BUILT[key] = at
    return _BUILT[key]


def _split(spark: SparkSession, d: str) -> DataFrame:
    """The features of labelled essays, with the part that each source is of."""
    at = _once(spark, d, "features", lambda at: training.group_split(_features(spark, d), "source").write.parquet(at))
    return spark.read.parquet(at)


def _forest(spark: SparkSession, d: str, columns: list[str] = FEATURES):
    """The model as it is stored, loaded again."""
    split = _split(spark, d)
    at = _once(spark, d, f"forest-{len(columns)}", lambda at: readers.save_model(training.train_forest(split.where("part = 'train'"), columns, "quality"), at))
    return readers.load_model(at), split


def rf_train_eval(spark: SparkSession, d: str) -> DataFrame:
    """M6, M7: trained on some sources, measured on the others."""
    model, split = _forest(spark, d)
    return training.passes_gates(training.confusion(training.scored(model, split.where("part = 'test'")), "quality", "prediction"))


def rf_importances(spark: SparkSession, d: str) -> DataFrame:
    """M8: the features by importance."""
    found = training.importances(_forest(spark, d)[0], FEATURES)
    return spark.createDataFrame([(k + 1, *x) for k, x in enumerate(found)], "place int, feature string, importance double")


def rf_online_scores(spark: SparkSession, d: str) -> DataFrame:
    """M9: a stored model, loaded again, scores held-out documents by its table of splits."""
    model, split = _forest(spark, d)
    found = forest.scored(split.where("part = 'test'"), forest.exported(spark, model), FEATURES, training.DEPTH)
    return found.select("doc_id", F.round("probability_1", 4).alias("ai_probability"), F.round(100 * F.col("probability_1"), 2).alias("ai_score"))


def legacy_forest(spark: SparkSession, d: str) -> DataFrame:
    """The classifier of three features."""
    model, split = _forest(spark, d, FEATURES[:3])
    return training.confusion(training.scored(model, split.where("part = 'test'")), "quality", "prediction")


#: A forest made by a rule, for scores that SQL gives as well: trees, their depth, and rows (tree, node, feature, threshold, left, right, zeros, ones).
RULE_TREES, RULE_DEPTH = 9, 3


def _rule_forest(features: int) -> list[tuple]:
    inner, every = 2**RULE_DEPTH - 1, 2 ** (RULE_DEPTH + 1) - 1
    split = lambda t, i: ((t * 5 + i * 3) % features, ((t * 7 + i * 5) % 11 - 5) / 4 + 0.0137, 2 * i + 1, 2 * i + 2) if i < inner else (-1, None, -1, -1)
    return [(t, i, *split(t, i), (t * 3 + i * 7) % 10 + 1.37, (t * 11 + i * 13) % 10 + 1.11) for t in range(RULE_TREES) for i in range(every)]


def _scored_by_rule(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    essays = text.essays(spark, d)
    length = essays.select("doc_id", F.length(stripped(F.col("text"))).alias("length"))
    found = features.all_features(essays, "doc_id", "text").select("doc_id", *columns).join(length, "doc_id")
    return forest.online(found, spark.createDataFrame(_rule_forest(len(columns)), forest.SPLITS), columns, RULE_DEPTH, "length").drop("length")


def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    """M7, M9: scaled features, scores of a forest given as a table, the gate for short texts, label and confidence."""
    return _scored_by_rule(spark, d, FEATURES)


def legacy_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same with the three features of a language model."""
    return _scored_by_rule(spark, d, FEATURES[:3])


def tagged_features(spark: SparkSession, d: str) -> DataFrame:
    """Shares of tags that a tagger gave; here words' endings stand for it."""
    tokens = words(F.lower("text"))
    tag = lambda w: F.when(w.endswith("ing"), "VERB").when(w.endswith("ed"), "ADJ").when(w.startswith("th"), "PROPN").when(F.length(w) > 6, "NOUN").otherwise("X")
    of = lambda t: F.struct(*(F.round(c.cast("double"), 4).alias(name) for name, c in tag_shares(F.transform(t, tag), F.size(F.filter(t, lambda w: F.length(w) > 9))).items()))
    # the words are bound once; what only the text gives isn't asked for
    return text.essays(spark, d).select("doc_id", let(tokens, of).alias("s")).select("doc_id", "s.*")


def sampled_fraction(spark: SparkSession, d: str) -> DataFrame:
    """T9 by share."""
    return training.sampled_fraction(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.013)


def sentence_burstiness(spark: SparkSession, d: str) -> DataFrame:
    """Losses by sentence."""
    return models.sentence_statistics(text.essays(spark, d), "doc_id", "text")


QUERIES = {f.__name__: f for f in (sampled_rows, class_ratio, undersample_counts, group_split, standardise, impute, class_means_top5, confusion_metrics, roc_auc, roc_curve, all_features, feature_map, rf_train_eval, rf_importances, rf_online_scores, legacy_forest, forest_scores, legacy_scores, tagged_features, sampled_fraction, sentence_burstiness)}
_L = "WITH l AS (SELECT doc_id, source, n_chars, text, quality, toxic FROM documents JOIN labels USING (doc_id))"
_DRAW = "md5({} || ':42')"
_COUNTS = "count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 0 AND n_chars <= 1000) AS tn, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn"


_PHRASED = f"""WITH {text._BOUND} SELECT doc_id, round(least(1.0::DOUBLE, {text._hits(fixed.GENERIC_PHRASES)} * 10 / n), 4) AS generic_phrasing,
    round(greatest(0.0::DOUBLE, 1 - {text._hits(fixed.PERSONAL_VOICE)} * 5 / n), 4) AS lack_of_personal_voice, round(least(1.0::DOUBLE, {text._hits(fixed.TRANSITIONS)} * 15 / n), 4) AS over_structured_coherence FROM w"""
_MODEL = rf"""WITH {text._ESSAYS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM essays), p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS ab FROM t WHERE len(w) > 1),
    c AS (SELECT ab, count(*) AS nab FROM p GROUP BY 1), a AS (SELECT ab[1] AS a, sum(nab) AS na FROM c GROUP BY 1), v AS (SELECT count(DISTINCT x) AS v FROM (SELECT unnest(w) AS x FROM t)),
    l AS (SELECT ab, -ln((nab + 1) / (na + v)) AS loss FROM c JOIN a ON ab[1] = a.a, v)
    SELECT doc_id, round(exp(least(avg(loss), 50)), 2) AS mean_perplexity, round(coalesce(var_samp(loss), 0), 4) AS perplexity_variance, round(avg(loss), 4) AS entropy FROM p JOIN l USING (ab) GROUP BY 1"""
_ALL = f"""s AS ({text.SQL["stylometric_11"]}), e AS ({text.SQL["flesch_manual"]}), ph AS ({_PHRASED}), lm AS ({_MODEL}),
    x AS (SELECT doc_id, {", ".join(f"coalesce({c}, {features.WITHOUT_MODEL[c]}) AS {c}" if c in features.WITHOUT_MODEL else c for c in FEATURES)} FROM s JOIN e USING (doc_id) JOIN ph USING (doc_id) LEFT JOIN lm USING (doc_id))"""


def _means() -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) FILTER (quality = 0) AS mean_0, avg(CAST({c} AS DOUBLE)) FILTER (quality = 1) AS mean_1 FROM figures" for c in FEATURES)
    return f"""WITH {_ALL}, figures AS (SELECT x.*, quality FROM x JOIN labels USING (doc_id)), m AS ({parts})
        SELECT feature, round(mean_0, 4) AS mean_0, round(mean_1, 4) AS mean_1, round(abs(mean_0 - mean_1), 4) AS difference FROM m ORDER BY abs(mean_0 - mean_1) DESC, feature LIMIT 5"""


def _rule_scores(columns: list[str]) -> str:
    rows = ", ".join(f"({t}, {i}, {f}, {'NULL' if x is None else x}::DOUBLE, {lo}, {hi}, {a}::DOUBLE, {b}::DOUBLE)" for t, i, f, x, lo, hi, a, b in _rule_forest(len(columns)))
    steps = ", ".join(f"s{k + 1} AS (SELECT doc_id, z, tree, CASE WHEN lo < 0 THEN node WHEN z[feature + 1] <= threshold THEN lo ELSE hi END AS node FROM s{k} JOIN f USING (tree, node))" for k in range(RULE_DEPTH))
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1)" for c in columns)
    return f"""WITH {_ALL}, f(tree, node, feature, threshold, lo, hi, zeros, ones) AS (VALUES {rows}), zs AS (SELECT doc_id, [{scaled}] AS z FROM x),
        s0 AS (SELECT doc_id, z, tree, 0 AS node FROM zs, (SELECT DISTINCT tree FROM f)), {steps},
        p AS (SELECT doc_id, avg(ones / (zeros + ones)) AS p FROM s{RULE_DEPTH} JOIN f USING (tree, node) GROUP BY 1),
        g AS (SELECT doc_id, p, length({text._STRIP.format("text")}) < 50 AS short FROM p JOIN (WITH {text._ESSAYS} SELECT * FROM essays) USING (doc_id))
        SELECT doc_id, CASE WHEN short THEN 0.0 ELSE round(p, 4) END AS ai_probability, CASE WHEN short THEN 0.0 ELSE round(p * 100, 2) END AS ai_score,
            CASE WHEN short THEN 'Original' WHEN p * 100 > 70 THEN 'AI-generated' WHEN p * 100 < 30 THEN 'Original' ELSE 'Mixed' END AS label, CASE WHEN short THEN 0.0 ELSE round(abs(p - 0.5) * 2, 2) END AS confidence FROM g"""


_TAGS = rf"""WITH {text._ESSAYS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM essays),
    g AS (SELECT doc_id, w, list_transform(w, lambda x: CASE WHEN x LIKE '%ing' THEN 'VERB' WHEN x LIKE '%ed' THEN 'ADJ' WHEN x LIKE 'th%' THEN 'PROPN' WHEN length(x) > 6 THEN 'NOUN' ELSE 'X' END) AS tags FROM t)
    SELECT doc_id, round(len(list_filter(tags, lambda x: x IN ('NOUN', 'PROPN'))) / greatest(len(w), 1), 4) AS noun_ratio, round(len(list_filter(tags, lambda x: x = 'VERB')) / greatest(len(w), 1), 4) AS verb_ratio,
        round(len(list_filter(tags, lambda x: x = 'ADJ')) / greatest(len(w), 1), 4) AS adjective_ratio, round(len(list_filter(w, lambda x: length(x) > 9)) / greatest(len(w), 1), 4) AS named_entity_density FROM g"""
_TOKENS = r"[\p{L}\p{N}_]+"
_BURST = rf"""WITH {text._ESSAYS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKENS}') AS w FROM essays), p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS ab FROM t WHERE len(w) > 1),
    c AS (SELECT ab, count(*) AS nab FROM p GROUP BY 1), a AS (SELECT ab[1] AS a, sum(nab) AS na FROM c GROUP BY 1), v AS (SELECT count(DISTINCT x) AS v FROM (SELECT unnest(w) AS x FROM t)),
    l AS (SELECT ab, -ln((nab + 1) / (na + v)) AS loss FROM c JOIN a ON ab[1] = a.a, v),
    s AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: len({text._SPLIT.format("s")}) >= 3)) AS s FROM essays),
    n AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower(s), '{_TOKENS}') AS w FROM s), q AS (SELECT doc_id, k, unnest(list_zip(w[:-2], w[2:])) AS ab FROM n WHERE len(w) > 2),
    e AS (SELECT doc_id, k, exp(least(avg(loss), 20)) AS x FROM q JOIN l USING (ab) GROUP BY 1, 2), b AS (SELECT doc_id, count(*) AS sentences, coalesce(stddev_samp(x) / avg(x), 0) AS cv FROM e GROUP BY 1),
    g AS (SELECT doc_id, avg(loss) AS mean, coalesce(var_samp(loss), 0) AS var, max(loss) AS most FROM p JOIN l USING (ab) GROUP BY 1),
    f AS (SELECT essays.doc_id, length({text._STRIP.format("text")}) < 50 OR mean IS NULL AS short, mean, var, most, sentences, cv FROM essays LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id))
    SELECT doc_id, CASE WHEN short THEN 50.0 ELSE round(exp(least(mean, 25)), 2) END AS mean_perplexity, CASE WHEN short THEN 50.0 ELSE round(exp(least(mean, 50)), 2) END AS offline_perplexity,
        CASE WHEN short THEN 1.0 ELSE round(var, 4) END AS perplexity_variance, CASE WHEN short THEN 3.0 ELSE round(mean, 4) END AS entropy, CASE WHEN short THEN 5.0 ELSE round(most, 4) END AS greatest,
        CASE WHEN short THEN 0.0 ELSE round(coalesce(cv, 0), 4) END AS burstiness_cv, CASE WHEN short THEN 0 ELSE coalesce(sentences, 0) END AS sentences, short AS fallback FROM f"""
SQL = {
    "forest_scores": _rule_scores(FEATURES),
    "legacy_scores": _rule_scores(FEATURES[:3]),
    "tagged_features": _TAGS,
    "sampled_fraction": f"SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) <= round_even(0.013::DOUBLE * count(*) OVER (), 0)",
    "sentence_burstiness": _BURST,
    "undersample_counts": f"""{_L}, t AS (SELECT count(*) FILTER (quality = 0) AS humans, count(*) FILTER (quality = 1) AS machines FROM l),
        o AS (SELECT l.*, machines, humans * 2 AS target, count(*) OVER (PARTITION BY source) AS own, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format("doc_id")}, doc_id) AS rank FROM l, t WHERE quality = 1),
        c AS (SELECT *, row_number() OVER (ORDER BY {_DRAW.format("doc_id")}, doc_id) AS place FROM o WHERE machines <= target OR rank <= least(greatest(1, round_even(target * (own / machines), 0)), own)),
        k AS (SELECT quality, source, doc_id FROM c WHERE machines <= target OR place <= target UNION ALL SELECT quality, source, doc_id FROM l WHERE quality = 0)
        SELECT quality, source, count(*) AS n, min(doc_id) AS first FROM k GROUP BY 1, 2""",
    "sampled_rows": f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey LIMIT 5",
    "class_ratio": """WITH c AS (SELECT count(*) FILTER (quality = 0) AS zeros, count(*) FILTER (quality = 1) AS ones FROM labels) SELECT zeros, ones, round(ones / nullif(zeros, 0), 4) AS ratio, least(ones, zeros * 2) AS most FROM c""",
    "group_split": f"""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
        SELECT CASE WHEN row_number() OVER (ORDER BY {_DRAW.format("source")}, source) <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part, source, n FROM g""",
    "standardise": "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM events",
    "impute": """WITH f AS (SELECT median(value) AS mid, max(value) AS top FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN mid WHEN event_id % 13 = 0 THEN top ELSE value END AS value FROM events, f""",
    "class_means_top5": _means(),
    "all_features": f"WITH {_ALL} SELECT * FROM x",
    "feature_map": f"WITH {_ALL} SELECT doc_id, 18 AS n, type_token_ratio FROM x",
    "confusion_metrics": f"""{_L}, c AS (SELECT {_COUNTS} FROM l), m AS (SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
        round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c) SELECT *, f1 >= 0.8 AND recall >= 0.7 AND specificity >= 0.7 AS passes FROM m""",
    "roc_auc": f"""{_L} SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6) AS auc FROM l a, l b WHERE a.quality = 1 AND b.quality = 0""",
    "roc_curve": f"""{_L}, b AS (SELECT n_chars AS threshold, count(*) FILTER (quality = 1) AS ones, count(*) FILTER (quality = 0) AS zeros FROM l GROUP BY 1)
        SELECT threshold, round(sum(zeros) OVER w / sum(zeros) OVER (), 6) AS fpr, round(sum(ones) OVER w / sum(ones) OVER (), 6) AS tpr FROM b WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""",
}
