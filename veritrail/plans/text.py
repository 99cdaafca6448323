"""Queries over cleaning and text features, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import fixed, text
from veritrail.operators import analytics
from veritrail.sources import stand_ins
from veritrail.sources.catalog import table

#: Openings that make the rules on phrases and leakage meet something; a document's is chosen by its id.
OPENINGS = (
    "Furthermore, I think it's not merely a landscape of data; however, the realm of \t\t things can be defined as ever-evolving.\n\n\n\n",
    "As an AI language model, here is my essay on it: ",
    "Sure, here's what we don't know:   maybe, in conclusion, all in all. ",
    "Great question! Title: In today's fast-paced world, I i I felt us.\n\n",
    "",
)


def essays(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(opening, F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).alias("text"))


def clean_whitespace(spark: SparkSession, d: str) -> DataFrame:
    """C4."""
    return essays(spark, d).select("doc_id", text.clean_whitespace(F.col("text")).alias("cleaned"))


def prompt_leakage(spark: SparkSession, d: str) -> DataFrame:
    """C5, C6 without its parser."""
    return essays(spark, d).select("doc_id", text.without_leakage(F.col("text")).alias("cleaned"))


def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """C2, and C1 as an expression."""
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", text.has_tags(html).alias("tagged"), text.without_tags(html).alias("bare"))


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """C1, by a parser."""
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("bare"))


def clean_essays(spark: SparkSession, d: str) -> DataFrame:
    """C3, C6."""
    return essays(spark, d).select("doc_id", text.clean_essay(F.col("text")).alias("cleaned"))


def word_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """C8, F17."""
    t = F.col("text")
    points = F.size(F.filter(F.split(t, r"\."), lambda s: s.rlike(r"[^\s ]")))
    return essays(spark, d).select("doc_id", text.word_count(t).alias("word_count"), points.alias("sentence_count"), (text.word_count(t) >= 50).alias("long_enough"), F.size(text.long_sentences(t)).alias("long_sentences"))


def _rounded(struct: str, digits: int, *names: str) -> list:
    return [F.round(f"{struct}.{c}", digits).alias(c) for c in names]


def stylometric_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """X17."""
    return essays(spark, d).select("doc_id", text.fingerprint(F.col("text")).alias("f")).select("doc_id", *_rounded("f", 6, *analytics.STYLE_METRICS))


def stylometric_11(spark: SparkSession, d: str) -> DataFrame:
    """X1 to X9, X14."""
    return essays(spark, d).select("doc_id", text.stylometrics(F.col("text")).alias("f")).select("doc_id", "f.*")


def flesch_manual(spark: SparkSession, d: str) -> DataFrame:
    """X10."""
    return essays(spark, d).select("doc_id", text.flesch(F.col("text")).alias("flesch_reading_ease"))


def semantic_layer(spark: SparkSession, d: str) -> DataFrame:
    """X11 to X13, X18, X19."""
    return essays(spark, d).select("doc_id", text.semantic_layer(F.col("text")).alias("s")).select("doc_id", "s.*")


def style_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """W1."""
    subs = stand_ins.submissions(spark, d, 33).select("submission_id", "student_id", "created_at", text.fingerprint(F.col("text")).alias("f"))
    return analytics.style_anomalies(subs.select("submission_id", "student_id", "created_at", "f.*"))


def levenshtein_consensus(spark: SparkSession, d: str) -> DataFrame:
    """V8: how alike a part's name is to its type."""
    return table(spark, d, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


def code_repair(spark: SparkSession, d: str) -> DataFrame:
    """C9, C10, C13."""
    code = F.concat(F.lit("12) \\text{so-"), F.hex("doc_id"), F.lit("ob1l"), F.col("source"), F.lit("}"))
    t = table(spark, d, "documents").select("doc_id", code.alias("raw"))
    return t.select("doc_id", text.hex_code(F.col("raw")).alias("hex_code"), text.numeric_code(F.col("raw")).alias("numeric_code"), text.without_list_number(F.col("raw")).alias("unnumbered"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_whitespace, prompt_leakage, strip_tags, strip_html, clean_essays, word_sentence_counts, stylometric_fingerprint, stylometric_11, flesch_manual, semantic_layer,
        style_anomalies, levenshtein_consensus, code_repair,
    )
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(map(_quoted, values))


def _marked(phrase: str) -> str:
    """The phrase with its words between marks, as the text `marked` has it."""
    return re.sub(r"(\w+)", "\x01\\1\x02", phrase)


def _hits(phrases: tuple[str, ...]) -> str:
    parts = [f"(length(marked) - length(replace(marked, {_quoted(_marked(p))}, ''))) // {len(_marked(p))}" for p in phrases]
    return "(" + " + ".join(parts) + ")"


_ESSAYS = "essays AS (SELECT doc_id, list_extract([" + ", ".join("replace(replace(" + _quoted(o.replace("\n", "~").replace("\t", "^")) + ", '~', chr(10)), '^', chr(9))" for o in OPENINGS) + f"], CAST(doc_id % {len(OPENINGS)} + 1 AS INT)) || replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents)"
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0B\x{{00A0}}]+', ''), '[\s\x0B\x{{00A0}}]+$', '')"
_LINE = r"regexp_replace(regexp_replace(x, '^[ \t\f\r\x0B\x{00A0}]+', ''), '[ \t\f\r\x0B\x{00A0}]+$', '')"
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"
_BOUND = f"{_ESSAYS}, b AS (SELECT doc_id, text, {_WORDS.format('lower(text)')} AS tokens FROM essays), w AS (SELECT *, greatest(1, len(tokens)) AS n, regexp_replace(lower(text), '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g') AS marked FROM b)"
_SPLIT = r"list_filter(string_split_regex({}, '[\s\x0B\x{{00A0}}]+'), lambda x: x <> '')"
_SENTENCES = r"list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '[^\s\x0B\x{00A0}]'))"
_LEAKED = "text"
for _p in fixed.LEAKAGE:
    _LEAKED = f"regexp_replace({_LEAKED}, {_quoted('(?i)' + _p)}, '')"
_FINGERPRINT = r"""f AS (SELECT *, list_transform(pieces, lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS bare FROM g),
    h AS (SELECT *, list_filter(list_transform(bare, lambda w: lower(w)), lambda w: w <> '') AS kept FROM f),
    prints AS (SELECT *, length(stripped) < 10 AS short FROM h),
    figures AS (SELECT *, CASE WHEN short OR len(pieces) = 0 THEN 0 ELSE list_sum(list_transform(bare, lambda w: length(w))) / len(pieces) END AS word_length,
        CASE WHEN short THEN 0 ELSE len(pieces) / greatest(1, len(sentences)) END AS sentence_length, CASE WHEN short OR len(kept) = 0 THEN 0 ELSE len(list_distinct(kept)) / len(kept) END AS ttr,
        CASE WHEN short THEN 0 ELSE len(regexp_extract_all(text, '[[:punct:]]')) / length(text) END AS punctuation_density FROM prints)"""
_PIECES = f"{_SPLIT.format('text')} AS pieces, {_SENTENCES} AS sentences, {_STRIP.format('text')} AS stripped"
_Z = {m: f"abs({m} - {m}_mean) / ({m}_std + 0.0001)" for m in analytics.STYLE_METRICS}
SQL = {
    "clean_whitespace": rf"""WITH {_ESSAYS}, o AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM essays)
        SELECT doc_id, {_STRIP.format(f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_LINE}), chr(10))")} AS cleaned FROM o""",
    "prompt_leakage": f"WITH {_ESSAYS} SELECT doc_id, {_STRIP.format(_LEAKED)} AS cleaned FROM essays",
    "strip_tags": "SELECT page_id, regexp_matches(html, '<[^>]+>') AS tagged, regexp_replace(html, '<[^>]+>', '', 'g') AS bare FROM pages",
    "word_sentence_counts": rf"""WITH {_ESSAYS} SELECT doc_id, len({_SPLIT.format("text")}) AS word_count, len(list_filter(string_split(text, '.'), lambda s: regexp_matches(s, '[^\s\x0B\x{{00A0}}]'))) AS sentence_count,
        len({_SPLIT.format("text")}) >= 50 AS long_enough,
        len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: len({_SPLIT.format("s")}) >= 3)) AS long_sentences FROM essays""",
    "stylometric_fingerprint": f"""WITH {_ESSAYS}, g AS (SELECT doc_id, text, {_PIECES} FROM essays), {_FINGERPRINT}
        SELECT doc_id, {", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in analytics.STYLE_METRICS)} FROM figures""",
    "stylometric_11": rf"""WITH {_BOUND}, l AS (SELECT *, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len({_WORDS.format("s")})), lambda k: k > 0) AS lengths,
            list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\s\x0B\x{{00A0}}]')) AS pars FROM w),
        m AS (SELECT *, list_transform(CASE WHEN len(pars) > 0 THEN pars ELSE [text] END, lambda p: len({_WORDS.format("p")})) AS per FROM l)
        SELECT doc_id, round(CASE WHEN len(lengths) > 0 THEN list_sum(lengths) / len(lengths) ELSE 0 END, 4) AS avg_sentence_length,
            round(CASE WHEN len(lengths) > 1 THEN list_stddev_samp(lengths) ELSE 0 END, 4) AS sentence_length_std, round(len(list_distinct(tokens)) / n, 4) AS type_token_ratio,
            round(len(list_filter(tokens, lambda t: t IN ({_list(fixed.STOP_WORDS)}))) / n, 4) AS stop_word_ratio,
            round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[[:punct:]]')) / length(text) ELSE 0 END, 4) AS punctuation_frequency,
            round(len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:''+[\p{{L}}\p{{N}}_]+)+'), lambda t: t IN ({_list(fixed.CONTRACTIONS)}))) / n, 4) AS contraction_ratio,
            0.0::DOUBLE AS noun_ratio, 0.0::DOUBLE AS verb_ratio, 0.0::DOUBLE AS adjective_ratio, 0.0::DOUBLE AS named_entity_density, round(list_sum(per) / len(per), 4) AS avg_paragraph_length FROM m""",
    "flesch_manual": rf"""WITH {_BOUND} SELECT doc_id, round(206.835 - 1.015 * (n / greatest(1, len({_SENTENCES})))
        - 84.6 * (coalesce(list_sum(list_transform(tokens, lambda t: greatest(1, len(regexp_extract_all(t, '[aeiou]+')) - CASE WHEN t LIKE '%e' THEN 1 ELSE 0 END))), 0) / n), 4) AS flesch_reading_ease FROM w""",
    "semantic_layer": rf"""WITH {_BOUND}, p AS (SELECT doc_id, length({_STRIP.format("text")}) < 50 OR len(tokens) = 0 AS short, least(1.0::DOUBLE, {_hits(fixed.GENERIC_PHRASES)} * 10 / n) AS g,
            greatest(0.0::DOUBLE, 1 - {_hits(fixed.PERSONAL_VOICE)} * 5 / n) AS v, least(1.0::DOUBLE, {_hits(fixed.TRANSITIONS)} * 15 / n) AS c, greatest(0.0::DOUBLE, 1 - len(list_distinct(tokens)) / n) AS r FROM w),
        s AS (SELECT *, greatest(g, v, c) - least(g, v, c) AS spread, g * 0.3::DOUBLE + v * 0.3::DOUBLE + c * 0.4::DOUBLE AS l FROM p), a AS (SELECT *, CASE WHEN spread < 0.3 THEN 'high' WHEN spread < 0.6 THEN 'medium' ELSE 'low' END AS aligned FROM s)
        SELECT doc_id, CASE WHEN short THEN 0.5 ELSE round(g, 2) END AS generic_phrasing, CASE WHEN short THEN 0.5 ELSE round(v, 2) END AS lack_of_personal_voice, CASE WHEN short THEN 0.5 ELSE round(c, 2) END AS over_structured_coherence,
            CASE WHEN short THEN 0.5 ELSE round(r, 2) END AS repetitiveness, CASE WHEN short THEN 0.5 ELSE round((g + c) / 2, 2) END AS semantic_predictability, CASE WHEN short THEN 0.5 ELSE round(g, 2) END AS conceptual_shallowness,
            CASE WHEN short THEN 50.0 ELSE round(l * 100, 2) END AS final_ai_likelihood, CASE WHEN short THEN 0.1 ELSE round(greatest(0.1::DOUBLE, 1 - spread), 2) END AS confidence,
            CASE WHEN short THEN 'low' ELSE aligned END AS signal_alignment, CASE WHEN short THEN 'moderate' WHEN l > 0.7 THEN 'high' WHEN l > 0.4 THEN 'moderate' ELSE 'low' END AS risk_level,
            CASE WHEN short THEN 'Fallback used due to insufficient text or processing failure.' ELSE 'Semantic alignment is ' || aligned || '.' || CASE WHEN v > 0.7 THEN ' Lacks personal voice.' ELSE '' END
                || CASE WHEN c > 0.7 THEN ' Highly structured transitions detected.' ELSE '' END END AS reasoning FROM a""",
    "style_anomalies": f"""WITH {stand_ins.submissions_sql(33)}, g AS (SELECT submission_id, student_id, created_at, text, {_PIECES} FROM submissions), {_FINGERPRINT},
        r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, submission_id DESC) AS k FROM figures),
        base AS (SELECT student_id, count(*) AS before, {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in analytics.STYLE_METRICS)} FROM r WHERE k > 1 GROUP BY 1 HAVING count(*) >= 2),
        z AS (SELECT student_id, submission_id, before, {", ".join(f"{z} AS {m}_z" for m, z in _Z.items())} FROM r JOIN base USING (student_id) WHERE k = 1)
        SELECT student_id, submission_id, round(({" + ".join(f"{m}_z" for m in _Z)}) / 4, 2) AS deviation,
            CASE greatest({", ".join(f"{m}_z" for m in _Z)}) {" ".join(f"WHEN {m}_z THEN '{m}'" for m in _Z)} END AS metric, before + 1 AS history FROM z WHERE ({" + ".join(f"{m}_z" for m in _Z)}) / 4 > 2.0""",
    "levenshtein_consensus": rf"""WITH j AS (SELECT p_partkey, lower({_STRIP.format("coalesce(p_name, '')")}) AS x, lower({_STRIP.format("coalesce(p_type, '')")}) AS y FROM part)
        SELECT p_partkey, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS similarity FROM j""",
    "code_repair": r"""WITH t AS (SELECT doc_id, '12) \text{so-' || hex(doc_id) || 'ob1l' || source || '}' AS raw FROM documents),
        k AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(raw, '\\[A-Za-z]+|[{}$]', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: length(w) >= 6) AS tokens FROM t)
        SELECT doc_id, right(translate(upper(CASE WHEN len(tokens) > 0 THEN tokens[-1] ELSE regexp_replace(raw, '[^A-Za-z0-9]', '', 'g') END), 'OIL', '011'), 8) AS hex_code,
            regexp_replace(translate(upper(raw), 'OILSBG', '011586'), '[^0-9]', '', 'g') AS numeric_code, regexp_replace(raw, '^\s*\d+[.)]\s*', '') AS unnumbered FROM k""",
}
