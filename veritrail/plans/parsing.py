"""Queries over documents made of recognised regions, and the same in SQL. Conversations play the papers: a turn is a region, as one of twelve kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import layout, parsing, scoring
from veritrail.plans import decisions
from veritrail.plans.text import _STRIP as STRIP
from veritrail.sources.catalog import table

#: What a region says, by its kind: {0} is the turn's text in one line, {1} the paper's number.
KINDS = (
    "Name: Mary-Ann Smith", "Roll No: CS-{1}/7", "Subject: Data Science 101", "Assignment - 3", "Question 4: {0}", "{0}",
    "Ans: {0}", "(b) {0}", "2. Why is {1}?", "  ", "paper {1} says", "$x^2$ {0}",
)


def _pieces(kind: str) -> list[str]:
    return [p for p in kind.replace("{", "\0{").replace("}", "}\0").split("\0") if p]


def regions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    line, paper, at = F.translate("text", "\n", " "), F.col("conv_id"), ((F.col("conv_id") * 5 + F.col("turn") * 7 + F.floor(F.col("conv_id") / 3)) % len(KINDS)).cast("int")

    def put(piece: str):
        return {"{0}": line, "{1}": paper.cast("string")}.get(piece, F.lit(piece))

    said = F.element_at(F.array(*(F.concat(*map(put, _pieces(k))) for k in KINDS)), at + 1)
    sure = (paper * 31 + F.col("turn") * 17) % 100 / 100
    return c.select(
        paper.alias("doc"), F.col("turn").alias("place"), (F.floor(F.col("turn") / 6) + 1).cast("int").alias("page"), said.alias("text"), sure.alias("confidence"),
        F.when(at == 11, "FORMULA").otherwise("TEXT").alias("content_type"), (sure < 0.7).alias("needs_review"),
    )


def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    """L11, T10."""
    return parsing.metadata(regions(spark, d))


def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    """Questions, answers and parts."""
    return parsing.sections(regions(spark, d)).withColumn("parts", F.array_join("parts", ","))


def paper_documents(spark: SparkSession, d: str) -> DataFrame:
    """One row a paper."""
    return parsing.documents(regions(spark, d)).withColumn("parts", F.array_join(F.transform("parts", lambda s: s["number"]), ","))


#: Readings of names that the records below have, and what they are.
MISREAD = ((r"\b(?:Smlth|Srnith|S\s*mith)\b", "Smith"), (r"\b(?:J0nes|Jo\s*nes)\b", "Jones"), (r"\b(?:N[o0]wh?ere)\b", "Nowhere"), (r"^\s*0?2[0-9]\s+", ""))


def repaired_names(spark: SparkSession, d: str) -> DataFrame:
    """Records with names, codes and numbers as a reader gives them."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    read = F.element_at(F.array(*map(F.lit, ("\\\\text{S  mith  Ann}", "21 srnith `Lee", "Dr.(J0nes )Nowere", "\\\\alpha Jo nes ^"))), (key % 4 + 1).cast("int"))
    rows = p.select("p_partkey", F.concat(read, F.lit(" "), F.col("p_name")).alias("name"), F.concat(F.lit("so-"), F.hex("p_partkey"), F.lit("ob1l9")).alias("code"), F.concat(F.lit("I"), F.col("p_size").cast("string"), F.lit("O ")).alias("marks"), F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("note"))
    return parsing.clean_records(rows, {"name": "name", "code": "hex_id", "marks": "number", "note": "text"}, MISREAD)


def zipped_columns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of both speakers side by side."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 2).alias("column"), "text")
    return parsing.zipped(c, "conv_id", "turn", {0: "left", 1: "right"})


def fusion_with_vision(spark: SparkSession, d: str) -> DataFrame:
    """R11 with all three recognisers."""
    p = table(spark, d, "part")
    two = decisions.fusion_decision(spark, d).select("p_partkey", F.struct("text", "confidence", "model", "needs_review").alias("two"))
    seen = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") / 50)
    return p.join(two, "p_partkey").select("p_partkey", scoring.with_vision(F.col("p_brand"), seen, F.col("two")).alias("s")).select("p_partkey", "s.*")


QUERIES = {f.__name__: f for f in (paper_metadata, paper_sections, paper_documents, repaired_names, zipped_columns, fusion_with_vision)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _said(kind: str) -> str:
    put = lambda p: {"{0}": "line", "{1}": "CAST(conv_id AS VARCHAR)"}.get(p, _quoted(p))
    return " || ".join(map(put, _pieces(kind)))


_R = f"""c AS (SELECT *, replace(text, chr(10), ' ') AS line, CAST((conv_id * 5 + turn * 7 + conv_id // 3) % {len(KINDS)} AS INT) AS k FROM conversations),
    regions AS (SELECT conv_id AS doc, turn AS place, CAST(turn // 6 + 1 AS INT) AS page, [{", ".join(map(_said, KINDS))}][k + 1] AS text, (conv_id * 31 + turn * 17) % 100 AS pct, CASE WHEN k = 11 THEN 'FORMULA' ELSE 'TEXT' END AS kind FROM c),
    x AS (SELECT *, {STRIP.format("text")} AS t FROM regions)"""


def _first(patterns: tuple[str, ...]) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(t, {_quoted(p)}) THEN regexp_extract(t, {_quoted(p)}, 1) END" for p in patterns)
    return f"nullif({STRIP.format(f'coalesce({found}, NULL)')}, '')"


_META = f"""top AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place) AS nth FROM x WHERE page = 1 QUALIFY nth <= 8),
    told AS (SELECT doc, nth, t, {_first(parsing.NAME)} AS name, {_first(parsing.ROLL)} AS roll, {_first(parsing.SUBJECT)} AS subject, {_first(parsing.TITLE)} AS title FROM top),
    meta AS (SELECT doc, {", ".join(f"arg_min({c}, nth) FILTER ({c} IS NOT NULL) AS {c}" for c in ("name", "roll", "subject", "title"))}, arg_min(t, nth) AS opening FROM told GROUP BY doc),
    m AS (SELECT doc, name, roll, subject, coalesce(title, CASE WHEN length(opening) < 50 AND NOT regexp_matches(lower(opening), 'name|roll|date') THEN opening END) AS title FROM meta)"""


def _any(patterns: tuple[str, ...], group: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN regexp_extract(t, {_quoted(p)}, {group})" for p in patterns) + " END"


_SECTIONS = f"""h AS (SELECT *, {_any(parsing.QUESTION, 1)} AS number, {STRIP.format(_any(parsing.QUESTION, 2))} AS prompt FROM x WHERE t <> ''),
    n AS (SELECT *, count(number) OVER (PARTITION BY doc ORDER BY place) AS section, CASE WHEN number IS NULL AND regexp_matches(t, {_quoted(parsing.ANSWER)}) THEN {STRIP.format(f"regexp_extract(t, {_quoted(parsing.ANSWER)}, 1)")} END AS ans FROM h),
    o AS (SELECT *, number IS NULL AND ans IS NULL AS body, first_value(coalesce(nullif(prompt, ''), t)) OVER w AS q, first_value(length(prompt) > 20) OVER w AS early,
            coalesce(sum(CASE WHEN number IS NULL THEN length(t) + 1 ELSE 0 END) OVER (PARTITION BY doc, section ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grown FROM n WINDOW w AS (PARTITION BY doc, section ORDER BY place)),
    a AS (SELECT *, CASE WHEN body THEN {_any(parsing.PART, 1)} END AS part, bool_or(ans IS NOT NULL OR (number IS NULL AND (early OR length(q) + grown >= 120 OR t LIKE '%?'))) OVER (PARTITION BY doc, section ORDER BY place) AS inside FROM o),
    found AS (SELECT doc, CAST(section AS INT) AS section, arg_min(number, place) AS number, any_value(q) || coalesce(string_agg(' ' || t, '' ORDER BY place) FILTER (body AND NOT inside), '') AS question,
            {STRIP.format("coalesce(string_agg(CASE WHEN ans = '' THEN '' WHEN ans IS NOT NULL THEN ans || chr(10) WHEN kind IN ('FORMULA', 'TABLE') THEN chr(10) || t || chr(10) ELSE t || ' ' END, '' ORDER BY place) FILTER (inside AND number IS NULL), '')")} AS answer,
            arg_min(page, place) AS page, arg_min(kind, place) AS kind, list_reduce(list(pct * 10 ORDER BY place) FILTER (ans IS NULL), lambda c, r: (c + r + 1) // 2) / 1000 AS confidence, CAST(count(*) AS INT) AS regions,
            coalesce(string_agg(part, ',' ORDER BY place), '') AS parts FROM a WHERE section > 0 GROUP BY doc, section
        UNION ALL SELECT doc, 1, '1', left(arg_min(t, place), 100), string_agg(t, chr(10) ORDER BY place), arg_min(page, place), arg_min(kind, place), (2 * sum(pct * 10) + count(*)) // (2 * count(*)) / 1000, CAST(count(*) AS INT), ''
        FROM a GROUP BY doc HAVING max(section) = 0)"""
_NAME = "trim(name)"
for _p, _put in ((r"\\text\{([^}]+)\}", r"\1"), (r"\\[\[\]\(\)]", ""), (r"\\[a-zA-Z]+", " "), (r'["`\^~_\[\]\\{}]+', "")):
    _NAME = f"regexp_replace({_NAME}, {_quoted(_p)}, {_quoted(_put)}, 'g')"
for _p, _put in MISREAD:
    _NAME = f"regexp_replace({_NAME}, {_quoted('(?i)' + _p)}, {_quoted(_put)}, 'g')"
_NAME = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({_NAME}, '\s+', ' ', 'g')), '\s*\(\s*', ' (', 'g'), '\s*\)\s*', ') ', 'g'), '\s+', ' ', 'g'))"
SQL = {
    "paper_metadata": f"WITH {_R}, {_META} SELECT * FROM m",
    "paper_sections": f"WITH {_R}, {_SECTIONS} SELECT * FROM found",
    "paper_documents": f"""WITH {_R}, {_META}, {_SECTIONS},
        g AS (SELECT doc, count(DISTINCT page) AS pages, count(*) AS regions, (200 * count(*) FILTER (pct >= 80) + count(*)) // (2 * count(*)) / 100 AS high_confidence_ratio, count(*) FILTER (pct < 70) AS needs_review,
            (2 * sum(pct * 10) + count(*)) // (2 * count(*)) / 1000 AS mean FROM x GROUP BY 1),
        s AS (SELECT doc, count(*) AS sections, (2 * sum(CAST(round(confidence * 1000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1000 AS sure, string_agg(number, ',' ORDER BY section) AS parts FROM found GROUP BY 1)
        SELECT g.doc, title, name, roll, subject, pages, g.regions, coalesce(sections, 0) AS sections, coalesce(sure, mean) AS confidence, high_confidence_ratio, needs_review, parts FROM g LEFT JOIN m USING (doc) LEFT JOIN s USING (doc)""",
    "repaired_names": rf"""WITH r AS (SELECT p_partkey, ['\\text{{S  mith  Ann}}', '21 srnith `Lee', 'Dr.(J0nes )Nowere', '\\alpha Jo nes ^'][p_partkey % 4 + 1] || ' ' || p_name AS name, 'so-' || hex(p_partkey) || 'ob1l9' AS code, 'I' || p_size || 'O ' AS marks, p_brand AS note FROM part),
        k AS (SELECT *, list_filter(list_transform(string_split_regex(code, '\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: length(w) >= 6) AS tokens FROM r)
        SELECT p_partkey, {_NAME} AS name, right(translate(upper(CASE WHEN len(tokens) > 0 THEN tokens[-1] ELSE regexp_replace(code, '[^A-Za-z0-9]', '', 'g') END), 'OIL', '011'), 8) AS code,
            regexp_replace(translate(upper(marks), 'OILSBG', '011586'), '[^0-9]', '', 'g') AS marks, trim(note) AS note FROM k""",
    "zipped_columns": """WITH c AS (SELECT conv_id, turn % 2 AS side, text, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn, text) - 1 AS INT) AS row FROM conversations),
        l AS (SELECT * FROM c WHERE side = 0), r AS (SELECT * FROM c WHERE side = 1)
        SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.row, r.row) AS row, coalesce(l.text, '') AS left, coalesce(r.text, '') AS right FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.row = r.row""",
    "fusion_with_vision": f"""WITH two AS ({decisions.SQL["fusion_decision"]}) SELECT p_partkey, CASE WHEN v THEN p_brand ELSE text END AS text, CASE WHEN v THEN p_size / 50 ELSE confidence END AS confidence, CASE WHEN v THEN 'vision' ELSE model END AS model,
        CASE WHEN v THEN p_size / 50 < 0.70 ELSE needs_review END AS needs_review FROM (SELECT *, p_partkey % 4 = 0 AS v FROM part) JOIN two USING (p_partkey)""",
}
