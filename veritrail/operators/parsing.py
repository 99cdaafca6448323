"""From recognised regions of a paper to a structured document: who and what it is, its questions with their answers, and how sure all of it is.

A document's regions stand in the order of reading. Where a section begins, and from which region on its text is answer and no longer
question, follow from running counts and lengths, so that both are windows over a document; only the confidence, which is halved and rounded
region by region, is folded over a section's list. Rounding is half up, in whole thousandths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.text import hex_code, numeric_code, stripped

#: What a region says of the paper, tried in this order, letters in either case; the first group is kept.
NAME = (r"(?i)(?:Name|Student\s*Name)\s*[:\-]\s*([A-Za-z\s\.\,\'\-]+)", r"(?i)^Name\s+([A-Za-z\s\.\'\-]+)")
ROLL = (r"(?i)(?:Roll\s*(?:No|Num|Number)?|Student\s*ID|Reg\s*(?:No)?|ID)\s*[:\-]\s*([A-Za-z0-9\-_/]+)",)
SUBJECT = (r"(?i)(?:Subject|Course|Module)\s*[:\-]\s*([A-Za-z0-9\s\-_]+)",)
TITLE = (r"(?i)(Assignment\s*[-#:]?\s*\d+|Homework\s*[-#:]?\s*\d+|Problem\s*Set\s*[-#:]?\s*\d+|Lab\s*Report\s*[-#:]?\s*\d+)",)
#: Beginnings of questions (number, prompt), of answers (text) and of parts of a question (name).
QUESTION = (
    r"(?i)^[\#\*\s]*(?:Question|Ques|Q\.?|Problem)\s*([0-9]+|[A-Z])\s*[\.\:\-\)]?\s*(.*)",
    r"^[\#\*\s]*([0-9]{1,2})\s*[\.\:\)]\s+(.*)",
    r"^[\#\*\s]*\[?([0-9]+|[a-zA-Z])\]?\s*[\.\:\)]\s+(.*)",
)
ANSWER = r"(?i)^(?:Ans(?:wer)?|Solution|Soln)\s*[:\-]\s*(.*)"
PART = (r"^[\#\*\s]*\(([a-zA-Z]|[ivxIVX]+)\)\s*(.*)", r"^[\#\*\s]*\[([a-zA-Z]|[ivxIVX]+)\]\s*(.*)", r"^[\#\*\s]*([a-zA-Z]|[ivxIVX]+)\)\s+(.*)")
#: Regions that tell of the paper, lengths of a title, a prompt and a question, of a stand-in for one, and the confidence that counts as high.
TOP_REGIONS, TITLE_BELOW, NO_TITLE, PROMPT_ABOVE, QUESTION_BELOW, PREVIEW, HIGH = 8, 50, ("name", "roll", "date"), 20, 120, 100, 0.80
APART = ("FORMULA", "TABLE")


def _thousandths(confidence: Column) -> Column:
    return F.round(confidence * 1000).cast("long")


def _mean(total: Column, n: Column, unit: int = 1000) -> Column:
    """total / n in units, rounded half up; 0 without rows."""
    return F.coalesce(F.call_function("div", total * 2 + n, F.nullif(n * 2, F.lit(0))), F.lit(0)) / float(unit)


def _first_group(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that matches; null if none does or the group is blank."""
    found = F.coalesce(*(F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, 1))) for p in patterns))
    return F.nullif(stripped(found), F.lit(""))


def metadata(regions: DataFrame, doc: str = "doc", order: str = "place") -> DataFrame:
    """(doc, name, roll, subject, title) from the first regions of the first page: each from the first region that tells it."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    top = regions.where("page = 1").withColumn("at", place).where(F.col("at") <= TOP_REGIONS).withColumn("t", stripped(F.col("text")))
    told = {"name": NAME, "roll": ROLL, "subject": SUBJECT, "title": TITLE}
    found = top.select(doc, "at", "t", *(_first_group(F.col("t"), p).alias(c) for c, p in told.items()))
    first = found.groupBy(doc).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in told), F.min_by("t", "at").alias("opening"))
    plain = F.length("opening") < TITLE_BELOW
    for word in NO_TITLE:
        plain = plain & ~F.contains(F.lower("opening"), F.lit(word))
    return first.select(doc, "name", "roll", "subject", F.coalesce("title", F.when(plain, F.col("opening"))).alias("title"))


def _marked(regions: DataFrame, doc: str, order: str) -> DataFrame:
    """Regions with text: the section they are in (0 before the first), what begins there, and whether their text is answer."""
    t = F.col("t")
    head = F.coalesce(*(F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("number"), stripped(F.regexp_extract(t, p, 2)).alias("prompt"))) for p in QUESTION))
    rows = regions.withColumn("t", stripped(F.col("text"))).where("t <> ''").withColumn("head", head).withColumn("is_head", F.col("head").isNotNull())
    rows = rows.withColumn("section", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy(doc).orderBy(order)))
    rows = rows.withColumn("answer_text", F.when(~F.col("is_head") & t.rlike(ANSWER), stripped(F.regexp_extract(t, ANSWER, 1))))
    body = ~F.col("is_head") & F.col("answer_text").isNull()
    rows = rows.withColumn("body", body).withColumn("part", F.when(body, F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in PART))))
    inside = Window.partitionBy(doc, "section").orderBy(order)
    opening = F.first(F.struct(F.coalesce(F.nullif(F.col("head.prompt"), F.lit("")), t).alias("question"), (F.length("head.prompt") > PROMPT_ABOVE).alias("answered"))).over(inside)
    grown = F.coalesce(F.sum(F.when(~F.col("is_head"), F.length(t) + 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"opening": opening, "grown": grown})
    full = F.col("opening.answered") | (F.length("opening.question") + F.col("grown") >= QUESTION_BELOW) | t.endswith("?")
    turns = F.col("answer_text").isNotNull() | (~F.col("is_head") & full)
    return rows.withColumn("in_answer", F.max(turns).over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def sections(regions: DataFrame, doc: str = "doc", order: str = "place") -> DataFrame:
    """(doc, section, number, question, answer, page, kind, confidence, regions, parts): one row a question, and one for a document without any.

    Regions before the first question belong to none. A document without questions is one section: all its text is the answer.
    """
    marked = _marked(regions, doc, order)
    kept = F.struct(F.col(order).alias("at"), "t", "head", "opening", "body", "in_answer", "answer_text", "part", "page", F.col("content_type").alias("kind"), _thousandths(F.col("confidence")).alias("c"))
    whole = marked.where("section > 0").groupBy(doc, "section").agg(F.array_sort(F.collect_list(kept)).alias("rows"))
    rows, head = F.col("rows"), F.element_at("rows", 1)
    asked = F.array_join(F.transform(F.filter(rows, lambda r: r["body"] & ~r["in_answer"]), lambda r: F.concat(F.lit(" "), r["t"])), "")
    piece = lambda r: F.when(r["answer_text"].isNotNull(), F.when(r["answer_text"] != "", F.concat(r["answer_text"], F.lit("\n"))).otherwise("")).when(r["kind"].isin(*APART), F.concat(F.lit("\n"), r["t"], F.lit("\n"))).otherwise(F.concat(r["t"], F.lit(" ")))
    answered = F.array_join(F.transform(F.filter(rows, lambda r: r["in_answer"] & (r["body"] | r["answer_text"].isNotNull())), piece), "")
    sure = F.aggregate(F.filter(rows, lambda r: r["body"]), head["c"], lambda c, r: F.call_function("div", c + r["c"] + 1, F.lit(2)))
    found = whole.select(
        doc, F.col("section").cast("int").alias("section"), head["head"]["number"].alias("number"), F.concat(head["opening"]["question"], asked).alias("question"), stripped(answered).alias("answer"),
        head["page"].alias("page"), head["kind"].alias("kind"), (sure / 1000.0).alias("confidence"), F.size(rows).alias("regions"), F.array_compact(F.transform(rows, lambda r: r["part"])).alias("parts"),
    )
    some = marked.groupBy(doc).agg(F.max("section").alias("last"), F.array_sort(F.collect_list(kept)).alias("rows"), F.sum(_thousandths(F.col("confidence"))).alias("c"), F.count("*").alias("n")).where("last = 0")
    bare = some.select(
        doc, F.lit(1).alias("section"), F.lit("1").alias("number"), F.left(head["t"], F.lit(PREVIEW)).alias("question"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("answer"),
        head["page"].alias("page"), head["kind"].alias("kind"), _mean(F.col("c"), F.col("n")).alias("confidence"), F.size(rows).alias("regions"), F.array().cast("array<string>").alias("parts"),
    )
    return found.unionByName(bare)


def documents(regions: DataFrame, doc: str = "doc", order: str = "place") -> DataFrame:
    """One row a document: what it says of itself, its sections in order, its confidence, and how many regions are sure or need a look."""
    n, high = F.count("*"), F.count_if(F.col("confidence") >= HIGH)
    of = regions.groupBy(doc).agg(
        F.count_distinct("page").alias("pages"), n.alias("regions"), _mean(high * 100, n, 100).alias("high_confidence_ratio"), F.count_if("needs_review").alias("needs_review"), _mean(F.sum(_thousandths(F.col("confidence"))), n).alias("mean"),
    )
    s = sections(regions, doc, order)
    inside = s.groupBy(doc).agg(F.count("*").alias("sections"), _mean(F.sum(_thousandths(F.col("confidence"))), F.count("*")).alias("sure"), F.array_sort(F.collect_list(F.struct("section", "number", "question", "answer"))).alias("parts"))
    joined = of.join(metadata(regions, doc, order), doc, "left").join(inside, doc, "left")
    return joined.select(doc, "title", "name", "roll", "subject", "pages", "regions", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("sure", "mean").alias("confidence"), "high_confidence_ratio", "needs_review", "parts")


def clean_name(name: Column, misread: tuple[tuple[str, str], ...] = ()) -> Column:
    """A name without marks of formulas and stray punctuation, one blank around brackets, and mended by `misread`: (pattern, text) in order, letters in either case."""
    s = F.trim(F.coalesce(name, F.lit("")))
    for pattern, put in ((r"\\text\{([^}]+)\}", "$1"), (r"\\[\[\]\(\)]", ""), (r"\\[a-zA-Z]+", " "), (r'["`\^~_\[\]\\{}]+', "")):
        s = F.regexp_replace(s, pattern, put)
    for pattern, put in misread:
        s = F.regexp_replace(s, f"(?i){pattern}", put)
    for pattern, put in ((r"\s+", " "), (r"\s*\(\s*", " ("), (r"\s*\)\s*", ") "), (r"\s+", " ")):
        s = F.trim(F.regexp_replace(s, pattern, put)) if pattern == r"\s+" else F.regexp_replace(s, pattern, put)
    return s


def clean_records(rows: DataFrame, kinds: dict[str, str], misread: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """`rows` with each column cleaned by its kind: name, hex_id, number, or text, which only loses outer blanks."""
    by = {"name": lambda c: clean_name(c, misread), "hex_id": hex_code, "number": numeric_code, "text": stripped}
    return rows.withColumns({c: by[kind](F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, kind in kinds.items()})


def zipped(cells: DataFrame, page: str, order: str, columns: dict[int, str]) -> DataFrame:
    """(page, row, a column of text for each of `columns`): the cells of each column, numbered from 0 by `order`, side by side; an empty text where a
    column has no more. Cells of equal order stand by their text; each cell has a place of its own, so that none is lost."""
    row = F.row_number().over(Window.partitionBy(page, "column").orderBy(order, "text")) - 1
    side = [F.coalesce(F.max(F.when(F.col("column") == c, F.col("text"))), F.lit("")).alias(name) for c, name in columns.items()]
    return cells.withColumn("row", row).groupBy(page, "row").agg(*side)
