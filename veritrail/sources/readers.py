"""Readers and sinks of files: essays in CSV, documents by extension, the audit log."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions.text import word_count

ESSAY = ("answer", "text_author", "question_id", "dataset")
#: What is read as text, and from how many words on a page's own text counts.
TEXT, WORD, PDF, IMAGE = ("txt",), ("docx", "doc"), ("pdf",), ("png", "jpg", "jpeg")
LEAST_WORDS, AGENT = 20, 120
_PARAGRAPH, _RUN = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"


def essays(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of essays from CSV with a header; a file without one of them is an error."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = read.csv(path).columns
    if missing := [c for c in ESSAY if c not in names]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return read.schema(schema).csv(path).select(*ESSAY)


def table_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that an earlier step wrote as CSV; its columns are given, so that no file is read twice."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each part; quotes inside values are doubled, as the readers here expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_report(df: DataFrame, path: str, order: str) -> None:
    """A text report, a line `name: value` for each column of each row. Reports are short: they lie in one file."""
    named = F.concat_ws("\n", *(F.concat_ws(": ", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns))
    df.orderBy(order).select(named.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def open_source(spark: SparkSession, url: str, table: str = "") -> DataFrame:
    """A table by its URL: a database's by JDBC, files by their format's name before the colon, anything else as Parquet."""
    scheme, _, rest = url.partition(":")
    if scheme == "jdbc":
        return from_database(spark, url, table)
    return spark.read.format(scheme).load(rest) if scheme in ("csv", "json", "orc", "parquet", "text") else spark.read.parquet(url)


def from_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table by JDBC; filters and columns go to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    """How a file is read; null where it can't be."""
    e = extension(path)
    return F.when(e.isin(*TEXT), "text").when(e.isin(*WORD), "word").when(e.isin(*PDF), "pdf").when(e.isin(*IMAGE), "image")


def _word_text(data: bytes | None) -> str | None:
    """Paragraphs that aren't blank, one a line; null for what is no such archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ("".join(t.text or "" for t in p.iter(_RUN)) for p in body.iter(_PARAGRAPH))
    return "\n".join(x for x in lines if x.strip())


@F.pandas_udf(T.StringType())
def word_text(content: pd.Series) -> pd.Series:
    return content.map(_word_text)


@F.pandas_udf(T.StringType())
def plain_text(content: pd.Series) -> pd.Series:
    """UTF-8, without the bytes that aren't."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, content) of the files below `path`: text of plain and word documents; pages and pictures wait for a recogniser."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", kind(F.col("path")).alias("kind"), "content")
    text = F.when(F.col("kind") == "text", plain_text("content")).when(F.col("kind") == "word", word_text("content"))
    return files.select("path", "kind", text.alias("text"), F.when(F.col("kind").isin("pdf", "image"), F.col("content")).alias("content"))


def chosen_text(own: Column, own_words: Column, recognised: Column) -> Column:
    """A page's own text if it has enough words, else what a recogniser read."""
    return F.when(own_words >= LEAST_WORDS, own).otherwise(F.coalesce(recognised, own))


def joined_pages(pages: DataFrame, path: str = "path", number: str = "page", by: str = "\n") -> DataFrame:
    """(path, text, confidence): a document's pages in order, joined by `by`, a line's end if nothing else is said, and the mean of their confidences to one digit."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce("text", F.lit("")).alias("t"))))
    return pages.groupBy(path).agg(F.array_join(F.transform(listed, lambda x: x["t"]), by).alias("text"), F.round(F.avg("confidence"), 1).alias("confidence"))


def document_texts(own: DataFrame, recognised: DataFrame, path: str = "path", number: str = "page") -> DataFrame:
    """(path, text, confidence, scanned): a document's own page texts, a line each, if they have enough words; else the recognised ones, a blank line
    between pages, with the mean of their confidences. A document that was not recognised keeps what it has; one's own text is sure."""
    plain = joined_pages(own.withColumn("confidence", F.lit(100.0)), path, number).select(path, F.col("text").alias("_own"))
    seen = joined_pages(recognised, path, number, "\n\n").select(path, F.col("text").alias("_seen"), F.col("confidence").alias("_sure"))
    both = plain.join(seen, path, "full")
    words = F.coalesce(word_count(F.col("_own")), F.lit(0))
    scanned = (words < LEAST_WORDS) & F.col("_seen").isNotNull()
    return both.select(path, F.when(scanned, F.col("_seen")).otherwise(F.coalesce("_own", F.lit(""))).alias("text"), F.when(scanned, F.col("_sure")).otherwise(100.0).alias("confidence"), scanned.alias("scanned"))


def first_of_files(files: DataFrame) -> DataFrame:
    """Files without those whose bytes an earlier path has; digests are grouped, contents stay where they are until one row each is left."""
    digest = F.md5("content")
    first = files.select(digest.alias("_digest"), "path").groupBy("_digest").agg(F.min("path").alias("path"))
    return files.join(first.select("path"), "path", "left_semi")


def audit_events(df: DataFrame) -> DataFrame:
    """Rows as the audit log keeps them: a status and an id for each, and a user agent of bounded length."""
    return df.select("at", "event", F.coalesce("status", F.lit("info")).alias("status"), "user_id", F.lower(F.trim("email")).alias("email"), "ip", F.left("user_agent", F.lit(AGENT)).alias("user_agent"), "detail")


def append_audit(df: DataFrame, path: str) -> None:
    audit_events(df).withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
