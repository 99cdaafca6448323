"""Which rows lie in whose mapping, where one text takes in another if either contains it.

Mappings are a table, a row for each subject and section of a teacher, read from a column of JSON lists. Texts that contain each other are
found among the distinct values of both sides by an index of q-grams: a text's pieces of one to Q characters are its keys, and what is looked
for is entered once, by its rarest piece. What meets there is compared exactly. Blank texts are contained in everything and are dealt with by
themselves, so that rows and mappings meet in joins on equal keys alone, never each with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.sources.catalog import materialise

Q = 3
MAPPING = "array<struct<subject:string,section:string>>"


def plain(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def mappings(teachers: DataFrame, id: str, column: str) -> DataFrame:
    """(teacher, subject, section), each once, from JSON lists of objects; a single object counts as a list of one, a missing field as blank.

    Text that is no JSON, or JSON of another form, is no mapping, and neither is an element that is null.
    """
    listed = teachers.select(F.col(id).alias("teacher"), F.explode(F.from_json(column, MAPPING)).alias("m")).where("m is not null")
    return listed.select("teacher", plain(F.col("m.subject")).alias("subject"), plain(F.col("m.section")).alias("section")).distinct()


def _pieces(text: Column, q: int) -> Column:
    """All different pieces of one to q characters."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in range(1, q + 1))))


def contained(hay: DataFrame, needles: DataFrame, q: int = Q) -> DataFrame:
    """(text, part): each text of `hay` (text) with each of `needles` (part) that it contains; both distinct and not blank."""
    keys = materialise(hay.select("text", F.explode(_pieces(F.col("text"), q)).alias("piece")), "pieces")
    held = keys.groupBy("piece").agg(F.count("*").alias("texts"))
    # of a needle's pieces the longest it has; one that no text holds rules the needle out
    wanted = needles.select("part", F.explode(F.filter(_pieces(F.col("part"), q), lambda x: F.length(x) == F.least(F.length("part"), F.lit(q)))).alias("piece"))
    counted = wanted.join(held, "piece", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = counted.groupBy("part").agg(F.min(F.struct("texts", "piece")).alias("key")).where("key.texts > 0").select("part", F.col("key.piece").alias("piece"))
    return rarest.join(keys, "piece").where(F.contains("text", F.col("part"))).select("text", "part")


def each_way(left: DataFrame, right: DataFrame, q: int = Q) -> DataFrame:
    """(a, b): values of `left` (a) and `right` (b), neither blank, of which either contains the other."""
    a, b = (materialise(df.select(c).where(F.col(c) != "").distinct(), "values") for df, c in ((left, "a"), (right, "b")))
    forth = contained(a.withColumnRenamed("a", "text"), b.withColumnRenamed("b", "part"), q).select(F.col("text").alias("a"), F.col("part").alias("b"))
    back = contained(b.withColumnRenamed("b", "text"), a.withColumnRenamed("a", "part"), q).select(F.col("part").alias("a"), F.col("text").alias("b"))
    return materialise(forth.unionByName(back).distinct(), "contained")


def scope(rows: DataFrame, mapped: DataFrame, subject: str, section: str) -> DataFrame:
    """(teacher, `subject`, `section`): the values of rows that lie in a mapping of each teacher, each once; to be joined with the rows.

    Blank subjects and sections, on either side, take in all.
    """
    own = rows.select(subject, section).distinct().select(F.col(subject).alias("_subject"), F.col(section).alias("_section"), plain(F.col(subject)).alias("rj"), plain(F.col(section)).alias("rs"))
    own = materialise(own, "scopes")
    maps = materialise(mapped.select("teacher", F.col("subject").alias("mj"), F.col("section").alias("ms")).distinct(), "mappings")
    subjects = each_way(own.select(F.col("rj").alias("a")), maps.select(F.col("mj").alias("b"))).withColumnsRenamed({"a": "rj", "b": "mj"})
    sections = each_way(own.select(F.col("rs").alias("a")), maps.select(F.col("ms").alias("b"))).withColumnsRenamed({"a": "rs", "b": "ms"})
    columns = ["teacher", "_subject", "_section"]
    by_section = own.join(sections, "rs").join(maps, "ms")
    said = by_section.join(subjects, ["rj", "mj"], "left_semi").select(columns)
    any_subject = by_section.where("rj = '' or mj = ''").select(columns)
    any_section = own.join(subjects, "rj").join(maps, "mj").where("rs = '' or ms = ''").select(columns)
    # both blank: every such pair is one of the result, so that the key that all share makes no row that isn't wanted
    one = lambda df, by, where: df.where(where).withColumn("all", F.pmod(F.xxhash64(by), F.lit(1)))
    both = [one(own, "rs", a).join(one(maps, "ms", b), "all").select(columns) for a, b in (("rs = '' and rj = ''", "true"), ("true", "ms = '' and mj = ''"), ("rs = ''", "mj = ''"), ("rj = ''", "ms = ''"))]
    found = said.unionByName(any_subject).unionByName(any_section)
    for more in both:
        found = found.unionByName(more)
    return found.distinct().withColumnsRenamed({"_subject": subject, "_section": section})
