"""Scopes of teachers by q-grams against every row with every mapping."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import access, scopes


def inside(m_subject, m_section, subject, section):
    each_way = lambda a, b: a in b or b in a
    return each_way(m_subject, subject) and (m_section == "" or each_way(m_section, section))


@pytest.fixture(scope="module")
def parts():
    draw = random.Random(2)
    word = ["math", "mathematics", "a", "ab", "CSE", "cse-a", "cse-b", "phys", "physics lab", "é", "", "lab", "section b", "b"]
    rows = [(i, draw.choice([*word, None]), draw.choice([*word, None, f"{draw.choice(word)} {draw.choice(word)}"])) for i in range(300)]
    maps = [(t, draw.choice(word), draw.choice(word)) for t in range(120)]
    return rows, maps


def test_scope_is_that_of_all_pairs(spark, parts):
    rows, maps = parts
    low = lambda x: (x or "").strip().lower()
    df, mapped = spark.createDataFrame(rows, "id long, subject string, section string"), spark.createDataFrame([(t, low(a), low(b)) for t, a, b in maps], "teacher long, subject string, section string")
    found = scopes.scope(df, mapped, "subject", "section")
    got = {tuple(r) for r in found.select("teacher", "subject", "section").collect()}
    assert len(got) == found.count()
    assert got == {(t, s, c) for _, s, c in rows for t, a, b in maps if inside(low(a), low(b), low(s), low(c))}


def test_ten_thousand_mappings_meet_rows_without_a_loop(spark):
    maps = spark.range(10_000).select("id", F.concat(F.lit('[{"subject":"subject '), F.col("id"), F.lit('","section":"cse-'), F.col("id") % 40, F.lit('"}]')).alias("json"))
    rows = spark.range(3000).select(F.concat(F.lit("Subject "), F.col("id") * 3, F.lit(" advanced")).alias("subject"), F.concat(F.lit("CSE-"), F.col("id") * 3 % 40).alias("section"))
    found = scopes.scope(rows, scopes.mappings(maps, "id", "json"), "subject", "section")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where(F.concat(F.lit("Subject "), F.col("teacher"), F.lit(" advanced")) == F.col("subject")).count() == 3000


def test_mappings_of_any_json(spark):
    told = [(1, '[{"subject":" Math ","section":"A"},{"subject":"x"},null]'), (2, "{oops"), (3, None), (4, "[]"), (5, '{"subject":"one"}'), (6, "7"), (7, ""), (8, '[{"subject":"x"},{"subject":"X "}]')]
    got = scopes.mappings(spark.createDataFrame(told, "t int, j string"), "t", "j").collect()
    assert {tuple(r) for r in got} == {(1, "math", "a"), (1, "x", ""), (5, "one", ""), (8, "x", "")} and len(got) == 4


def test_roles_gate(spark):
    df = spark.range(3)
    assert [access.gated(df, r).count() for r in ("admin", "hod", "teacher", "student", None)] == [3, 3, 3, 0, 0]
    assert access.gated(df, "student", ("student",)).count() == 3 and access.gated(df, "student").columns == ["id"]
