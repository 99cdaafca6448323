"""Readers, rewrites and model interfaces on fixtures."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veritrail.operators import models, writes
from veritrail.sources import readers


def test_essays_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,answer,text_author,question_id,dataset\n1,"two\nlines, ""quoted""",human,q,d\n')
    (tmp_path / "b.csv").write_text("answer\nx\n")
    assert tuple(readers.essays(spark, str(tmp_path / "a.csv")).first()) == ('two\nlines, "quoted"', "human", "q", "d")
    with pytest.raises(ValueError):
        readers.essays(spark, str(tmp_path / "b.csv"))


def test_documents_are_read_by_extension(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(packed.getvalue())
    (tmp_path / "b.TXT").write_bytes(b"x\xffy")
    (tmp_path / "c.png").write_bytes(b"pixels")
    (tmp_path / "d.exe").write_bytes(b"no")
    (tmp_path / "e.doc").write_bytes(b"old")
    got = {r["path"][-5:]: (r["kind"], r["text"], r["content"] is not None) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {".docx": ("word", "ab\nc", False), "b.TXT": ("text", "xy", False), "c.png": ("image", None, True), "d.exe": (None, None, False), "e.doc": ("word", None, False)}


def test_audit_log_cuts_agents(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "login", None, 1, " A@B ", "ip", "x" * 200, None)], "at timestamp, event string, status string, user_id long, email string, ip string, user_agent string, detail string")
    readers.append_audit(df, str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert (row["status"], row["email"], len(row["user_agent"])) == ("info", "a@b", 120)


def test_rewrites(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, x string")
    fresh = spark.createDataFrame([(2, "z"), (9, "n")], "id long, x string")
    assert {tuple(r) for r in writes.upserted(t, fresh, "id").collect()} == {(1, "a"), (2, "z"), (3, None), (9, "n")}
    assert writes.new_only(t, spark.createDataFrame([(1, "q"), (4, "q")], "id long, x string"), ["id"]).count() == 1
    changed, n = writes.updated(t, F.col("x") == "a", x=F.lit("c"))
    assert n.first()["changed"] == 1 and {r["x"] for r in changed.collect()} == {"c", "b", None}
    assert {r["x"] for r in writes.supplied_only(t, spark.createDataFrame([(1, None), (3, "n")], "id long, x string"), "id").collect()} == {"a", "b", "n"}
    assert [r["id"] for r in writes.deleted(t, t, "id", guard=F.col("x") == "b").collect()] == [2]
    assert writes.appended(t, spark.createDataFrame([(5, 1)], "id long, y int")).columns == ["id", "x", "y"]


def test_failed_and_locked_submissions_stay(spark):
    t = spark.createDataFrame([(1, "failed", False, None), (2, "completed", True, "old"), (3, "completed", None, None), (4, "completed", False, None)], "submission_id long, status string, is_locked boolean, verification_token string")
    got = {r["submission_id"]: r["verification_token"] for r in writes.locked(t, t.where("submission_id < 4"), F.lit(dt.datetime(2024, 5, 6)), F.lit("abcdef0123")).collect()}
    assert got == {1: None, 2: "old", 3: "PLAG-SEC-0003-20240506-ABCDEF01", 4: None}


def test_state_of_equal_times_is_the_later_one(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "processing", at), (1, "completed", at), (1, "pending", at)], "submission_id long, status string, at timestamp")
    assert writes.current_state(df).first()["status"] == "completed"


def test_models_are_loaded_once_and_score_batches(spark):
    df = spark.createDataFrame([("a b",), (None,), ("c",)], "text string")
    got = models.token_losses(df, "text", lambda: lambda texts: [[float(len(w)) for w in t.split()] for t in texts])
    assert [r["losses"] for r in got.collect()] == [[1.0, 1.0], [], [1.0]]


def test_relevance_of_short_and_unknown(spark):
    known = spark.createDataFrame([("s", "alpha"), ("s", "beta"), ("s", "gamma")], "subject string, keyword string")
    docs = spark.createDataFrame([(1, "s", "alpha beta " + "x" * 50), (2, "s", "alpha " + "x" * 50), (3, "s", "alpha beta"), (4, "t", "x" * 60), (5, "s", None)], "id long, subject string, text string")
    got = {r["id"]: (r["hits"], r["confidence"]) for r in models.subject_relevance(docs, known, "id", "subject", "text").collect()}
    assert got == {1: (2, 0.6667), 2: (1, 0.8), 3: (None, 1.0), 4: (None, 1.0), 5: (None, 1.0)}


def test_csv_and_reports_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nin lines'), (2, None)], "id long, x string")
    readers.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in readers.table_csv(spark, str(tmp_path / "csv"), df.schema).collect()} == {(1, 'a "quoted", text\nin lines'), (2, None)}
    readers.write_report(spark.createDataFrame([(2, 0.5), (1, None)], "id int, f1 double"), str(tmp_path / "report"), "id")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["id: 1", "f1: -", "id: 2", "f1: 0.5"]
    assert readers.open_source(spark, f"csv:{tmp_path / 'csv'}").count() >= 2
    df.write.parquet(str(tmp_path / "p"))
    assert readers.open_source(spark, str(tmp_path / "p")).count() == 2


def test_pages_are_joined_and_equal_files_read_once(spark, tmp_path):
    pages = spark.createDataFrame([("a", 2, "second", 50.0), ("a", 1, "first", 75.0), ("b", 1, None, 10.0)], "path string, page int, text string, confidence double")
    assert {tuple(r) for r in readers.joined_pages(pages).collect()} == {("a", "first\nsecond", 62.5), ("b", "", 10.0)}
    files = spark.createDataFrame([("b", bytearray(b"x")), ("a", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    assert {r["path"] for r in readers.first_of_files(files).collect()} == {"a", "c"}
    words = spark.createDataFrame([("own text", 2, "read"), ("own", 30, "read"), (None, 0, None)], "own string, n int, seen string")
    assert [r["t"] for r in words.select(readers.chosen_text(F.col("own"), F.col("n"), F.col("seen")).alias("t")).collect()] == ["read", "own", None]
