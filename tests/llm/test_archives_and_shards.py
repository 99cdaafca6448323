"""Archives of others and cut ones; tables of shards without rows."""

import gzip
import hashlib
import json
import zlib

import pytest
from pyspark.errors import PythonException

from veritrail.llm import bpe, files, quality_model, queries, sharding, token_files, warc
from veritrail.sources.catalog import work_dir

BODY = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"


def record(block, *lines):
    return b"\r\n".join([b"WARC/1.0", *lines, b"content-LENGTH:%d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


FOREIGN = [
    record(b"software: some crawler\r\n", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/warc-fields"),
    record(b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"warc-type:request", b"WARC-Record-ID:<urn:uuid:2>", b"WARC-Target-URI:http://a/", b"Content-Type:application/http; msgtype=request"),
    record(BODY, b"WARC-TYPE:   response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Target-URI: http://a/", b"X-Note: folded", b"\tline: here", b"Content-Type: application/http;msgtype=response"),
    record(b"", b"WARC-Type: metadata", b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Payload-Digest: sha1:ABC"),
]


def placed(spark, data):
    out = work_dir(spark, "test-warc")
    files.put(f"{out}/{warc.WHOLE}/crawl.warc.gz", data)
    return spark.createDataFrame([("crawl",)], "archive string"), out


@pytest.mark.parametrize("data", [gzip.compress(b"".join(FOREIGN)), b"".join(map(gzip.compress, FOREIGN)), gzip.compress(b"".join(FOREIGN)) + b"\0" * 700], ids=["one", "members", "padded"])
def test_archives_of_others_are_rewritten(spark, data):
    archives, out = placed(spark, data)
    assert [tuple(r) for r in warc.normalise(archives, out).collect()] == [("crawl", 4)]
    index = [json.loads(x) for x in files.lines(f"{out}/crawl.index.jsonl")]
    normal = files.get(f"{out}/crawl.warc.gz")
    assert [zlib.decompress(normal[e["offset"] : e["offset"] + e["length"]], wbits=31) for e in index] == FOREIGN
    assert [e["type"] for e in index] == ["warcinfo", "request", "response", "metadata"] and [e["url"] for e in index] == [None, "http://a/", "http://a/", None]
    assert index[2]["digest"] == f"sha256:{hashlib.sha256(b'<p>hello</p>').hexdigest()}" and index[3]["digest"] == "sha1:ABC"
    headers, payload = warc.fetch(f"{out}/crawl.warc.gz", index[2])
    assert payload == b"<p>hello</p>" and headers["x-note"] == "folded line: here"
    got = {r["record_type"]: r for r in warc.read(spark, archives, out).collect()}
    assert bytes(got["warcinfo"]["payload"]) == b"software: some crawler\r\n" and got["response"]["payload_bytes"] == 12 and {r["page"] for r in got.values()} == {None}


@pytest.mark.parametrize("cut", [4, 9, 60])
@pytest.mark.parametrize("members", [False, True])
def test_cut_archives_are_an_error(spark, cut, members):
    data = b"".join(map(gzip.compress, FOREIGN)) if members else gzip.compress(b"".join(FOREIGN))
    archives, out = placed(spark, data[:-cut])
    with pytest.raises(PythonException, match="the archive ends inside"):
        warc.normalise(archives, out)
    with pytest.raises(FileNotFoundError):
        files.get(f"{out}/crawl.warc.gz")


def test_records_that_lie_about_their_length_are_an_error():
    short = FOREIGN[2].replace(b"LENGTH:%d" % len(BODY), b"LENGTH:%d" % (len(BODY) - 3))
    for wrong in (short, b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_in(iter([wrong + FOREIGN[3]])))


def test_tables_without_rows(spark, empty):
    at = work_dir(spark, "test-shards")
    plain = empty.drop("_metadata")
    assert [sharding.append(plain, at, k) for k in range(4)] == [1, 2, 3, 4]
    assert sharding.settle(spark, at) == 4 and sharding.vacuum(spark, at) == 4
    assert sharding.read(spark, at).count() == 0 and set(sharding.read(spark, at).columns) == {*plain.columns, "_arrival"}


def test_columns_that_come_later(spark):
    at = work_dir(spark, "test-shards")
    for k, df in enumerate([spark.sql("SELECT 1L AS id"), spark.sql("SELECT 2L AS id, 'é' AS name"), spark.sql("SELECT 3L AS id"), spark.sql("SELECT 4L AS id")]):
        sharding.append(df, at, k)
    want = {(1, None), (2, "é"), (3, None), (4, None)}
    assert {(r["id"], r["name"]) for r in sharding.read(spark, at).collect()} == want
    assert sharding.read(spark, at, 1).columns == ["id", "_arrival"]
    assert sharding.settle(spark, at) == 5 and sharding.manifest(spark, at).select("run").distinct().count() == 1
    assert {(r["id"], r["name"]) for r in sharding.read(spark, at).collect()} == want


def test_stores_without_a_rename_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", {"file"})
    with pytest.raises(ValueError, match="no rename"):
        sharding.append(spark.range(1), work_dir(spark, "test-shards"), 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_take_empty_tables(spark, empty, tmp_path, name):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    tables = {
        "documents": docs, "benchmark": spark.createDataFrame([], "item_id long, text string"), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"), "conversations": spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame([], "vec_id long, embedding array<float>, label int"),
    }
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_are_many_ranges(spark):
    """Token files of rows without id, or of one: they are dealt by their texts, and all come back in one order."""
    from pyspark.sql import functions as F

    docs = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    out = work_dir(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = token_files.write(docs, out, queries.WORD_BPE, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 2
    got = token_files.read(spark, out, shards).orderBy("start").collect()
    assert len(got) == 600 and [r["id"] for r in got] == [None] * 300 + [7] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_stretches_are_bounded_in_bytes():
    import pyarrow as pa

    texts = ["a" * 3, None, "b" * 9, "c" * 50, "", "d" * 4, "e" * 4]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    parts = [p.column(0).to_pylist() for p in bpe.stretches(batch, "text", 3, 12)]
    assert sum(parts, []) == texts and parts == [["aaa", None, "b" * 9], ["c" * 50], ["", "dddd", "eeee"]]


def test_an_id_of_many_rows_is_learned_from_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_model, "train", lambda bags, y: seen.update(n=len(y)))
    docs = spark.createDataFrame([(1, f"text {i} of one") for i in range(500)] + [(2, "another text")], "doc_id long, text string")
    quality_model.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert seen == {"n": 2}
