"""Limits as keyed state: equal to the batch form in any order of files, reset, and gone when a user is idle."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritrail.operators import access
from veritrail.sources.catalog import work_dir
from veritrail.streaming import events

BEGIN = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, reset boolean"


def requests():
    """Users with bursts, resets, ties, and rows without user."""
    out = []
    for i in range(400):
        user = None if i % 17 == 0 else i % 7
        out.append((i, user, BEGIN + timedelta(seconds=(i // 3) * 8 + (i % 5) * 2), i % 23 == 0))
    return out


def stream(spark, files, late="1 day", most=3, seconds=120):
    """The rows of each file as a micro-batch, one after the other; (rows out, rows of state at the end)."""
    at, out, state = (work_dir(spark, n) for n in ("requests", "decided", "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STORE)
    found = None
    try:
        for rows in files:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
            query = events.limits(source, most, seconds, late).writeStream.trigger(availableNow=True).option("checkpointLocation", state).format("parquet").option("path", out).start()
            query.awaitTermination()
            found = query.lastProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return {r["event_id"]: (r["limited"], r["retry_after"]) for r in spark.read.parquet(out).collect()}, found["stateOperators"][0]["numRowsTotal"]


def batch(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["event_id"]: (r["limited"], r["retry_after"]) for r in access.rate_limited(df, "user_id", "ts", "event_id", 3, 120, "reset", **more).collect()}


def test_stream_decides_as_the_batch_does(spark):
    rows = requests()
    got, _ = stream(spark, [rows[:150][::-1], rows[150:300], rows[300:]])
    want = batch(spark, rows)
    assert got == want
    assert {x for x, _ in got.values()} == {True, False, None}


def test_idle_users_leave_no_state(spark):
    many = [(i, i, BEGIN + timedelta(seconds=i % 60), False) for i in range(300)]
    later = [(1000 + i, 999_999, BEGIN + timedelta(days=3 + i), False) for i in range(2)]
    got, left = stream(spark, [many, later[:1], later[1:]], late="1 hour")
    assert len(got) == 302 and left <= 6


@pytest.mark.parametrize("partitions", [1, 5])
def test_batch_is_that_of_a_plain_walk(spark, partitions):
    rows = requests()
    moments = [BEGIN + timedelta(seconds=200), BEGIN + timedelta(seconds=500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r["event_id"]: r["limited"] for r in access.rate_limited(df, "user_id", "ts", "event_id", 3, 120, "reset", cleared=moments).collect()}
    kept, want = {}, {}
    for i, user, ts, reset in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        epoch = sum(ts > m for m in moments)
        times = [t for t in kept.get((user, epoch), []) if t > ts - timedelta(seconds=120)]
        if reset:
            kept[(user, epoch)], want[i] = [], None
        elif user is None or len(times) < 3:
            kept[(user, epoch)], want[i] = [*times, ts], False
        else:
            want[i] = True
    assert got == want


def test_rows_without_key_are_dealt_by_their_id(spark):
    df = spark.range(2000).select(F.col("id").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit(BEGIN).alias("ts"))
    found = access.rate_limited(df, "user_id", "ts", "event_id", 1, 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where("limited").count() == 0 and max(r["count"] for r in parts) < 1500
