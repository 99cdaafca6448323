"""Streaming forms of windows, duplicates and rate limits. Checkpoints and results lie in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritrail.operators import access
from veritrail.sources.catalog import work_dir

#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, which may be one file or a folder; its times are instants."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if alone else source.parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))


def by_session(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, columns: list[str], late: str = "40 days") -> DataFrame:
    """Each combination once inside the time that rows may be late by; what was seen before that is forgotten, and so the state is bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(columns)


class Limiter(StatefulProcessor):
    """A user's accepted requests inside the window, as keyed state that ends by itself.

    Requests of a micro-batch are decided in their order; a timer at the moment when the newest one stops counting takes the state away, so that
    a user who has been idle for a window has none. Rows that reset a user take it away at once.
    """

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        kept = list(self.kept.get()[0]) if self.kept.exists() else []
        for r in sorted(rows, key=lambda r: (r["ts"], r["reset"], r["event_id"])):
            if r["reset"]:
                kept.clear()
                yield Row(event_id=r["event_id"], limited=None, retry_after=None)
            else:
                limited, after = access.decided(kept, access.at_seconds(r["ts"]), self.most, self.seconds) if r["user_id"] is not None else (False, None)
                yield Row(event_id=r["event_id"], limited=limited, retry_after=after)
        for moment in self.handle.listTimers():
            self.handle.deleteTimer(moment)
        if kept and key[0] is not None:
            self.kept.update((kept,))
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)
        else:
            self.kept.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def limits(requests: DataFrame, most: int, seconds: int, late: str = "1 day") -> DataFrame:
    """A stream of (event_id, limited, retry_after) from requests (event_id, user_id, ts, and reset if any row resets its user).

    A row that comes more than `late` after the newest one finds no state and is dropped with the watermark. Rows without user are keys of their own
    and leave no state. The rows that one user has in a micro-batch are sorted in the task's memory: the source bounds a micro-batch.
    """
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in requests.columns else F.lit(False)
    rows = requests.select("event_id", "user_id", "ts", reset.alias("reset"), F.when(F.col("user_id").isNull(), F.col("event_id")).alias("lone"))
    return rows.withWatermark("ts", late).groupBy("user_id", "lone").transformWithState(Limiter(most, seconds), "event_id long, limited boolean, retry_after long", "append", "EventTime")


def limited(requests: DataFrame, most: int, seconds: int, late: str = "1 day") -> DataFrame:
    """Run `limits` over all that there is now and read its result back."""
    conf, store = requests.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store)
    conf.set(store, STORE)
    try:
        return finished(limits(requests, most, seconds, late), "append")
    finally:
        conf.set(store, before)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that there is now and read its result back; `complete` results replace each other, others add up."""
    spark = stream.sparkSession
    out = work_dir(spark, "stream")
    write = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    if mode == "complete":
        query = write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    else:
        query = write.format("parquet").option("path", f"{out}/rows").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
