"""Sharding by size-tiered compaction, in DataFrame operations alone.

A table is a folder of immutable runs and of manifest versions. `append` writes an arrival as a run of small shards, straight from the partitions
it comes in. `compact` merges runs of one size tier, once there are `fan_in` of them, into a run of shards of the target size: the small
shards are scanned and put together without a shuffle. Runs are of one tier when none has more than `fan_in` times the bytes of the smallest.
Each change is a new manifest, a folder written aside, and one small file, the version, that names it. The file is written whole under
another name and takes the version's name only if nothing has it, in one step of the file system: a link on local disks and a rename without
overwriting elsewhere, which HDFS does in one step too. Object stores that copy to rename (COPIES) have no such step and are refused. Who reads
a version sees all of it; of two writers of the same version one fails and leaves nothing that is read. The version's file holds the table's
columns as well: those of its arrivals, in the order they came. Runs that no version lists any more go by `vacuum`, which must not run beside a writer.

Defined results: nulls and empty texts are stored as they are; repeated rows stay repeated; an arrival without rows is a version that adds no shards,
and a table of such arrivals alone is read as no rows of their columns; a column that an arrival lacks is null in its rows; a column named
_arrival is replaced; a table without arrivals is an error to read.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a shard that a merge aims at, rows of one in an arrival at most, and how many runs of a tier are merged.
TARGET, ARRIVAL_ROWS, FAN_IN = 128 << 20, 50_000, 4
#: Schemes of stores that have no rename in one step.
COPIES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "obs", "wasb", "wasbs"}
MANIFEST = "run string, arrival long, file string, bytes long, rows long"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of `path`, for listing and renaming, and its Path class."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, at: str) -> list[int]:
    """Committed versions, ascending."""
    fs, path = _fs(spark, f"{at}/manifest")
    if not fs.exists(path(f"{at}/manifest")):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(path(f"{at}/manifest")))
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def _version(spark: SparkSession, at: str, version: int) -> tuple[str, T.StructType]:
    """What a version's file says: the name of its manifest, and the table's columns."""
    said = json.loads(spark.read.text(f"{at}/manifest/v{version:08d}", wholetext=True).first()[0])
    return said["parts"], T.StructType.fromJson(said["columns"])


def _folder(spark: SparkSession, at: str, version: int) -> str:
    """The folder with a version's manifest."""
    return f"{at}/parts/{_version(spark, at, version)[0]}"


def columns(spark: SparkSession, at: str, version: int) -> T.StructType:
    return _version(spark, at, version)[1]


def manifest(spark: SparkSession, at: str, version: int | None = None) -> DataFrame:
    """(run, arrival, file, bytes, rows): a row for each shard of a version, the latest by default, and each arrival in it."""
    known = versions(spark, at)
    if not known:
        raise ValueError(f"no version of {at}")
    return spark.read.schema(MANIFEST).parquet(_folder(spark, at, known[-1] if version is None else version))


def _taken(error: Py4JJavaError) -> bool:
    names = (error.java_exception.getClass().getName(), str(error.java_exception.getCause()))
    return any("FileAlreadyExists" in n for n in names)


def _commit(spark: SparkSession, at: str, shards: DataFrame, version: int, schema: T.StructType | None = None) -> int:
    """Make `shards` the given version, if nobody has made it: nothing is looked up before, taking the name is the only test."""
    fs, path = _fs(spark, at)
    if fs.getScheme() in COPIES:
        raise ValueError(f"{fs.getScheme()} has no rename in one step: versions of {at} could be lost")
    said = {"columns": (schema or T.StructType()).jsonValue()}
    jvm, name = spark.sparkContext._jvm, uuid.uuid4().hex
    aside, place = path(f"{at}/aside/{name}"), path(f"{at}/manifest/v{version:08d}")
    shards.coalesce(1).write.parquet(f"{at}/parts/{name}")
    fs.mkdirs(path(f"{at}/manifest"))
    out = fs.create(aside)
    out.write(bytearray(json.dumps(said | {"parts": name}).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(place), local(aside))
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, place, none)
    except Py4JJavaError as e:
        fs.delete(path(f"{at}/parts/{name}"), True)
        if _taken(e):
            raise RuntimeError(f"version {version} of {at} has been committed by another writer") from None
        raise
    finally:
        fs.delete(aside, False)
    return version


def _merged(one: T.StructType, other: T.StructType) -> T.StructType:
    """All columns of one, then what only the other has."""
    return T.StructType([*one, *(f for f in other if f.name not in one.names)])


def _shards(spark: SparkSession, at: str, run: str, schema: T.StructType) -> DataFrame:
    """Manifest rows of a run that has been written: sizes as stored, rows as counted from the files' footers."""
    fs, path = _fs(spark, at)
    sizes = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(path(f"{at}/runs/{run}")) if f.getPath().getName().startswith("part-")]
    listed = spark.createDataFrame(sizes, "file string, bytes long")
    named = spark.read.schema(schema).parquet(f"{at}/runs/{run}").select("_arrival", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    counted = named.groupBy("_arrival", "file").agg(F.count("*").alias("rows"))
    return counted.join(listed, "file").select(F.lit(run).alias("run"), F.col("_arrival").alias("arrival"), "file", "bytes", "rows")


def append(df: DataFrame, at: str, arrival: int, rows: int = ARRIVAL_ROWS) -> int:
    """Write `df` as a run of small shards and commit it; returns the version."""
    spark = df.sparkSession
    known, run = versions(spark, at), f"a{arrival:06d}-{uuid.uuid4().hex[:12]}"
    named = df.withColumn("_arrival", F.lit(arrival).cast("long"))
    named.write.option("maxRecordsPerFile", rows).parquet(f"{at}/runs/{run}")
    schema = _merged(columns(spark, at, known[-1]), named.schema) if known else named.schema
    shards = _shards(spark, at, run, schema)
    if known:
        shards = manifest(spark, at, known[-1]).unionByName(shards)
    return _commit(spark, at, shards, (known or [0])[-1] + 1, schema)


def plan(spark: SparkSession, at: str, target: int = TARGET, fan_in: int = FAN_IN) -> DataFrame:
    """(run, bytes, tier, runs): runs whose tier is full. A tier spans a factor of `fan_in` in bytes from its smallest run; runs whose shards have half
    the target's size on average are done. One array of the open runs is walked, as many as the driver lists folders."""
    files = manifest(spark, at).groupBy("run", "file").agg(F.max("bytes").alias("bytes"))
    runs = files.groupBy("run").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    open_ = runs.where(F.col("bytes") < F.col("files") * F.lit(target / 2)) if target else runs
    listed = open_.agg(F.array_sort(F.collect_list(F.struct("bytes", "run"))).alias("runs"))

    def tier(state: Column, x: Column) -> Column:
        wider = x["bytes"] > state["least"] * fan_in
        number, least = state["tier"] + F.when(wider, 1).otherwise(0), F.when(wider, x["bytes"]).otherwise(state["least"])
        return F.struct(F.concat(state["out"], F.array(F.struct(x["run"].alias("run"), x["bytes"].alias("bytes"), number.alias("tier")))).alias("out"), number.alias("tier"), least.alias("least"))

    start = F.struct(F.array().cast("array<struct<run:string,bytes:bigint,tier:int>>").alias("out"), F.lit(0).alias("tier"), F.lit(-1).cast("bigint").alias("least"))
    tiered = listed.select(F.explode(F.aggregate("runs", start, tier, lambda s: s["out"])).alias("r")).select("r.*")
    full = tiered.groupBy("tier").agg(F.count("*").alias("runs"), F.sum("bytes").alias("tier_bytes")).where(F.col("runs") >= fan_in)
    return tiered.join(full, "tier").select("run", "bytes", "tier", "runs")


def compact(spark: SparkSession, at: str, target: int = TARGET, fan_in: int = FAN_IN) -> int:
    """Merge the runs of the lowest full tier; returns the version, the latest one as it is if no tier is full.

    The plan is over runs, which the driver lists as it lists their folders; the shards' rows stay on the executors.
    """
    latest = versions(spark, at)[-1]
    full = plan(spark, at, target, fan_in).orderBy("tier", "run").collect()
    chosen = [r for r in full if r["tier"] == full[0]["tier"]]
    if not chosen:
        return latest
    total, names = sum(r["bytes"] for r in chosen), [r["run"] for r in chosen]
    run = f"m{latest + 1:06d}-{uuid.uuid4().hex[:12]}"
    schema = columns(spark, at, latest)
    merged = spark.read.schema(schema).parquet(*(f"{at}/runs/{n}" for n in names))
    merged.coalesce(max(1, math.ceil(total / target))).write.parquet(f"{at}/runs/{run}")
    rest = manifest(spark, at, latest).where(~F.col("run").isin(names))
    return _commit(spark, at, rest.unionByName(_shards(spark, at, run, schema)), latest + 1, schema)


def settle(spark: SparkSession, at: str, target: int = TARGET, fan_in: int = FAN_IN) -> int:
    """Compact until no tier is full; returns the version."""
    before, version = -1, versions(spark, at)[-1]
    while version != before:
        before, version = version, compact(spark, at, target, fan_in)
    return version


def vacuum(spark: SparkSession, at: str, keep: int = 1) -> int:
    """Drop all but the last `keep` versions and the runs that only they list; returns how many runs went."""
    known = versions(spark, at)
    fs, path = _fs(spark, at)
    kept = {r["run"] for v in known[-keep:] for r in manifest(spark, at, v).select("run").distinct().collect()}
    for v in known[:-keep]:
        folder = _folder(spark, at, v)
        fs.delete(path(f"{at}/manifest/v{v:08d}"), False)
        fs.delete(path(folder), True)
    gone = [x.getPath() for x in fs.listStatus(path(f"{at}/runs")) if x.getPath().getName() not in kept]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def read(spark: SparkSession, at: str, version: int | None = None) -> DataFrame:
    """All rows of a version, with the arrival that brought each, in `_arrival`."""
    known = versions(spark, at)
    runs = [r["run"] for r in manifest(spark, at, version).select("run").distinct().collect()]
    schema = columns(spark, at, known[-1] if version is None else version)
    return spark.read.schema(schema).parquet(*(f"{at}/runs/{n}" for n in runs)) if runs else spark.createDataFrame([], schema)
