"""Queries over intervals, and over pictures and regions as arrays and boxes, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import images
from veritrail.operators import intervals, similarity
from veritrail.plans import layout
from veritrail.sources.catalog import table


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What users were busy with, some minutes from each event on, and windows of very different lengths around their errors."""
    e, ts = table(spark, d, "events"), F.col("ts").cast("timestamp")
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    busy = e.select("event_id", "user_id", ts.alias("start"), (ts + minutes(F.get_json_object("props", "$.k").cast("int"))).alias("end"))
    length = F.when(F.col("event_id") % 5 == 0, 20_000).when(F.col("event_id") % 5 == 1, 900).otherwise(F.col("event_id") % 60)
    windows = e.where("event_type = 'error'").select("event_id", "user_id", (ts - minutes(F.lit(10))).alias("start"), (ts + minutes(length)).alias("end"))
    return busy, windows


def busy_in_windows(spark: SparkSession, d: str) -> DataFrame:
    """2.19, a general interval join: each user's errors' windows and what overlaps with them."""
    busy, windows = _spans(spark, d)
    found = intervals.overlapping(windows, busy, "start", "end", ["user_id"])
    return found.groupBy(F.col("left.event_id").alias("event_id")).agg(F.count("*").alias("busy"), F.sum("right.event_id").alias("ids"))


def windows_over_all(spark: SparkSession, d: str) -> DataFrame:
    """2.19 without a key: short windows of all users against each other."""
    windows = _spans(spark, d)[1]
    short = windows.where((F.col("event_id") % 5 > 1))
    return intervals.overlap_summary(short, windows, "start", "end", "event_id").select(F.col("id").alias("event_id"), F.col("n").alias("windows"), "first")


#: Sides of the pictures that vectors are drawn as.
WIDE, HIGH = 18, 16


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    pixel = lambda i: F.floor(F.get("embedding", ((i * 7 + F.floor(i / WIDE) * 5) % 64).cast("int")).cast("double") * 200) + 128
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1)), pixel).alias("pixels"))


def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """V9: pictures made smaller and hashed."""
    return _pictures(spark, d).select("vec_id", images.dhash(images.resized(F.col("pixels"), WIDE, HIGH, images.HASH_WIDTH, images.HASH_HEIGHT)).alias("visual_hash"))


def image_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that another owner has as well; each second one is handed in again by the next owner."""
    p = _pictures(spark, d)
    again = p.where("vec_id % 2 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), (F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)).alias("label"), "pixels")
    hashed = p.unionByName(again).withColumn("visual_hash", images.dhash(images.resized(F.col("pixels"), WIDE, HIGH, images.HASH_WIDTH, images.HASH_HEIGHT)))
    return similarity.visual_duplicates(hashed, "visual_hash", "vec_id", "label")


def region_crops(spark: SparkSession, d: str) -> DataFrame:
    """Regions as they are cut out, and what is known of them before they are read."""
    r = layout.regions(spark, d).withColumn("x1", F.col("x1") - F.when(F.col("region") % 19 == 0, 200).otherwise(0))
    r = r.withColumn("box", images.crop(layout.WIDTH, layout.HEIGHT)).select("page", "region", "box", images.region_features(F.col("box"), layout.WIDTH, layout.HEIGHT).alias("f"))
    return r.select("page", "region", "box.*", "f.*")


QUERIES = {f.__name__: f for f in (busy_in_windows, windows_over_all, image_hashes, image_duplicates, region_crops)}
_SPANS = """WITH busy AS (SELECT event_id, user_id, ts AS s, ts + to_minutes(CAST(json_extract_string(props, '$.k') AS INT)) AS e FROM events),
    w AS (SELECT event_id, user_id, ts - INTERVAL 10 MINUTE AS s, ts + to_minutes(CAST(CASE WHEN event_id % 5 = 0 THEN 20000 WHEN event_id % 5 = 1 THEN 900 ELSE event_id % 60 END AS INT)) AS e FROM events WHERE event_type = 'error')"""
_HASH = f"""p AS (SELECT vec_id, label, list_transform(range(0, {WIDE * HIGH}), lambda i: CAST(floor(CAST(embedding[(i * 7 + i // {WIDE} * 5) % 64 + 1] AS DOUBLE) * 200) + 128 AS BIGINT)) AS px FROM embeddings),
    g AS (SELECT vec_id, label, list_transform(range(0, 72), lambda k: round_even((px[k // 9 * 36 + k % 9 * 2 + 1] + px[k // 9 * 36 + k % 9 * 2 + 2] + px[k // 9 * 36 + k % 9 * 2 + 19] + px[k // 9 * 36 + k % 9 * 2 + 20]) / 4, 0)) AS g FROM p),
    b AS (SELECT vec_id, label, list_transform(range(0, 64), lambda i: CASE WHEN g[i // 8 * 9 + i % 8 + 2] > g[i // 8 * 9 + i % 8 + 1] THEN 1 ELSE 0 END) AS b FROM g),
    h AS (SELECT vec_id, label, array_to_string(list_transform(range(15, -1, -1), lambda k: substr('0123456789abcdef', 1 + b[k * 4 + 1] + 2 * b[k * 4 + 2] + 4 * b[k * 4 + 3] + 8 * b[k * 4 + 4], 1)), '') AS visual_hash FROM b)"""
SQL = {
    "busy_in_windows": f"{_SPANS} SELECT w.event_id, count(*) AS busy, CAST(sum(b.event_id) AS BIGINT) AS ids FROM w JOIN busy b ON w.user_id = b.user_id AND w.s < b.e AND b.s < w.e AND b.s < b.e GROUP BY 1",
    "windows_over_all": f"{_SPANS} SELECT a.event_id, count(*) AS windows, min(b.event_id) AS first FROM w a JOIN w b ON a.s < b.e AND b.s < a.e WHERE a.event_id % 5 > 1 GROUP BY 1",
    "image_hashes": f"WITH {_HASH} SELECT vec_id, visual_hash FROM h",
    "image_duplicates": f"""WITH {_HASH}, a AS (SELECT vec_id, label, visual_hash FROM h UNION ALL SELECT -vec_id - 1, label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END, visual_hash FROM h WHERE vec_id % 2 = 0)
        SELECT vec_id, min(label) OVER (PARTITION BY visual_hash) <> max(label) OVER (PARTITION BY visual_hash) AS duplicate FROM a""",
    "region_crops": f"""{layout._B}, r AS (SELECT page, region, x1 - CASE WHEN region % 19 = 0 THEN 200 ELSE 0 END AS x1, y1, x2, y2 FROM b),
        c AS (SELECT page, region, greatest(0, x1 - CAST(floor(greatest(1, x2 - x1) * 0.1::DOUBLE) AS INT)) AS x1, greatest(0, y1 - CAST(floor(greatest(1, y2 - y1) * 0.1::DOUBLE) AS INT)) AS y1,
            least(1000, x2 + CAST(floor(greatest(1, x2 - x1) * 0.1::DOUBLE) AS INT)) AS x2, least(1400, y2 + CAST(floor(greatest(1, y2 - y1) * 0.1::DOUBLE) AS INT)) AS y2 FROM r)
        SELECT page, region, x1, y1, x2, y2, x2 - x1 AS width, y2 - y1 AS height, (200 * (x2 - x1) + greatest(1, y2 - y1)) // (2 * greatest(1, y2 - y1)) / 100 AS aspect_ratio, ((x2 - x1) * (y2 - y1) * 20000 + 1400000) // 2800000 / 10000 AS relative_area,
            CAST(least(1536, greatest(32, floor(384 * ((x2 - x1) / (y2 - y1))))) AS INT) AS fitted_width FROM c""",
}
