"""Queries over page regions, and the same in SQL. Events play the regions: a user is a page of 1000 by 1400 pixels with two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.text import numeric_code
from veritrail.operators import layout
from veritrail.operators import page_tables as page_table_plans
from veritrail.sources.catalog import table

WIDTH, HEIGHT = 1000, 1400


def regions(spark: SparkSession, d: str) -> DataFrame:
    id = F.col("event_id")
    x1, y1 = (id % 2 * 480 + 60 + id % 23).cast("int"), (id * 53 % 1330).cast("int")
    wide = F.when(id % 17 == 0, 600).otherwise(300 + id % 90).cast("int")
    return table(spark, d, "events").select(F.col("user_id").alias("page"), id.alias("region"), x1.alias("x1"), y1.alias("y1"), (x1 + wide).alias("x2"), (y1 + 20 + id % 31).cast("int").alias("y2"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Columns as the gutters make them."""
    return layout.reading_order(layout.in_columns(regions(spark, d), WIDTH, HEIGHT), F.lit(WIDTH), F.lit(HEIGHT), F.col("column")).select("page", "region", "zone", "column", "place")


def column_gutters(spark: SparkSession, d: str) -> DataFrame:
    """L4, A26, W5, W6."""
    return layout.valleys(regions(spark, d), WIDTH, HEIGHT)


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns between the gutters that are kept."""
    return layout.column_ranges(regions(spark, d), WIDTH, HEIGHT)


def boxes_in_columns(spark: SparkSession, d: str) -> DataFrame:
    """L5, J14."""
    return layout.in_columns(regions(spark, d), WIDTH, HEIGHT).select("page", "region", "column")


def column_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of columns whose numbers have gaps."""
    return layout.column_spans(regions(spark, d).withColumn("column", F.col("region") % 2 * 5 + 2), WIDTH)


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each column, as boxes."""
    sure = layout.in_columns(regions(spark, d), WIDTH, HEIGHT).withColumn("confidence", (F.col("region") % 100) / 100)
    return layout.merged_lines(layout.lines(sure))


def without_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that no other covers."""
    return layout.without_overlaps(regions(spark, d)).select("page", "region")


def split_boxes(spark: SparkSession, d: str) -> DataFrame:
    """L1, A25."""
    return layout.split_tall(regions(spark, d))


def row_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the second column per row of the first."""
    r = regions(spark, d)
    cells = r.where("region % 2 = 1").withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    return layout.cells_in_rows(r.where("region % 2 = 0"), cells).groupBy("page", "row").agg(F.count("*").alias("cells"))


def anchor_column(spark: SparkSession, d: str) -> DataFrame:
    """L6, W3."""
    return layout.anchor_gaps(regions(spark, d).withColumn("column", F.col("region") % 2))


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """From a page's regions to a table in Markdown and records, pages of two columns with names of their own."""
    said = table(spark, d, "events").select(F.col("event_id").alias("region"), F.concat(F.lit(" I"), F.col("event_type"), F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("text"))
    clean = {"Kind": lambda t: F.upper(t), "Number": numeric_code}
    found = page_table_plans.page_tables(regions(spark, d).join(said, "region"), WIDTH, HEIGHT, {2: ["Kind", "Number"]}, clean)
    return found.select("page", "columns", "rows", "markdown", F.to_json("records").alias("records"))


def question_sections(spark: SparkSession, d: str) -> DataFrame:
    """The header rule of L12 alone."""
    return layout.question_sections(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


def conversation_tables(spark: SparkSession, d: str) -> DataFrame:
    """L7, V12."""
    c = table(spark, d, "conversations").withColumn("length", F.length("text").cast("string"))
    return layout.markdown(c, "conv_id", "turn", ["role", "length"])


QUERIES = {f.__name__: f for f in (reading_order, column_gutters, page_columns, boxes_in_columns, column_spans, text_lines, without_overlaps, split_boxes, row_alignment, anchor_column, page_tables, question_sections, conversation_tables)}
_B = """WITH b AS (SELECT user_id AS page, event_id AS region, event_id % 2 * 480 + 60 + event_id % 23 AS x1, event_id * 53 % 1330 AS y1,
    event_id % 2 * 480 + 60 + event_id % 23 + CASE WHEN event_id % 17 = 0 THEN 600 ELSE 300 + event_id % 90 END AS x2, event_id * 53 % 1330 + 20 + event_id % 31 AS y2 FROM events)"""
_G = f"""{_B}, n AS (SELECT * FROM b WHERE y1 >= 56 AND y2 <= 1288 AND x2 - x1 < 550),
    e AS (SELECT page, least(greatest(x1, 80), 940) AS x, 1 AS d FROM n UNION ALL SELECT page, least(greatest(x2, 80), 940), -1 FROM n UNION ALL SELECT DISTINCT page, unnest([80, 940]), 0 FROM n),
    l AS (SELECT page, x, sum(sum(d)) OVER w AS level, lead(x) OVER w AS next FROM e GROUP BY page, x WINDOW w AS (PARTITION BY page ORDER BY x)),
    o AS (SELECT *, level <= 0.12 * max(level) OVER (PARTITION BY page) AS low FROM l WHERE next IS NOT NULL),
    s AS (SELECT *, count(*) FILTER (NOT low) OVER (PARTITION BY page ORDER BY x) AS run FROM o),
    g AS (SELECT page, min(x) AS x1, max(next) AS x2 FROM s WHERE low AND page IN (SELECT page FROM n GROUP BY 1 HAVING count(*) >= 6) GROUP BY page, run HAVING max(next) - min(x) >= 14)"""
#: Gutters one by one: the last that is kept decides on the next.
_K = f"""{_G.replace("WITH b", "WITH RECURSIVE b")}, i AS (SELECT *, (x1 + x2) // 2 AS mid, row_number() OVER (PARTITION BY page ORDER BY x1) AS k FROM g),
    f AS (SELECT page, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT page FROM g)
        UNION ALL SELECT i.page, i.k, CASE WHEN (len(kept) = 0 AND x1 >= 120) OR (len(kept) > 0 AND mid - kept[-1] >= 120) THEN list_append(kept, mid) ELSE kept END FROM f JOIN i ON i.page = f.page AND i.k = f.k + 1),
    q AS (SELECT page, CASE WHEN len(kept) > 0 AND 1000 - kept[-1] < 72 THEN kept[:-2] ELSE kept END AS cuts FROM f WHERE (page, k) IN (SELECT (page, max(k)) FROM f GROUP BY page)),
    m AS (SELECT page FROM b GROUP BY 1 HAVING count(*) >= 8),
    c AS (SELECT b.*, len(list_filter(coalesce(CASE WHEN page IN (SELECT page FROM m) THEN cuts END, []), lambda t: t <= (x1 + x2) / 2)) AS of FROM b LEFT JOIN q USING (page))"""
SQL = {
    "reading_order": f"""{_K}, z AS (SELECT *, CASE WHEN y2 <= 70 OR (y2 <= 252 AND x2 - x1 > 550) THEN 0 WHEN y1 >= 1288 AND x2 - x1 > 550 THEN 2 ELSE 1 END AS zone FROM c),
        d AS (SELECT *, CASE WHEN zone = 1 THEN of ELSE 0 END AS "column" FROM z)
        SELECT page, region, zone, "column", row_number() OVER (PARTITION BY page ORDER BY zone, "column", y1, x1, region) AS place FROM d""",
    "column_gutters": f"{_G} SELECT page, x1, x2 FROM g",
    "page_columns": f"""{_K}, r AS (SELECT page, list_concat([0], coalesce(cuts, []), [1000]) AS cuts FROM (SELECT DISTINCT page FROM b) LEFT JOIN q USING (page))
        SELECT page, i - 1 AS "column", cuts[i] AS x1, cuts[i + 1] AS x2 FROM (SELECT page, cuts, unnest(range(1, len(cuts))) AS i FROM r)""",
    "boxes_in_columns": f'{_K} SELECT page, region, of AS "column" FROM c',
    "column_spans": f"""{_B}, s AS (SELECT page, region % 2 AS c, min(x1) AS x1, max(x2) AS x2 FROM b WHERE x2 - x1 < 550 GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER w - 1 AS k, lag(x2) OVER w AS before, lead(x1) OVER w AS after FROM s WINDOW w AS (PARTITION BY page ORDER BY c))
        SELECT page, k AS "column", CASE WHEN before IS NULL THEN 0 ELSE greatest(0, least((before + x1) // 2, x1 - 22)) END AS x1,
            CASE WHEN after IS NULL THEN 1000 ELSE least(1000, greatest((x2 + after) // 2, x2 + 15)) END AS x2 FROM n""",
    "without_overlaps": f"""{_B.replace("WITH b", "WITH RECURSIVE b")}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, region) AS k FROM b),
        w AS (SELECT page, 0::BIGINT AS k, [] ::STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS kept, NULL::BIGINT AS region FROM (SELECT DISTINCT page FROM b)
            UNION ALL SELECT page, k, CASE WHEN free THEN list_append(kept, box) ELSE kept END, CASE WHEN free THEN region END
            FROM (SELECT o.page, o.k, o.region, w.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}} AS box, len(list_filter(w.kept, lambda q:
                greatest(0, least(o.x2, q.x2) - greatest(o.x1, q.x1)) * greatest(0, least(o.y2, q.y2) - greatest(o.y1, q.y1)) / least(greatest(1, (o.x2 - o.x1) * (o.y2 - o.y1)), greatest(1, (q.x2 - q.x1) * (q.y2 - q.y1))) > 0.7::DOUBLE)) = 0 AS free
                FROM w JOIN o ON o.page = w.page AND o.k = w.k + 1))
        SELECT page, region FROM w WHERE region IS NOT NULL""",
    "split_boxes": f"""{_B}, m AS (SELECT *, median(y2 - y1) OVER (PARTITION BY page) AS mid FROM b)
        SELECT page, region, x1, x2, y1, CASE WHEN y2 - y1 > 1.8::DOUBLE * mid THEN (y1 + y2) // 2 ELSE y2 END AS y2 FROM m UNION ALL SELECT page, region, x1, x2, (y1 + y2) // 2, y2 FROM m WHERE y2 - y1 > 1.8::DOUBLE * mid""",
    "row_alignment": f"""{_B}, r AS (SELECT *, (y1 + y2) / 2 AS y FROM b), a AS (SELECT page, row_number() OVER w AS row, coalesce((lag(y) OVER w + y) / 2, 0) AS low, coalesce((lead(y) OVER w + y) / 2, 1e9) AS high
            FROM r WHERE region % 2 = 0 WINDOW w AS (PARTITION BY page ORDER BY y, region))
        SELECT r.page, row, count(*) AS cells FROM r JOIN a ON r.page = a.page AND y >= low AND y < high WHERE region % 2 = 1 GROUP BY 1, 2""",
    "anchor_column": f"""{_B}, g AS (SELECT page, region % 2 AS c, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER (PARTITION BY page, region % 2 ORDER BY (y1 + y2) / 2, region) AS gap FROM b),
        s AS (SELECT page, c, round(stddev_pop(gap), 9) AS spread FROM g GROUP BY 1, 2 HAVING count(*) >= 3) SELECT page, min_by(c, (spread, c)) AS "column" FROM s GROUP BY 1""",
    "page_tables": f"""{_K}, t AS (SELECT event_id AS region, ' I' || event_type || ' ' || CAST(value AS VARCHAR) || ' ' AS text FROM events),
        p AS (SELECT c.*, text, (y1 + y2) / 2 AS mid, len(coalesce(CASE WHEN page IN (SELECT page FROM m) THEN cuts END, [])) + 1 AS columns FROM c JOIN t USING (region) LEFT JOIN q USING (page)
            WHERE NOT (y2 <= 70 OR (y2 <= 252 AND x2 - x1 > 550) OR (y1 >= 1288 AND x2 - x1 > 550))),
        gap AS (SELECT page, of, mid - lag(mid) OVER (PARTITION BY page, of ORDER BY mid, region) AS gap FROM p),
        spread AS (SELECT page, of, count(*) AS n, round(stddev_pop(gap), 9) AS spread FROM gap GROUP BY 1, 2),
        pick AS (SELECT page, of AS anchor FROM spread QUALIFY row_number() OVER (PARTITION BY page ORDER BY n < 3, CASE WHEN n >= 3 THEN spread ELSE -n END, of) = 1),
        band AS (SELECT page, region, row_number() OVER w AS row, coalesce((lag(mid) OVER w + mid) / 2, -1e9) AS low, coalesce((lead(mid) OVER w + mid) / 2, 1e9) AS high FROM p JOIN pick USING (page) WHERE of = anchor WINDOW w AS (PARTITION BY page ORDER BY mid, region)),
        held AS (SELECT p.page, row, of, mid, p.region, text FROM p JOIN band USING (page, region) UNION ALL
            SELECT p.page, row, of, mid, p.region, text FROM p JOIN pick USING (page) JOIN band ON band.page = p.page AND mid >= low AND mid < high WHERE of <> anchor),
        cell AS (SELECT page, row, of, string_agg(trim(text), ' ' ORDER BY mid, region) AS text FROM held GROUP BY 1, 2, 3),
        size AS (SELECT page, max(columns) AS columns FROM p GROUP BY 1), slot AS (SELECT page, columns, unnest(range(0, columns)) AS of FROM size), lineup AS (SELECT DISTINCT page, row FROM cell),
        named AS (SELECT page, row, columns, of, CASE WHEN columns = 2 THEN ['Kind', 'Number'][of + 1] ELSE 'Column ' || (of + 1) END AS name, coalesce(text, '') AS raw FROM lineup JOIN slot USING (page) LEFT JOIN cell USING (page, row, of)),
        done AS (SELECT *, CASE name WHEN 'Kind' THEN upper(raw) WHEN 'Number' THEN regexp_replace(translate(upper(raw), 'OILSBG', '011586'), '[^0-9]', '', 'g') ELSE raw END AS text FROM named),
        line AS (SELECT page, row, columns, '| ' || string_agg(text, ' | ' ORDER BY of) || ' |' AS line, '{{' || string_agg('"' || name || '":"' || text || '"', ',' ORDER BY of) || '}}' AS record,
            '| ' || string_agg(name, ' | ' ORDER BY of) || ' |' AS head, '| ' || string_agg(':---', ' | ' ORDER BY of) || ' |' AS rule FROM done GROUP BY 1, 2, 3)
        SELECT page, CAST(columns AS INT) AS columns, CAST(count(*) AS INT) AS rows, any_value(head) || chr(10) || any_value(rule) || chr(10) || string_agg(line, chr(10) ORDER BY row) AS markdown,
            '[' || string_agg(record, ',' ORDER BY row) || ']' AS records FROM line GROUP BY page, columns""",
    "question_sections": "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations",
    "conversation_tables": """SELECT conv_id, '| role | length |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || length(text) || ' |', chr(10) ORDER BY turn) AS "table" FROM conversations GROUP BY 1""",
}
