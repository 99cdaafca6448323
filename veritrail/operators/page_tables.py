"""From a page's regions to a table, in one plan: gutters make columns, the most evenly spaced column gives the rows, what stands beside them goes into
cells, and the rows become Markdown and records.

Everything before the last step is joins and windows over a page; a page is what is brought together at the end. Defined results: regions of the
header and the footer are not of the table; a cell holds its regions' texts from the top, joined by blanks, blank ones left out; a column without a
region beside a row has an empty cell there; without a column of three regions the one with the most gives the rows, of equals the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.text import stripped
from veritrail.operators import layout
from veritrail.sources.catalog import materialise

LEAST_ANCHORS = 3


def anchored(items: DataFrame, page: str = "page", id: str = "region") -> DataFrame:
    """`items` (page, region, column, mid, ...) with `anchor`: whether their column is the one that gives the page's rows."""
    w = Window.partitionBy(page, "column").orderBy("mid", id)
    gaps = items.withColumn("gap", F.col("mid") - F.lag("mid").over(w)).groupBy(page, "column").agg(F.count("*").alias("n"), F.round(F.stddev_pop("gap"), 9).alias("spread"))
    many = F.col("n") >= LEAST_ANCHORS
    order = F.struct(F.when(many, 0).otherwise(1), F.when(many, F.col("spread")).otherwise(-F.col("n")), "column")
    chosen = gaps.groupBy(page).agg(F.min_by("column", order).alias("of"))
    return items.join(chosen, page).withColumn("anchor", F.col("column") == F.col("of")).drop("of")


def cells(items: DataFrame, page: str = "page", id: str = "region") -> DataFrame:
    """(page, row, column, text) of `items` with `anchor`, y1, y2, mid and text."""
    own = items.where("anchor").withColumn("row", F.row_number().over(Window.partitionBy(page).orderBy("mid", id)))
    beside = items.where("not anchor")
    rows = layout.cells_in_rows(items.where("anchor"), beside.select(page, id, F.col("mid").alias("y")), page, id)
    both = own.select(page, "row", "column", "mid", id, "text").unionByName(beside.join(rows, [page, id]).select(page, "row", "column", "mid", id, "text"))
    listed = F.array_sort(F.collect_list(F.struct("mid", id, stripped(F.coalesce("text", F.lit(""))).alias("t"))))
    return both.groupBy(page, "row", "column").agg(F.array_join(F.filter(F.transform(listed, lambda x: x["t"]), lambda t: t != ""), " ").alias("text"))


def page_tables(
    regions: DataFrame, width: int, height: int, headers: dict[int, list[str]] | None = None, clean: dict[str, Callable[[Column], Column]] | None = None, page: str = "page", id: str = "region"
) -> DataFrame:
    """(page, columns, rows, markdown, records): a row for each page with a region in its body.

    `headers`: names of the columns for pages of so many, "Column 1" and so on for others. `clean`: what is done to the cells of a column by its name.
    `records` is an array of maps from names to cells, a map for each row.
    """
    cut = layout.with_gutters(regions, width, height, page)
    body = cut.withColumn("zone", layout.zone(F.lit(width), F.lit(height))).where("zone = 1")
    placed = body.withColumns({"column": layout.column_of(F.col("gutters")), "columns": F.size("gutters") + 1, "mid": (F.col("y1") + F.col("y2")) / 2})
    # a page's regions are read by each of the joins below: they are found once
    found = materialise(placed.select(page, id, "column", "columns", "x1", "y1", "x2", "y2", "mid", "text"), "regions")
    items = materialise(anchored(found, page, id), "items")
    width_of = items.groupBy(page).agg(F.max("columns").alias("columns"))
    of_row = cells(items, page, id).groupBy(page, "row").agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("held"))
    listed = of_row.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("row", "held"))).alias("listed")).join(width_of, page)
    plain = F.transform(F.sequence(F.lit(1), F.col("columns")), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    named = plain
    for n, names in (headers or {}).items():
        named = F.when(F.col("columns") == n, F.array(*map(F.lit, names))).otherwise(named)

    def cell(row: Column, name: Column, at: Column) -> Column:
        held = F.coalesce(F.try_element_at(F.map_from_entries(row["held"]), at), F.lit(""))
        out = held
        for of, how in (clean or {}).items():
            out = F.when(name == of, how(held)).otherwise(out)
        return out

    rows = F.transform("listed", lambda r: F.transform("names", lambda name, at: cell(r, name, at)))
    line = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
    full = listed.withColumn("names", named).withColumn("cells", rows)
    head = F.array(line(F.col("names")), line(F.transform("names", lambda _: F.lit(":---"))))
    return full.select(
        page, "columns", F.size("cells").alias("rows"), F.array_join(F.concat(head, F.transform("cells", line)), "\n").alias("markdown"), F.transform("cells", lambda c: F.map_from_arrays("names", c)).alias("records"),
    )
