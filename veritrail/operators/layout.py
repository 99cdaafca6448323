"""Page regions: zones, reading order, columns, lines and question sections.

Rules that look at neighbours are windows over a page; the two that are greedy by definition, lines and overlap removal, sweep sorted pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, as shares of the page unless they are pixels or ratios.
TALL, HEADER_PIXELS, HEADER, WIDE_HEADER, FOOTER, SPANNING = 1.8, 45, 0.05, 0.18, 0.92, 0.55
BODY_TOP, VALLEY, GUTTER_PIXELS, COLUMN, LEAST_BOXES = 0.04, 0.12, 14, 0.12, 6
MARGINS, LAST_COLUMN, GROUPED = (0.08, 0.94), 0.6, 8
LEAD_IN, LEAD_OUT = 22, 15
OVERLAP, LINE_PIXELS, LINE_SHARE, SIDE_PIXELS, GROWTH, GAP = 0.70, 10, 0.4, 8, 1.6, 1.8


def split_tall(boxes: DataFrame, page: str = "page") -> DataFrame:
    """Boxes, those taller than 1.8 times their page's median height as two halves."""
    height = F.col("y2") - F.col("y1")
    middle = boxes.groupBy(page).agg(F.median(height).alias("median"))
    half = ((F.col("y1") + F.col("y2")) / 2).cast("int")
    parts = F.when(height > TALL * F.col("median"), F.array(F.struct("y1", half.alias("y2")), F.struct(half.alias("y1"), "y2"))).otherwise(F.array(F.struct("y1", "y2")))
    rest = [c for c in boxes.columns if c not in ("y1", "y2")]
    return boxes.join(middle, page).select(*rest, F.explode(parts).alias("part")).select(*rest, "part.y1", "part.y2")


def zone(width: Column, height: Column) -> Column:
    """0 header, 1 body, 2 footer."""
    spanning = (F.col("x2") - F.col("x1")) > SPANNING * width
    header = (F.col("y2") <= F.greatest(F.lit(HEADER_PIXELS), height * HEADER)) | ((F.col("y2") <= height * WIDE_HEADER) & spanning)
    return F.when(header, 0).when((F.col("y1") >= height * FOOTER) & spanning, 2).otherwise(1)


def reading_order(boxes: DataFrame, width: Column, height: Column, column: Column, page: str = "page", id: str = "region") -> DataFrame:
    """`boxes` with their place on the page: header, then column by column from top to bottom, then footer."""
    placed = boxes.withColumn("zone", zone(width, height)).withColumn("column", F.when(F.col("zone") == 1, column).otherwise(F.lit(0)))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("zone", "column", "y1", "x1", id)))


def valleys(boxes: DataFrame, width: float, height: float, page: str = "page") -> DataFrame:
    """(page, x1, x2) of gutters: stretches between the margins across which few of the body's narrow boxes reach.

    Boxes are swept from left to right: their number changes only where one begins or ends, so that a page's work grows with its boxes, not its pixels.
    """
    body = boxes.where((F.col("y1") >= BODY_TOP * height) & (F.col("y2") <= FOOTER * height) & ((F.col("x2") - F.col("x1")) < SPANNING * width))
    left, right = (int(m * width) for m in MARGINS)
    inside = lambda c: F.least(F.greatest(F.col(c).cast("int"), F.lit(left)), F.lit(right))
    end = lambda x, d: F.struct(x.alias("x"), F.lit(d).alias("d"))
    ends = body.select(page, F.explode(F.array(end(inside("x1"), 1), end(inside("x2"), -1), end(F.lit(left), 0), end(F.lit(right), 0))).alias("e")).select(page, "e.x", "e.d")
    by_x = ends.groupBy(page, "x").agg(F.sum("d").alias("d"), F.count_if(F.col("d") == 1).alias("begun"))
    w, all_ = Window.partitionBy(page).orderBy("x"), Window.partitionBy(page)
    level = by_x.select(page, "x", F.sum("d").over(w).alias("level"), F.lead("x").over(w).alias("next"), F.sum("begun").over(all_).alias("boxes")).where("next is not null")
    low = level.withColumn("low", F.col("level") <= VALLEY * F.max("level").over(all_))
    runs = low.withColumn("run", F.sum(F.when(F.col("low") != F.lag("low", 1, False).over(w), 1).otherwise(0)).over(w))
    found = runs.where(F.col("low") & (F.col("boxes") >= LEAST_BOXES)).groupBy(page, "run").agg(F.min("x").alias("x1"), F.max("next").alias("x2"))
    return found.where(F.col("x2") - F.col("x1") >= GUTTER_PIXELS).select(page, "x1", "x2")


def spaced_gutters(gutters: DataFrame, width: float, page: str = "page") -> DataFrame:
    """(page, gutters): middles of gutters from left to right. The first begins a column's width from the edge at least, the others lie as far from the
    one kept before them; the last goes if it leaves too narrow a column behind it."""
    least = int(COLUMN * width)
    listed = F.array_sort(F.collect_list(F.struct("x1", "x2")))

    def keep(kept: Column, g: Column) -> Column:
        mid = F.floor((g["x1"] + g["x2"]) / 2).cast("int")
        far = F.when(F.size(kept) == 0, g["x1"] >= least).otherwise(mid - F.try_element_at(kept, F.lit(-1)) >= least)
        return F.when(far, F.concat(kept, F.array(mid))).otherwise(kept)

    narrow = width - F.try_element_at("gutters", F.lit(-1)) < LAST_COLUMN * least
    found = gutters.groupBy(page).agg(listed.alias("listed")).select(page, F.aggregate("listed", F.array().cast("array<int>"), keep).alias("gutters"))
    return found.select(page, F.when(F.coalesce(narrow, F.lit(False)), F.slice("gutters", 1, F.size("gutters") - 1)).otherwise(F.col("gutters")).alias("gutters"))


def column_ranges(boxes: DataFrame, width: int, height: int, page: str = "page") -> DataFrame:
    """(page, column, x1, x2): the stretches between a page's gutters, one over the whole width where there are none."""
    found = spaced_gutters(valleys(boxes, width, height, page), width, page)
    cuts = F.concat(F.array(F.lit(0)), F.coalesce("gutters", F.array().cast("array<int>")), F.array(F.lit(width)))
    ranges = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct((i - 1).alias("column"), F.element_at("cuts", i).alias("x1"), F.element_at("cuts", i + 1).alias("x2")))
    return boxes.select(page).distinct().join(found, page, "left").withColumn("cuts", cuts).select(page, F.explode(ranges).alias("r")).select(page, "r.*")


def with_gutters(boxes: DataFrame, width: int, height: int, page: str = "page") -> DataFrame:
    """`boxes` with their page's `gutters`; pages of few boxes have none."""
    cuts = spaced_gutters(valleys(boxes, width, height, page), width, page)
    many = boxes.groupBy(page).agg(F.count("*").alias("_boxes")).where(F.col("_boxes") >= GROUPED)
    joined = boxes.join(many.join(cuts, page).select(page, "gutters"), page, "left")
    return joined.withColumn("gutters", F.coalesce("gutters", F.array().cast("array<int>")))


def in_columns(boxes: DataFrame, width: int, height: int, page: str = "page") -> DataFrame:
    """`boxes` with the column that holds their middle; pages of few boxes have one."""
    return with_gutters(boxes, width, height, page).withColumn("column", column_of(F.col("gutters"))).drop("gutters")


def column_of(gutters: Column) -> Column:
    """The number of gutters left of a box's middle."""
    return F.size(F.filter(gutters, lambda g: g <= (F.col("x1") + F.col("x2")) / 2))


def column_spans(boxes: DataFrame, width: int, page: str = "page", column: str = "column") -> DataFrame:
    """(page, column, x1, x2): columns numbered anew from 0, each reaching to the middle of the gutters at its sides, and a little over its boxes; boxes
    that span the page are of no column."""
    w = Window.partitionBy(page).orderBy(column)
    b = boxes.where(F.col("x2") - F.col("x1") < SPANNING * width).groupBy(page, column).agg(F.min("x1").alias("a"), F.max("x2").alias("b"))
    b = b.withColumns({"n": F.row_number().over(w) - 1, "before": F.lag("b").over(w), "after": F.lead("a").over(w)})
    left = F.greatest(F.lit(0), F.least(F.floor((F.col("before") + F.col("a")) / 2), F.col("a") - LEAD_IN))
    right = F.least(F.lit(width), F.greatest(F.floor((F.col("b") + F.col("after")) / 2), F.col("b") + LEAD_OUT))
    return b.select(page, F.col("n").alias("column"), F.when(F.col("before").isNull(), 0).otherwise(left).cast("int").alias("x1"), F.when(F.col("after").isNull(), width).otherwise(right).cast("int").alias("x2"))


def row_bands(anchors: DataFrame, page: str = "page", id: str = "region") -> DataFrame:
    """(page, row, low, high): each anchor's stretch of the page, to half-way to its neighbours, the outer ones open."""
    mid = (F.col("y1") + F.col("y2")) / 2
    w = Window.partitionBy(page).orderBy("mid", id)
    m = anchors.withColumn("mid", mid)
    return m.select(
        page, F.row_number().over(w).alias("row"), F.coalesce((F.lag("mid").over(w) + F.col("mid")) / 2, F.lit(0.0)).alias("low"),
        F.coalesce((F.lead("mid").over(w) + F.col("mid")) / 2, F.lit(float("inf"))).alias("high"),
    )


def cells_in_rows(anchors: DataFrame, cells: DataFrame, page: str = "page", id: str = "region") -> DataFrame:
    """`cells` (page, id, y) with the row of the anchor whose stretch y falls into.

    Bands and cells of a page stand in one order, and a cell takes the last band that begins at or before it: no pair of them is formed.
    """
    bands = row_bands(anchors, page, id).select(page, F.lit(None).cast(cells.schema[id].dataType).alias(id), F.when(F.col("row") == 1, float("-inf")).otherwise(F.col("low")).alias("y"), "row")
    both = bands.unionByName(cells.select(page, id, F.col("y").cast("double").alias("y"), F.lit(None).cast("int").alias("row")))
    before = Window.partitionBy(page).orderBy("y", F.col("row").asc_nulls_last(), id).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(page, id, F.col("row").isNull().alias("cell"), F.last("row", True).over(before).alias("row")).where(F.col("cell") & F.col("row").isNotNull()).drop("cell")


def anchor_gaps(boxes: DataFrame, page: str = "page", column: str = "column", id: str = "region") -> DataFrame:
    """(page, column) whose items are spaced most evenly, of columns with three items at least."""
    mid = (F.col("y1") + F.col("y2")) / 2
    w = Window.partitionBy(page, column).orderBy("mid", id)
    gaps = boxes.withColumn("mid", mid).withColumn("gap", F.col("mid") - F.lag("mid").over(w)).groupBy(page, column).agg(F.count("*").alias("n"), F.stddev_pop("gap").alias("spread")).where("n >= 3")
    return gaps.groupBy(page).agg(F.min_by(column, F.struct("spread", column)).alias(column))


def question_sections(lines: DataFrame, page: str, order: str, header: Column) -> DataFrame:
    """`lines` with the number of their section, 0 before the first header."""
    return lines.withColumn("section", F.sum(F.when(header, 1).otherwise(0)).over(Window.partitionBy(page).orderBy(order)))


class _Kept:
    """Boxes of a page that are kept, from the top, and still reach down to the next one."""

    def __init__(self) -> None:
        self.near: list[tuple] = []

    def take(self, x1, y1, x2, y2) -> bool:
        # boxes come from the top: one that ends above this one meets none that follows
        self.near = [k for k in self.near if k[3] > y1]
        area = max(1, (x2 - x1) * (y2 - y1))
        for a, b, c, d, of in self.near:
            wide, high = min(x2, c) - max(x1, a), min(y2, d) - max(y1, b)
            if wide > 0 and high > 0 and wide * high / min(area, of) > OVERLAP:
                return False
        self.near.append((x1, y1, x2, y2, area))
        return True


def _swept(boxes: DataFrame, keys: list[str], order: list[Column], make: Callable[[], Callable], columns: list[str], found: Callable, schema: T.StructType) -> DataFrame:
    """`found(batch, results)` of batches of `boxes`: each row's result is what a function that `make` gives anew for each of `keys` says of its `columns`, rows in `order`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, take = None, None
        for batch in batches:
            results = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if take is None or key != last:
                    last, take = key, make()
                results.append(take(*row))
            yield found(batch, results)

    return boxes.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def without_overlaps(boxes: DataFrame, page: str = "page") -> DataFrame:
    """Boxes, from the top, that lie in none of those kept before by more than 0.7 of the smaller area. A page is swept: only boxes that still reach down are remembered."""
    order = [F.asc_nulls_last(c) for c in ("y1", "x1", "region")]
    return _swept(boxes, [page], order, lambda: _Kept().take, ["x1", "y1", "x2", "y2"], lambda batch, kept: batch.filter(pa.array(kept, pa.bool_())), boxes.schema)


class _Line:
    """An open line: its box, the sum of its boxes' middles and their number, and their sides."""

    __slots__ = ("x2", "y1", "y2", "mids", "n", "sides")

    def __init__(self) -> None:
        self.x2, self.y1, self.y2, self.mids, self.n, self.sides = -1.0, float("inf"), float("-inf"), 0, 0, []

    def take(self, x1, y1, x2, y2) -> None:
        self.x2, self.y1, self.y2 = max(self.x2, x2), min(self.y1, y1), max(self.y2, y2)
        self.mids, self.n = self.mids + (y1 + y2) / 2, self.n + 1
        self.sides.append((x1, x2))

    def fits(self, x1, y1, x2, y2, median: float) -> bool:
        """Whether a box near enough can be of the line."""
        if any(min(x2, b) - max(x1, a) > SIDE_PIXELS for a, b in self.sides):
            return False
        own, height = y2 - y1, self.y2 - self.y1
        return max(self.y2, y2) - min(self.y1, y1) <= GROWTH * max(own, height, median) and x1 - self.x2 <= GAP * max(own, height)


class _Lines:
    """The lines of a column that a box may still join, and how many have begun."""

    def __init__(self) -> None:
        self.open: list[tuple[int, _Line]] = []
        self.begun = 0

    def take(self, x1, y1, x2, y2, median) -> int:
        mid, reach = (y1 + y2) / 2, max(LINE_PIXELS, LINE_SHARE * median)
        # middles only grow: a line whose own is out of reach from above is closed for good
        self.open = [x for x in self.open if mid - x[1].mids / x[1].n <= reach]
        near = [(away, k, line) for k, line in self.open if (away := abs(mid - line.mids / line.n)) <= reach and line.fits(x1, y1, x2, y2, median)]
        if near:
            _, k, line = min(near, key=lambda x: x[:2])
        else:
            k, line = self.begun, _Line()
            self.begun += 1
            self.open.append((k, line))
        line.take(x1, y1, x2, y2)
        return k + 1


def lines(boxes: DataFrame, page: str = "page", column: str = "column") -> DataFrame:
    """Boxes of each column, tall ones in two halves, with the line they belong to.

    From the top, by their middles: a box goes to the open line whose mean middle is nearest, of those that it fits in height and side by side, or
    begins a new one. A column is swept: only lines that are still in reach are remembered.
    """
    height = F.col("y2") - F.col("y1")
    middle = boxes.groupBy(page, column).agg(F.median(height).alias("median"))
    half = F.floor((F.col("y1") + F.col("y2")) / 2)
    parts = F.when(height > TALL * F.col("median"), F.array(F.struct("y1", half.cast(boxes.schema["y2"].dataType).alias("y2")), F.struct(half.cast(boxes.schema["y1"].dataType).alias("y1"), "y2"))).otherwise(F.array(F.struct("y1", "y2")))
    rest = [c for c in boxes.columns if c not in ("y1", "y2")]
    split = boxes.join(middle, [page, column]).select(*rest, F.explode(parts).alias("part"), "median").select(*rest, "part.y1", "part.y2", "median")
    schema = T.StructType([*(f for f in split.schema.fields if f.name != "median"), T.StructField("line", T.IntegerType())])
    order = [F.asc_nulls_last((F.col("y1") + F.col("y2")) / 2), F.asc_nulls_last("x1"), F.asc_nulls_last("region")]
    numbered = lambda batch, line: pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(line, pa.int32())], names=schema.names)
    return _swept(split, [page, column], order, lambda: _Lines().take, ["x1", "y1", "x2", "y2", "median"], numbered, schema)


def merged_lines(with_lines: DataFrame, page: str = "page", column: str = "column") -> DataFrame:
    """One box a line, numbered through the page column by column, with its boxes, their mean confidence and its proportions."""
    thousandths, n = F.sum(F.round(F.col("confidence") * 1000).cast("long")), F.count("confidence")
    of = with_lines.groupBy(page, column, "line").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("boxes"),
        (F.call_function("div", thousandths * 2 + n, F.nullif(n * 2, F.lit(0))) / 1000.0).alias("confidence"),
    )
    number = F.row_number().over(Window.partitionBy(page).orderBy(column, "line"))
    aspect = F.round((F.col("x2") - F.col("x1")) / F.greatest(F.lit(1), F.col("y2") - F.col("y1")), 2)
    return of.select(page, column, number.alias("line"), "x1", "y1", "x2", "y2", "boxes", "confidence", aspect.alias("aspect_ratio"))


def markdown(rows: DataFrame, page: str, order: str, cells: list[str]) -> DataFrame:
    """(page, table): the rows of each page as a table in Markdown."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c, F.lit("")) for c in cells)), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    head = "| " + " | ".join(cells) + " |\n|" + " --- |" * len(cells) + "\n"
    return rows.groupBy(page).agg(F.concat(F.lit(head), body).alias("table"))
