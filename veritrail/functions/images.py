"""Grey pictures as arrays of numbers, row by row: made smaller by areas, and hashed by neighbours; and the geometry of regions that are cut out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.text import let

#: Columns and rows of the picture that a hash is taken from.
HASH_WIDTH, HASH_HEIGHT = 9, 8
#: The share of a region's sides that is cut out with it, and the height and widths of a region as readers take it.
MARGIN, READ_HEIGHT, NARROWEST, WIDEST = 0.10, 384, 32, 1536


def _shares(length: int, parts: int) -> list[list[tuple[int, float]]]:
    """For each of `parts` equal parts of a line of `length` cells, the cells that it covers and how much of each."""
    out = []
    for k in range(parts):
        begin, end = k * length / parts, (k + 1) * length / parts
        out.append([(i, min(i + 1, end) - max(i, begin)) for i in range(int(begin), min(length, int(-(-end // 1)))) if min(i + 1, end) > max(i, begin)])
    return out


def resized(pixels: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """A smaller picture: each of its points is the mean of the area that it covers, to the nearest whole number; null if the picture isn't `width` x `height`."""
    columns, rows = _shares(width, to_width), _shares(height, to_height)
    area = width * height / (to_width * to_height)
    point = lambda p, r, c: F.bround(sum(F.get(p, F.lit(y * width + x)) * (dy * dx) for y, dy in r for x, dx in c) / area)
    return let(pixels, lambda p: F.when(F.size(p) == width * height, F.array(*(point(p, r, c) for r in rows for c in columns))))


def dhash(grey: Column) -> Column:
    """16 hexadecimal digits of a 9 x 8 picture: a bit for each point and the one to its right, set if that is brighter; the first is the lowest."""
    places = [r * HASH_WIDTH + c for r in range(HASH_HEIGHT) for c in range(HASH_WIDTH - 1)]

    def digits(g: Column) -> Column:
        bit = lambda i: F.when(F.get(g, F.lit(places[i] + 1)) > F.get(g, F.lit(places[i])), 1).otherwise(0)
        nibble = lambda k: sum(bit(k * 4 + j) * 2**j for j in range(4))
        return F.when(F.size(g) == HASH_WIDTH * HASH_HEIGHT, F.lower(F.concat(*(F.hex(nibble(k)) for k in range(15, -1, -1)))))

    return let(grey, digits)


def crop(width: int, height: int) -> Column:
    """Struct of a box, from columns x1, y1, x2 and y2, with MARGIN of its sides around it inside a page of `width` x `height`; as it is where nothing of it is inside."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = (F.floor(F.greatest(F.lit(1), b - a) * F.lit(MARGIN)).cast("int") for a, b in ((x1, x2), (y1, y2)))
    padded = {"x1": F.greatest(F.lit(0), x1 - dx), "y1": F.greatest(F.lit(0), y1 - dy), "x2": F.least(F.lit(width), x2 + dx), "y2": F.least(F.lit(height), y2 + dy)}
    bare = {"x1": F.greatest(F.lit(0), x1), "y1": F.greatest(F.lit(0), y1), "x2": F.least(F.lit(width), x2), "y2": F.least(F.lit(height), y2)}
    empty = (padded["x2"] <= padded["x1"]) | (padded["y2"] <= padded["y1"])
    return F.struct(*(F.when(empty, bare[c]).otherwise(padded[c]).cast("int").alias(c) for c in padded))


def fitted_width(width: Column, height: Column) -> Column:
    """How wide a region is that is made READ_HEIGHT high, between the narrowest and the widest that a reader takes."""
    return F.least(F.lit(WIDEST), F.greatest(F.lit(NARROWEST), F.floor(READ_HEIGHT * (width / height)))).cast("int")


def _rounded(a: Column, b: Column, unit: int) -> Column:
    """a / b in whole parts of a `unit`, rounded half up."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("div", a * (2 * unit) + b, b * 2) / float(unit)


def region_features(box: Column, width: int, height: int) -> Column:
    """Struct of a cropped box's size, proportions and share of its page."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return F.struct(w.alias("width"), h.alias("height"), _rounded(w, F.greatest(F.lit(1), h), 100).alias("aspect_ratio"), _rounded(w * h, F.lit(max(1, width * height)), 10_000).alias("relative_area"), fitted_width(w, h).alias("fitted_width"))
