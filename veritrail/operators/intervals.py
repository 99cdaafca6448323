"""Pairs of intervals that overlap, by time bins on several levels.

An interval's level is the width of bins, in powers of FAN from the narrowest, that its length calls for, so that it covers two bins there at most. On its
own level and on every wider one it is entered into the bins that it covers. A pair meets on the wider of both levels: the one that belongs there with the
other, which is no longer than that level's bins. Rows therefore grow with the number of levels, not with the lengths, and a pair that meets in two bins
counts in the one where the later of both begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times that a level's bins are as wide as those of the level below, and the number of levels.
FAN, LEVELS = 8, 12
#: Stretches of time that overlaps without a key are summed up in, and what no id is greater than.
BINS, NONE = 256, np.iinfo(np.int64).max


def _entered(df: DataFrame, side: str, keys: list[str], start: str, end: str, narrow: float) -> DataFrame:
    """Rows of `df` as `side`, once for each level from their own up and each bin there."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    micros, length = int(narrow * 1_000_000), seconds(end) - seconds(start)
    own = F.least(F.greatest(F.ceil(F.log(float(FAN), F.greatest(length, F.lit(1)) / micros)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    level = F.explode(F.sequence(F.col("_own"), F.lit(LEVELS - 1)))
    width = F.least(F.pow(F.lit(float(FAN)), F.col("_level")) * micros, F.lit(2.0**61)).cast("long")
    bins = df.where((F.col(start) < F.col(end)) & F.col(start).isNotNull()).withColumn("_own", own).select("*", level.alias("_level")).withColumn("_width", width)
    first, last = F.floor(seconds(start) / F.col("_width")), F.floor((seconds(end) - 1) / F.col("_width"))
    return bins.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_level", F.explode(F.sequence(first, last)).alias("_bin"), (F.col("_own") == F.col("_level")).alias(f"_home_{side}"),
        first.alias(f"_first_{side}"), F.struct(*df.columns).alias(side),
    )


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, keys: list[str] | None = None, narrow: float = 60.0) -> DataFrame:
    """(left, right), structs of rows whose intervals [start, end) overlap and whose `keys` are equal, each pair once.

    `narrow`: seconds of the narrowest bins. Intervals that are empty, or have a null end, overlap with nothing.
    """
    keys = keys or []
    a, b = _entered(left, "left", keys, start, end, narrow), _entered(right, "right", keys, start, end, narrow)
    on = [*(f"_k{i}" for i in range(len(keys))), "_level", "_bin"]
    meet = a.join(b, on).where((F.col("_home_left") | F.col("_home_right")) & (F.col("_bin") == F.greatest("_first_left", "_first_right")))
    # on a level that is the own one of neither or above both, the pair has met below
    return meet.where(_crosses(start, end)).select("left", "right")


def _crosses(start: str, end: str) -> Column:
    return (F.col(f"left.{start}") < F.col(f"right.{end}")) & (F.col(f"right.{start}") < F.col(f"left.{end}"))


def overlap_summary(left: DataFrame, right: DataFrame, start: str, end: str, id: str) -> DataFrame:
    """(id, n, first) for each id on the left whose interval overlaps with any on the right: with how many, and their smallest id. Ids are long.

    No pair is formed. What overlaps is what begins before the end, less what ends before the beginning: two ranks. Time is cut into BINS stretches of
    about as many beginnings; an interval goes to the ones where it begins and ends, and is ranked there. What begins, ends or lies across whole
    stretches is summed up by pairs of stretches, a table that doesn't grow with the rows.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # `last` is the last microsecond inside
    sides = [df.where(F.col(start) < F.col(end)).select(F.col(id).cast("long").alias("id"), micros(start).alias("s"), (micros(end) - 1).alias("last"), F.lit(k).alias("side")) for k, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1])
    cuts = np.unique(np.array(both.approxQuantile("s", [k / BINS for k in range(1, BINS)], 0.001), dtype=np.int64))
    bins = len(cuts) + 1

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.searchsorted(cuts, batch.column(c).to_numpy(), "right") for c in ("s", "last")]
            for k, rows in ((0, np.arange(len(ends[0]))), (1, np.flatnonzero(ends[0] != ends[1]))):
                own, at = batch.take(pa.array(rows)), [e[rows] for e in ends]
                yield pa.RecordBatch.from_arrays([pa.array(at[k].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in at), *own.columns], names=["bin", "begins", "ends", *own.schema.names])

    entered = both.mapInArrow(enter, "bin int, begins int, ends int, id long, s long, last long, side int")
    whole = entered.where("side = 1 and bin = begins").groupBy("begins", "ends").agg(F.count("*").alias("n"), F.min("id").alias("first")).toPandas()
    b, e, n, first = (whole[c].to_numpy(dtype=np.int64) for c in ("begins", "ends", "n", "first"))
    begun, ended = (np.concatenate([[0], np.cumsum(np.bincount(x, n, minlength=bins).astype(np.int64))]) for x in (b, e))
    begins, across = np.full(bins, NONE), np.full(bins, NONE)
    np.minimum.at(begins, b, first)
    for x, y, f in zip(b, e, first, strict=True):
        across[x + 1 : y] = np.minimum(across[x + 1 : y], f)
    #: By first and last stretch: the smallest id of what lies across any of them, or begins in one between.
    between = np.full((bins, bins), NONE)
    for x in range(bins):
        between[x, x:] = np.minimum.accumulate(across[x:])
        between[x, x + 2 :] = np.minimum(between[x, x + 2 :], np.minimum.accumulate(begins[x + 1 : -1]))

    def ranked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, (begins_, ends_, ids, s, last, side) = key[0].as_py(), (table.column(c).to_numpy() for c in ("begins", "ends", "id", "s", "last", "side"))
        x, y = side == 0, side == 1
        opens = begins_[x] == at
        starts, stops = np.sort(s[y & (begins_ == at)]), np.sort(last[y & (ends_ == at)])
        n = np.where(ends_[x] == at, begun[at] + np.searchsorted(starts, last[x], "right"), 0) - np.where(opens, ended[at] + np.searchsorted(stops, s[x], "left"), 0)
        found = np.minimum(_least_met(s[x], last[x], s[y], last[y], ids[y]), np.where(opens, between[begins_[x], ends_[x]], NONE))
        return pa.table({"id": ids[x], "n": n.astype(np.int64), "first": found.astype(np.int64)})

    parts = entered.groupBy("bin").applyInArrow(ranked, "id long, n long, first long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")


def _least_met(s: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each [s, last] the smallest of `ids` whose [start, stop] meets it: the least of what begins inside, and of what holds its beginning."""
    order = np.argsort(starts, kind="stable")
    sorted_, least = starts[order], [ids[order]]
    while (half := 1 << (len(least) - 1)) < len(ids):
        before = least[-1]
        least.append(np.concatenate([np.minimum(before[:-half], before[half:]), before[-half:]]))
    found = np.full(len(s), NONE)
    low, high = np.searchsorted(sorted_, s, "right"), np.searchsorted(sorted_, last, "right")
    _by_power(low, high, lambda k, at, a, b: found.__setitem__(at, np.minimum(least[k][a], least[k][b])))
    # the other way round: an interval is written over the beginnings that it holds, as two stretches of a power of two, and these are handed down
    asked = np.argsort(s, kind="stable")
    power = max(1, len(s).bit_length())
    held = np.full((power, len(s)), NONE)
    low, high = np.searchsorted(s[asked], starts, "left"), np.searchsorted(s[asked], stops, "right")

    def write(k: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        np.minimum.at(held[k], a, ids[at])
        np.minimum.at(held[k], b, ids[at])

    _by_power(low, high, write)
    for k in range(power - 1, 0, -1):
        half = 1 << (k - 1)
        held[k - 1] = np.minimum(held[k - 1], held[k])
        held[k - 1][half:] = np.minimum(held[k - 1][half:], held[k][:-half])
    found[asked] = np.minimum(found[asked], held[0])
    return found


def _by_power(low: np.ndarray, high: np.ndarray, use) -> None:
    """`use(k, which, from, from)` for ranges [low, high) that aren't empty, as two stretches of 2^k that cover each."""
    size = high - low
    power = np.frexp(np.maximum(size, 1))[1] - 1
    for k in np.unique(power[size > 0]):
        at = np.flatnonzero((size > 0) & (power == k))
        use(int(k), at, low[at], high[at] - (1 << int(k)))
