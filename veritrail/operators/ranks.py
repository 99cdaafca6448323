"""Running sums, ranks and exact quantiles over a whole table, without a window over all of it.

Rows are range-partitioned by the order, each partition adds up by itself, and the partitions' totals, one row each, are the only thing
that is summed up in one place. A value that very many rows share is one row by then: callers count rows by value first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.sources.catalog import materialise


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """`df` with, for each of `sums` {new column: column}, the sum over all rows before this one in `order`, which must not have ties."""
    dealt = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_off") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return summed.select(*df.columns, *((F.col(n) + F.col(f"{n}_off")).alias(n) for n in sums))


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...], by: str | None = None) -> DataFrame:
    """`q`, an array of the values at `shares`, between two rows in proportion; a row for each value of `by`, or one that holds nulls without rows."""
    keys = [by] if by else []
    counted = running(df.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n")), [*keys, "v"], {"before": "n"})
    total = counted.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("before").alias("first"))
    at = lambda p: F.lit(p) * (F.col("rows") - 1)
    begin = F.col("before") - F.col("first")
    here = lambda k: (begin <= k) & (k < begin + F.col("n"))
    ends = [F.max(F.when(here(end(at(p))), F.col("v"))).alias(f"{name}{i}") for i, p in enumerate(shares) for name, end in (("low", F.floor), ("high", F.ceil))]
    both = counted.join(F.broadcast(total), by) if by else counted.crossJoin(F.broadcast(total))
    got = both.groupBy(*keys).agg(*ends, F.max("rows").alias("rows"))
    part = [F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at(p) - F.floor(at(p))) for i, p in enumerate(shares)]
    return got.select(*keys, F.array(*part).alias("q"))
