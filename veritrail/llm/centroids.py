"""Centroid clustering of integer vectors with adaptive lower bounds.

Each vector keeps its centroid, the numbers of the next nearest ones with a lower bound of the distance to each, and one bound for all the rest.
When centroids move, a bound loses the way that its centroid went, the last one the longest way of any. The distance to a vector's own
centroid is taken exactly; a bound above it certifies that its centroid is farther. Stored centroids whose bounds don't are measured, and
all are if the bound of the rest doesn't: assignments are those of a full scan, ties at the smaller number. How many bounds are
stored falls to what the round before has used.

A round reads the table of the round before, writes its own and removes the other; no vector moves. The centroids, a number of rows that is a
parameter, are summed up by the tasks and pass through the driver.

Distances are whole numbers. A lost executor costs its tasks of one round. Defined results: a vector that is null, of another length, with a
null or non-finite component, or with one that is LARGEST or more either way (its distances would not fit into a long) is not kept and has no row;
a null id hashes as an empty one; rows that repeat an id are vectors of their own, and of first vectors with equal ids the smaller by
components comes first; with fewer vectors than centroids each is one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.sources.catalog import remove, written

SCALE, WIDTH, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
LARGEST = 1 << 27
#: Relative error that a bound allows for; rows that a task looks at together.
SLACK, STEP = 1e-12, 4096
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_STATE = "id long, v array<int>, cluster int, distance long, near array<int>, low array<double>, rest double, used int"


def whole(df: DataFrame, id: str, vector: str, width: int = WIDTH) -> DataFrame:
    """(id, v) of the kept vectors, components as floor(SCALE * x)."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return df.where((F.size(vector) == width) & usable).select(F.col(id).cast("long").alias("id"), ints.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in order: a top-k that each task takes before rows move."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all of v to all of c, exactly; products are of floats where these hold them."""
    exact = np.float64 if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22 else np.int64
    product = (v.astype(exact) @ c.astype(exact).T).astype(np.int64)
    return (v * v).sum(axis=1)[:, None] - 2 * product + (c * c).sum(axis=1)[None, :]


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 - SLACK)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 + SLACK)


def scanned(v: np.ndarray, c: np.ndarray, depth: int) -> tuple:
    """(cluster, distance, near, low, rest) by a full scan."""
    d = distances(v, c)
    order = np.argsort(d, axis=1, kind="stable")
    sorted_d = np.take_along_axis(d, order, axis=1)
    rest = below(sorted_d[:, depth + 1]) if depth + 1 < len(c) else np.full(len(v), np.inf)
    return order[:, 0].astype(np.int32), sorted_d[:, 0], order[:, 1 : depth + 1].astype(np.int32), below(sorted_d[:, 1 : depth + 1]), rest


def moved(v: np.ndarray, c: np.ndarray, way: np.ndarray, depth: int, cluster: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> tuple:
    """(cluster, distance, near, low, rest, used) after the centroids went `way` each; `used`: how many stored ones had to be measured, one more than all for a scan."""
    if depth < near.shape[1]:  # fewer are stored from now on: the farthest join the rest
        order = np.argsort(low, axis=1, kind="stable")
        near, low = np.take_along_axis(near, order, axis=1), np.take_along_axis(low, order, axis=1)
        rest = np.minimum(rest, low[:, depth:].min(axis=1))
        near, low = near[:, :depth], low[:, :depth]
    cluster, near = cluster.copy(), near.copy()
    low = low * (1 - SLACK) - way[near]
    rest = np.where(np.isinf(rest), rest, rest * (1 - SLACK) - way.max())
    gone = v - c[cluster]
    distance = (gone * gone).sum(axis=1)
    reach = above(distance)
    open_slots = low <= reach[:, None]
    used = open_slots.sum(axis=1).astype(np.int32)
    row, slot = np.nonzero(open_slots & (rest > reach)[:, None])
    if len(row):
        gone = v[row] - c[near[row, slot]]
        d = (gone * gone).sum(axis=1)
        low[row, slot] = below(d)
        order = np.lexsort((near[row, slot], d, row))
        first = order[np.unique(row[order], return_index=True)[1]]  # the nearest measured one of each row
        at, to = row[first], slot[first]
        nearer = (d[first] < distance[at]) | ((d[first] == distance[at]) & (near[at, to] < cluster[at]))
        at, to, best = at[nearer], to[nearer], d[first][nearer]
        low[at, to] = below(distance[at])
        cluster[at], near[at, to] = near[at, to], cluster[at]
        distance[at] = best
    anew = np.flatnonzero(rest <= reach)
    if len(anew):
        cluster[anew], distance[anew], near[anew], low[anew], rest[anew] = scanned(v[anew], c, depth)
        used[anew] = near.shape[1] + 1
    return cluster, distance, near, low, rest, used


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _assigned(before: DataFrame, centroids: np.ndarray, way: np.ndarray | None, depth: int) -> DataFrame:
    """The state of each vector with these centroids; from vectors alone if `way` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, STEP):
                batch = whole_batch.slice(at, STEP)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                v = _matrix(column("v"), np.int64)
                if way is None:
                    got = (*scanned(v, centroids, depth), np.full(len(v), depth + 1, np.int32))
                else:
                    got = moved(v, centroids, way, depth, column("cluster").to_numpy(), _matrix(column("near"), np.int32), _matrix(column("low"), float), column("rest").to_numpy().copy())
                cluster, distance, near, low, rest, used = got
                yield pa.RecordBatch.from_arrays(
                    [column("id"), column("v"), pa.array(cluster), pa.array(distance), _lists(near), _lists(low), pa.array(rest), pa.array(used)],
                    names=["id", "v", "cluster", "distance", "near", "low", "rest", "used"],
                )

    return before.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]], int]:
    """Vectors of each centroid, the sums of their components, and the most stored bounds that any of them has used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, used = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int32)
        for batch in batches:
            cluster, v = batch.column(0).to_numpy(), _matrix(batch.column(1), np.int64)
            rows += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
            np.maximum.at(used, cluster, batch.column(2).to_numpy())
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(rows[at]), pa.array(used[at]), *(pa.array(total[at, i]) for i in range(width))], names=["cluster", "n", "used", *(f"s{i}" for i in range(width))])

    parts = state.select("cluster", "v", "used").mapInArrow(run, "cluster int, n long, used int, " + ", ".join(f"s{i} long" for i in range(width)))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("used").alias("used"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))).collect()
    rows, sums = np.zeros(k, np.int64), [[0] * width for _ in range(k)]
    for r in found:
        rows[r["cluster"]], sums[r["cluster"]] = r["n"], [int(r[f"s{i}"]) for i in range(width)]
    return rows, sums, max((r["used"] for r in found), default=0)


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, width: int = WIDTH) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = df.sparkSession
    vectors = whole(df, id, vector, width)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    k = len(centroids)
    depth = min(max(k // 4, 1), k - 1)
    state, at = written(_assigned(vectors, centroids, None, depth), "centroids")
    for _ in range(rounds):
        n, sums, used = _sums(state, k, width)
        fresh = np.array([[s // int(n[c]) for s in sums[c]] if n[c] else centroids[c].tolist() for c in range(k)], np.int64)
        way = above(((fresh - centroids) ** 2).sum(axis=1))
        if used <= depth:
            depth = min(depth, max(used, k // 8, 1))
        centroids = fresh
        state, then = written(_assigned(state, centroids, way, depth), "centroids")
        remove(spark, at)
        at = then
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return state.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of([long(inertia.get(c, 0)) for c in range(k)]).alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), of(map(F.lit, names)).alias("centroid_sha256")
    )
