"""Clustering against plain rounds of full scans in whole numbers."""

import hashlib
import math
import random

import numpy as np
from helpers import SMALL, rows

from veritrail.llm import centroids

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(table, k=16, rounds=3, width=64, seed="1"):
    """Rows of the result, by python's own integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in table if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in first]

    def assigned():
        every = ([sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept)
        return [(d.index(min(d)), min(d)) for d in every]

    for _ in range(rounds):
        of = assigned()
        for c in range(len(centres)):
            mine = [v for (_, v), (at, _) in zip(kept, of) if at == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assigned()
    inertia = [sum(d for at, d in of if at == c) for c in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, at, d, inertia[at], sum(inertia), name[at]) for (i, _), (at, d) in zip(kept, of)), key=str)


def frame(spark, table):
    return spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "'mine' cluster", "'mine' id", "'mine' v", "'mine' low")


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_op13_query(spark):
    from veritrail.llm.queries import QUERIES

    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(QUERIES["op13_centroid_clusters"](spark, SMALL)) == plain(table)


def test_awkward_vectors(spark):
    draw = random.Random(5)
    table = [(i, [draw.choice([-0.5, 0.0, 0.015625, 0.25]) for _ in range(64)]) for i in range(80)]
    table += [(1, table[0][1]), (1, table[0][1]), (None, table[3][1]), (90, None), (91, [0.1] * 63), (92, [0.1] * 65), (93, [None] + [0.1] * 63), (94, [math.nan] + [0.1] * 63), (95, [math.inf] + [0.1] * 63)]
    table += [(96, [1e30] + [0.1] * 63), (97, [2.0e6] * 64), (98, [-2.0e6] * 64), (99, [])]
    assert got(centroids.cluster(frame(spark, table).repartition(3))) == plain(table)


def test_ties_few_vectors_and_none(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert got(centroids.cluster(frame(spark, same))) == plain(same)
    for few in ([(7, [0.25] * 64)], [(7, [0.25] * 64), (8, [0.5] * 64)], [], [(1, None)]):
        found = centroids.cluster(frame(spark, few))
        assert got(found) == plain(few) and sorted(found.columns) == sorted(NAMES)


def test_bounds_certify_what_a_scan_finds():
    """Centroids that move any way, over many rounds: assignments with bounds are a scan's, and most vectors are not scanned."""
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, (3000, 8))
    c = v[:12].copy()
    state = centroids.scanned(v, c, 4)
    scans = []
    for step in range(12):
        depth = 4 if step < 6 else 2
        fresh = c + rng.integers(-3, 4, c.shape) // (step + 1)
        cluster, distance, near, low, rest, used = centroids.moved(v, fresh, centroids.above(((fresh - c) ** 2).sum(axis=1)), depth, state[0], state[2], state[3], state[4])
        every = centroids.distances(v, fresh)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert (low <= np.sqrt(np.take_along_axis(every, near, axis=1))).all()
        others = np.ones(every.shape, bool)
        np.put_along_axis(others, near, False, axis=1)
        others[np.arange(len(v)), cluster] = False
        assert (rest <= np.sqrt(np.where(others, every, np.iinfo(np.int64).max).min(axis=1))).all()
        scans.append((used > depth).mean())
        c, state = fresh, (cluster, distance, near, low, rest)
    assert scans[-1] < 0.5


def test_large_whole_numbers_are_exact():
    v = np.array([[2**26, -(2**26), 1], [2**26 - 1, 3, -5]], np.int64)
    assert centroids.distances(v, v[::-1]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in v[::-1]] for x in v]
