"""N-gram Jaccard join with signature trees, and the components of its links.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal sets form a class; its smallest id stands for it, and
   from here on only these texts are looked at.
2. Any two sets a, b with the wanted similarity t share at least k shingles among the first |a| - ceil(t|a|) + k of a and as many of b, in any
   common order of shingles. The order takes shingles that many texts share last; that list is bounded and bears on the cost only, never
   on the result. Texts of compatible sizes that share k such shingles are tied: those that few texts have are counted, of others each text has
   so many at most. What shares none of the first kind has k of the second by itself, so that only texts that have as many are tied along
   a shingle that more than FEW texts have, each to the next by size: those rows lie in ranges of (shingle, size, id), and no shingle is
   one task's. Texts of one template that are not alike enough have too few of these. The components of these ties hold all possible links.
3. Inside a component, signature trees are built over blocks of sets: a node holds the OR of its sets' bitmaps, their range of sizes and the
   most shingles that share a bit with another. Two trees are walked together; a pair of nodes whose bitmaps and sizes allow too small an
   overlap is left with all below it. Pairs of sets that remain are compared exactly, unless links found before join them already.
4. The components of the links, with every class at its smallest id.

A component of more than BLOCK classes is cut into blocks by size, from counts. First each block is compared with itself and the next one; in a
group of near copies that links nearly all. What then isn't in the component's largest part is compared, in blocks of its own, with all blocks of
compatible sizes; pairs inside the largest part need no look. No group is larger than about two blocks.

Defined results: a null or blank text has no shingles and is linked with nothing; so is a row without id (component null); rows that repeat an
id are judged each by its own text; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shingles import mix, shingles, stretches, text_bytes, words
from veritrail.operators.graph import connected_components
from veritrail.sources.catalog import materialise, remove, written

WIDTH = 5
#: Of the similarity, in hundredths.
PERCENT = 80
#: Shingles that are taken last, at most, and of how many copies at least; after how many shingles a task counts anew.
COMMON, LEAST_COMMON, COUNTED = 1 << 17, 16, 1 << 22
#: Texts that share a shingle and are still paired one by one; a set of n shingles must share n // SHARE + 2 with another.
FEW, SHARE = 64, 16
BLOCK, FAN_OUT, CHUNK = 256, 8, 1 << 14


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    raw = text_bytes(batch.column(batch.schema.get_field_index(text)))
    for part in stretches([len(x) for x in raw]):
        yield from map(np.unique, shingles(*words(raw[part]), width))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def shingle_sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, class) of each text; and (token, copies) of shingles that tasks saw in two texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        size = 0
        names = ["id", "n", "class", "token", "copies"]

        def common() -> pa.RecordBatch:
            token, copies = np.unique(np.concatenate(seen), return_counts=True)
            token, copies = _signed(token[copies > 1]), copies[copies > 1]
            none = pa.nulls(len(token))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(token), pa.array(copies)], names=names)

        for batch in batches:
            n, key = [], []
            for s in _sets(batch, "text", width):
                n.append(len(s))
                key.append(_class(s))
                seen.append(s)
                size += len(s)
                if size > COUNTED:
                    yield common()
                    seen, size = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(n, pa.int64()), pa.array(key, pa.binary()), none, none], names=names)
        if seen:
            yield common()

    both = materialise(docs.mapInArrow(run, "id long, n long, class binary, token long, copies long"), "sets")
    return both.where("n is not null").select("id", "n", "class"), both.where("copies is not null").select("token", "copies")


def _common(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and how many texts they were seen in: those of LEAST_COMMON copies, or of as many more as leave no more than COMMON of them."""
    total, place = written(shared.groupBy("token").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= LEAST_COMMON).withColumn("level", F.floor(F.log2("copies")).cast("int")), "common")
    counts = dict(total.groupBy("level").count().collect())
    least, seen = max(counts, default=0) + 1, 0
    for level in sorted(counts, reverse=True):
        seen += counts[level]
        if seen > COMMON:
            break
        least = level
    found = total.where(F.col("level") >= least).select("token", "copies").toPandas()
    remove(shared.sparkSession, place)
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(token)
    return token[at], found["copies"].to_numpy(np.int64)[at]


def _first_shingles(docs: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """(class, id, n, need, tokens): each class with its smallest id and the first shingles of its set, of which similar sets share `need`.

    `common`: shingles, sorted, and how many texts have each. Copies become one row in the task that reads them, and one in all after that.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in batches:
            first, length, size, need, key = [], [], [], [], []
            for s in _sets(batch, "text", width):
                least = (percent * len(s) + 99) // 100
                key.append(_class(s))
                size.append(len(s))
                need.append(min(len(s) // SHARE + 2, least))
                m = len(s) - least + need[-1]
                if m and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.lexsort((s, np.where(known[at] == s, rank[at], 0)))]
                first.append(_signed(s[:m]))
                length.append(m)
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat))
            columns = [batch.column(batch.schema.get_field_index("id")), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(need, pa.int32()), tokens]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "n", "need", "tokens"])

    every = docs.where("id is not null").mapInArrow(run, "id long, class binary, n long, need int, tokens array<long>").where("n > 0")
    return every.groupBy("class").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "need", "tokens")))


def _needed(n: Column, percent: int) -> Column:
    """How many of its first shingles a set of n shares with a similar one, as in _first_shingles."""
    return F.least(F.floor(n / SHARE) + 2, F.ceil(n * percent / 100))


def _paired(few: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of texts that share shingles of at most FEW texts, and as many as they need with those that more texts have: `often` (id, own) says how many of these a text has."""
    by_size = Window.partitionBy("token").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = few.withColumn("others", F.collect_list(F.struct("id", "n", "need")).over(by_size)).select("id", "n", "need", F.explode("others").alias("o"))
    pairs = seen.where((F.col("o.n") * 100 >= F.col("n") * percent) & (F.col("o.id") != F.col("id")))
    ends = pairs.select(F.least("id", "o.id").alias("src"), F.greatest("id", "o.id").alias("dst"), F.least("need", "o.need").alias("need"))
    counted = ends.groupBy("src", "dst").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    with_own = counted.join(often.select(F.col("id").alias("src"), F.col("own").alias("x")), "src", "left").join(often.select(F.col("id").alias("dst"), F.col("own").alias("y")), "dst", "left")
    more = F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
    return with_own.where(F.col("shared") + more >= F.col("need")).select("src", "dst")


def chained(many: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of texts that follow each other by size along a shingle. `many` is ordered by ranges; where a range begins, the last row of the one before is looked at."""
    row = F.struct("token", "n", "id")
    inside = many.select("token", "n", "id", F.lag(row).over(Window.partitionBy("part").orderBy("token", "n", "id")).alias("o"))
    ends = many.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    across = ends.select("first.*", F.lag("last").over(Window.orderBy("part")).alias("o"))
    near = (F.col("o.token") == F.col("token")) & (F.col("o.n") * 100 >= F.col("n") * percent) & (F.col("o.id") != F.col("id"))
    return inside.unionByName(across).where(near).select(F.least("id", "o.id").alias("src"), F.greatest("id", "o.id").alias("dst"))


def dealt_by_size(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows (token, n, id) as a written table in ranges of these, with the range as `part`; and where it is."""
    return written(rows.select("token", "n", "id").repartitionByRange("token", "n", "id").withColumn("part", F.spark_partition_id()), name)


def _near(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component): texts that may be similar, or hang together by texts that may be, are of one component."""
    spark, first = classes.sparkSession, classes.select("id", F.col("n").cast("int").alias("n"), "need", F.explode("tokens").alias("token"))
    often, often_at = written(first.groupBy("token").agg(F.count("*").alias("texts")).where(F.col("texts") > FEW).select("token"), "often")
    shared, shared_at = written(first.join(often, "token").select("token", "n", "id"), "shared")
    own, own_at = written(shared.groupBy("id", "n").agg(F.count("*").alias("own")), "own")
    enough = own.where(F.col("own") >= _needed(F.ceil(F.col("n") * percent / 100), percent)).select("id")
    many, many_at = dealt_by_size(shared.join(enough, "id", "left_semi"), "many")
    near = connected_components(_paired(first.join(often, "token", "left_anti"), own, percent).unionByName(chained(many, percent)))
    for at in (often_at, shared_at, own_at, many_at):
        remove(spark, at)
    return near


class Tree:
    """Signature tree over sets: level 0 has a node for each set, each higher node stands for FAN_OUT below it."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        n = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, s in zip(maps, sets, strict=True):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        self.levels = [(maps, n, n, n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a pair of sets with the wanted similarity."""
    low = a[1][i] + b[1][j]
    fits = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    overlap = np.zeros(len(i), np.int64)
    at = np.flatnonzero(fits)
    overlap[at] = np.bitwise_count(a[0][i[at]] & b[0][j[at]]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i[at]], b[3][j[at]])
    overlap = np.minimum(overlap, np.minimum(a[2][i], b[2][j]))
    return fits & (overlap * (100 + percent) >= percent * low)


def _pairs(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal, depth first in chunks: (i, j) of sets that may be similar; within one tree i < j."""
    same = a is b
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        p, q, i, j = todo.pop()
        kept = _possible(a.levels[p], b.levels[q], i, j, percent)
        i, j = i[kept], j[kept]
        if not len(i):
            continue
        if p == q == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        for at in range(0, len(i), CHUNK // FAN_OUT**2):
            x, y = i[at : at + CHUNK // FAN_OUT**2], j[at : at + CHUNK // FAN_OUT**2]
            deeper = [(FAN_OUT, p - 1, len(a.levels[p - 1][1])) if p else (1, 0, len(a.levels[0][1])), (FAN_OUT, q - 1, len(b.levels[q - 1][1])) if q else (1, 0, len(b.levels[0][1]))]
            (f, p2, n), (g, q2, m) = deeper
            x2 = (x[:, None, None] * f + np.arange(f)[None, :, None] + np.zeros((1, 1, g), np.int64)).ravel()
            y2 = (y[:, None, None] * g + np.arange(g)[None, None, :] + np.zeros((1, f, 1), np.int64)).ravel()
            inside = (x2 < n) & (y2 < m)
            if same:
                inside &= x2 <= y2
            todo.append((p2, q2, x2[inside], y2[inside]))


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all similar sets of `left` (with those of `right`, if given): a forest; positions in left, then right.

    `joined`: a label for each position; those with the same one hang together already.
    """
    every = left + (right or [])
    typical = int(np.median([len(s) for s in every]))
    bits = 1 << min(13, max(8, (2 * typical).bit_length()))
    order = [sorted(range(len(side)), key=lambda k: (int(side[k][0]), len(side[k]))) for side in (left, right or [])]
    a = Tree([left[k] for k in order[0]], bits)
    b = Tree([right[k] for k in order[1]], bits) if right else a
    name_a = np.array(order[0])
    name_b = np.array(order[1]) + len(left) if right else name_a
    top = np.arange(len(every))
    if joined is not None:
        _, first, of = np.unique(joined, return_index=True, return_inverse=True)
        top = first[of]

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = int(top[x])
        return x

    found = []
    for i, j in _pairs(a, b, percent):
        while not (top[top] == top).all():
            top[:] = top[top]
        x, y = name_a[i], name_b[j]
        apart = top[x] != top[y]
        for u, v in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            p, q = find(u), find(v)
            if p != q:
                s, t = every[u], every[v]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    top[max(p, q)] = min(p, q)
                    found.append((u, v))
    return found


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in pdf.sort_values(["component", "side", "id"]).groupby("component"):
            sets, ids = [np.frombuffer(x, np.uint64) for x in part["shingles"]], part["id"].to_numpy()
            n = int((part["side"] == 0).sum())
            if 0 < n and len(sets) > 1:
                out += [(ids[u], ids[v]) for u, v in links(sets[:n], sets[n:] or None, percent, part["head"].to_numpy())]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """`rows` (component, n, class, ...) with `block`: by size, `block` rows each or about; places are counts of the sizes before, and a hash among equal sizes."""
    per = rows.groupBy("component", "n").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / float(1 << 20)
    placed = rows.join(per.withColumn("before", before), ["component", "n"])
    return placed.withColumn("block", F.floor((F.col("before") + F.floor(share * F.col("many"))) / block)).drop("before", "many")


def _ranges(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def _with_sets(named: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """`rows` (id, class, ...) with `shingles`, the set of the text of that id and class.

    Texts and rows meet in a shuffle at every size: the rows grow with the texts, so that sending them to all executors would not last.
    """
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("class")).to_pylist()
            got = [s.tobytes() if _class(s) == c else None for s, c in zip(_sets(batch, "text", width), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(got, pa.binary())], names=[*kept, "shingles"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("shingles", T.BinaryType())])
    return named.join(rows.hint("merge"), "id").mapInArrow(run, schema).where("shingles is not null")


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.select("group", "component", "side", "id", "head", "shingles").groupBy("group").applyInPandas(_compare(percent), "src long, dst long")


def _first_links(sets: DataFrame, blocks: DataFrame, n_sets: int, percent: int) -> DataFrame:
    """Links inside small components and blocks, and between blocks that follow each other."""
    key = lambda c, p, q: F.struct(F.lit(c).cast("long").alias("c") if isinstance(c, int) else c.alias("c"), p.cast("long").alias("p"), q.cast("long").alias("q"))
    packed = key(-1, F.pmod(F.xxhash64("component"), F.lit(n_sets // BLOCK + 1)), F.lit(0))  # small components: many to a group
    small = sets.where(F.col("classes") <= BLOCK).select("id", "component", "shingles", F.array(F.struct(packed.alias("group"), F.lit(0).alias("side"))).alias("groups"))
    after = Window.partitionBy("component").orderBy("block")
    of = _ranges(blocks).withColumns({"next": F.lead("block").over(after), "next_low": F.lead("low").over(after), "last": F.lag("block").over(after), "last_high": F.lag("high").over(after)})
    member = lambda p, q, side: F.struct(key(F.col("component"), p, q).alias("group"), F.lit(side).alias("side"))
    own = F.array(member(F.col("block"), F.col("block"), 0))
    ahead = F.when(F.col("high") * 100 >= F.col("next_low") * percent, F.array(member(F.col("block"), F.col("next"), 0)))
    behind = F.when(F.col("last_high") * 100 >= F.col("low") * percent, F.array(member(F.col("last"), F.col("block"), 1)))
    none = F.array().cast("array<struct<group:struct<c:bigint,p:bigint,q:bigint>,side:int>>")
    groups = of.select("component", "block", F.concat(own, F.coalesce(ahead, none), F.coalesce(behind, none)).alias("groups"))
    large = blocks.join(groups, ["component", "block"]).select("id", "component", "shingles", "groups")
    dealt = small.unionByName(large).select("id", F.col("id").alias("head"), "component", "shingles", F.explode("groups").alias("g"))
    return _links(dealt.select("id", "head", "component", "shingles", "g.group", "g.side"), percent)


def _other_links(blocks: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links of what isn't in its component's largest part with all blocks of compatible sizes."""
    headed = blocks.join(joined.select(F.col("node").alias("id"), F.col("component").alias("top")), "id", "left").withColumn("head", F.coalesce("top", "id")).drop("top")
    parts = headed.groupBy("component", "head").agg(F.count("*").alias("many"))
    largest = parts.groupBy("component").agg(F.max_by("head", F.struct("many", "head")).alias("largest"))
    apart = headed.join(largest, "component").where(F.col("head") != F.col("largest")).drop("largest", "block")
    left = materialise(_in_blocks(apart, BLOCK), "apart")  # stays until the links are read
    x, y = _ranges(left).alias("x"), _ranges(blocks).alias("y")
    compatible = (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & compatible).select("x.component", F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    columns = ["id", "component", "block", "shingles", "head"]
    one = left.select(columns).withColumnRenamed("block", "p").join(pairs, ["component", "p"]).withColumn("side", F.lit(0))
    other = headed.join(left.select("component").distinct(), "component", "left_semi").select(columns).withColumnRenamed("block", "q").join(pairs, ["component", "q"]).withColumn("side", F.lit(1))
    return _links(one.unionByName(other).withColumn("group", F.struct("component", "p", "q")), percent)


def refined(named: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    """`near` (node, component) with components of more than BLOCK nodes cut into those that shared shingles tie, as steps 1 and 2 do: no two sets that
    link are parted, and texts that only have a template in common need not all be compared."""
    spark = named.sparkSession
    large = near.groupBy("component").agg(F.count("*").alias("nodes")).where(F.col("nodes") > BLOCK).select("component")
    inside, inside_at = written(near.join(large, "component", "left_semi").select(F.col("node").alias("id")), "inside")
    if inside.isEmpty():
        return near
    some, some_at = written(named.join(inside, "id", "left_semi"), "some")
    shared = shingle_sets(some, width)[1]
    classes, classes_at = written(_first_shingles(some, _common(shared), width, percent), "classes")
    finer = materialise(_near(classes, percent).unionByName(near.join(large, "component", "left_anti").select("node", "component")), "near")
    for place in (inside_at, some_at, classes_at):
        remove(spark, place)
    return finer


def confirmed(named: DataFrame, classes: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that links join, from exact comparison of the sets in each component of `near` (node, component).

    `named` has (id, text), `classes` (class, id, n), an id for each class.
    """
    spark = named.sparkSession
    members = classes.select("class", "id", "n").join(near.withColumnRenamed("node", "id"), "id").select("component", "id", "n", "class")
    several = members.groupBy("component").agg(F.count("*").alias("classes")).where("classes > 1")
    # the texts are met once; what is compared after that are sets of this table
    sets, sets_at = written(_with_sets(named, members.join(several, "component"), width), "compared")
    blocks, blocks_at = written(_in_blocks(sets.where(F.col("classes") > BLOCK).drop("classes"), BLOCK), "blocks")
    joined = connected_components(_first_links(sets, blocks, sets.count(), percent))
    remove(spark, sets_at)
    if not blocks.isEmpty():
        found = _other_links(blocks, joined, percent)
        joined = connected_components(found.unionByName(joined.select(F.col("node").alias("src"), F.col("component").alias("dst"))))
    remove(spark, blocks_at)
    return joined


def answered(sized: DataFrame, classes: DataFrame, joined: DataFrame, id: str) -> DataFrame:
    """A row for each of `sized` (id, n, class): `id`, n_shingles and component_id."""
    heads = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("class", F.coalesce("component", "id").alias("head"))
    by_id = sized.select("id", "n", "class").join(heads, "class", "left").select("id", "n", "class", "head")
    answer = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("id"))
    return by_id.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), answer).alias("component_id"))


def similar_sets(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of `docs`: `id`, n_shingles and component_id."""
    named = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sized, shared = shingle_sets(named, width)
    classes, place = written(_first_shingles(named, _common(shared), width, percent), "classes")
    near = _near(classes, percent)
    heads = materialise(classes.select("class", "id", "n"), "heads")
    remove(named.sparkSession, place)
    return answered(sized, heads, confirmed(named, heads, near, width, percent), id)
