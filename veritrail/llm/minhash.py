"""Near duplicates by MinHash signatures and a multi-index Hamming join, links confirmed on full sets.

1. Each text becomes the set of its distinct word shingles; texts with equal sets form a class, whose smallest id stands for it. A set's signature
   is PLACES numbers of 16 bits, each taken from the smallest of the set's shingles under one hash; two sets agree at a place as often as their Jaccard
   similarity says. Their distance is the number of places where they differ.
2. A signature is split into PLACES / CHUNK chunks. If two differ at no more than MOST places, by the pigeonhole principle one chunk differs at no
   more than MOST // chunks = 1. Each chunk is therefore entered once for each place that may be in error, that place left out: all
   pairs within the distance meet under a key. At a similarity of exactly 0.85 a pair is farther apart once in some 10^8, and meets even so as long
   as one of twelve chunks has one error at most (all others once in 10^11).
3. Pairs under keys of at most FEW classes are formed, if their sizes allow the similarity, and measured once by their signatures. Along a key of
   more classes each is tied to the next by size, as the n-gram join does with frequent shingles; what meets under no smaller key does so
   under keys of three chunks at least (but once in 10^8, as above), so that only classes with as many such chunks are tied that way.
4. In each component of these candidates the full sets are compared exactly; components of the links follow. Texts of one template meet under many keys
   and are no links: where a corpus has many, components of very many candidates can first be cut along shingles that their sets share, as exactly
   as the n-gram join ties sets, at the price of reading their texts once more.

Defined results: a null or blank text has no shingles and is linked with nothing; so is a row without id (component null, kept null); rows that repeat
an id are judged each by its own text, and kept each if the id is its component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import ngram_join
from veritrail.llm.shingles import mix
from veritrail.operators.graph import connected_components
from veritrail.sources.catalog import materialise, remove, written

WIDTH, PERCENT = 3, 85
PLACES, CHUNK = 48, 4
CHUNKS = PLACES // CHUNK
#: The greatest distance of a candidate: one error in each chunk, and one more in all but one.
MOST = 2 * CHUNKS - 1
#: Classes under a key that are still paired one by one; chunks that a class needs under larger keys to be tied along these.
FEW, LARGE_CHUNKS = 64, 3
#: Shingles that are hashed together.
STRETCH = 1 << 18
_fixed = np.random.Generator(np.random.PCG64(20240712))
_FLIP = _fixed.integers(0, 2**64, PLACES, dtype=np.uint64)
_TIMES = _fixed.integers(0, 2**64, PLACES, dtype=np.uint64) | np.uint64(1)
_PLACE = _fixed.integers(0, 2**64, (CHUNKS, CHUNK, CHUNK), dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES 16-bit numbers for each set; sets must not be empty."""
    out = np.zeros((len(sets), PLACES), np.uint16)
    if sets:
        flat, start = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k in range(PLACES):
            out[:, k] = mix(np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], start)).astype(np.uint16)
    return out


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """(row, chunk, place left out) -> key: a hash of the chunk's other places, apart for each chunk and place."""
    x = mix(signs.astype(np.uint64) + np.uint64(1)).reshape(len(signs), CHUNKS, 1, CHUNK) * _PLACE
    x[:, :, np.arange(CHUNK), np.arange(CHUNK)] = 0
    which = np.arange(CHUNKS * CHUNK, dtype=np.uint64).reshape(CHUNKS, CHUNK)
    return mix(x.sum(axis=3, dtype=np.uint64) + mix(which + np.uint64(1)))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, class, sign) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, signs = [], [], []
            held: list[np.ndarray] = []
            size = 0
            for s in ngram_join._sets(batch, "text", width):
                n.append(len(s))
                key.append(ngram_join._class(s))
                held.append(s)
                size += len(s)
                if size > STRETCH:
                    signs += _signs(held)
                    held, size = [], 0
            signs += _signs(held)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n", "class", "sign"])

    return docs.mapInArrow(run, "id long, n long, class binary, sign binary")


def _signs(sets: list[np.ndarray]) -> list[bytes | None]:
    found = iter(signatures([s for s in sets if len(s)]))
    return [next(found).tobytes() if len(s) else None for s in sets]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PLACES)


def _buckets(classes: DataFrame) -> DataFrame:
    """(token, chunk, n, id, large): the keys of each class that another class has as well; large: of more than FEW classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = chunk_keys(_matrix(batch.column(2)))
            each = np.repeat(np.arange(len(keys)), CHUNKS * CHUNK)
            chunk = np.tile(np.repeat(np.arange(CHUNKS, dtype=np.int32), CHUNK), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(chunk), batch.column(1).take(pa.array(each)), batch.column(0).take(pa.array(each))], names=["token", "chunk", "n", "id"])

    keys = classes.select("id", F.col("n").cast("int").alias("n"), "sign").mapInArrow(run, "token long, chunk int, n int, id long")
    shared = keys.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1").select("token", (F.col("classes") > FEW).alias("large"))
    return keys.join(shared, "token")


def _within(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (src, dst) whose signatures differ at `most` places at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
            yield batch.select(["src", "dst"]).filter(pa.array(apart <= most))

    both = pairs.join(classes.select(F.col("id").alias("src"), F.col("sign").alias("x")), "src").join(classes.select(F.col("id").alias("dst"), F.col("sign").alias("y")), "dst")
    return both.select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of classes (id, n, sign) that may be similar, or hang together by such."""
    spark = classes.sparkSession
    buckets, at = written(_buckets(classes), "buckets")
    few = buckets.where("not large").select("token", "n", "id")
    other = few.select("token", F.col("n").alias("m"), F.col("id").alias("dst"))
    fits = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    met = few.join(other, "token").where((F.col("id") < F.col("dst")) & fits).select(F.col("id").alias("src"), "dst").distinct()
    large = buckets.where("large")
    tied = large.groupBy("id").agg(F.count_distinct("chunk").alias("chunks")).where(F.col("chunks") >= LARGE_CHUNKS).select("id")
    many, many_at = ngram_join.dealt_by_size(large.join(tied, "id", "left_semi"), "many")
    near = connected_components(_within(met, classes, MOST).unionByName(ngram_join.chained(many, percent)))
    for place in (at, many_at):
        remove(spark, place)
    return near


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, templates: bool = False) -> DataFrame:
    """One row for each row of `docs`: `id`, n_shingles, component_id and kept. `templates`: cut large components first (step 4); the result is the same."""
    named = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sized = materialise(_signed(named, width), "signatures")
    told = sized.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    classes = materialise(told, "classes")
    near = candidates(classes, percent)
    near = ngram_join.refined(named, near, width, percent) if templates else near
    joined = ngram_join.confirmed(named, classes, near, width, percent)
    found = ngram_join.answered(sized, classes.select("class", "id", "n"), joined, id)
    return found.withColumn("kept", F.col(id) == F.col("component_id"))
