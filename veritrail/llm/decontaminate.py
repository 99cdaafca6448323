"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

A text is the sequence of its word shingles (lower-cased A-Z). An item of m shingles has a window size just below m (a multiple of STRIDE,
so that a copy of the item anywhere in a text holds a whole window of the text's grid); its fingerprints are those of all its windows of
that size. Every window of the grid, of each size in use, gets a fingerprint: per bit the majority of its shingles' hashes. Fingerprints are
cut into BLOCKS blocks; two within RADIUS bits agree in one block up to RADIUS // BLOCKS bits, and the index lists each item under all
block values that near, so that no fingerprint within the radius is missed. Each pair found is aligned and verified: the weighted Jaccard
similarity of the item's shingles and those of as many of the text, weighted by how often they occur.

A text shorter than an item may fill none of its windows. It can only match as a whole, and then holds so many of the item's shingles that any
few of its own include one of them: the few that the fewest items hold are looked up, and what they name is verified, so that none is missed.

Items are sent to the workers as texts, in blocks of bounded number and size; each worker builds the index of a block once. A larger benchmark
takes several passes over the texts.

Defined results: null or blank texts and items match nothing; an item of fewer than WIDTH words matches only a text of just these words; rows are
compared one by one, and equal results are given once; a null id stays null; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shingles import mix, shingles, stretches, text_bytes, words

WIDTH, PERCENT = 5, 80
STRIDE, RADIUS, BLOCKS = 4, 15, 4
#: Items that are sent to the workers at once, and bytes of their text; an item has seven fingerprints at most, and each takes some 6 KB of a worker's index.
ITEMS, ITEM_BYTES = 1_000, 4_000_000
_NEAR = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), r)], np.uint16)


def _window(m: int) -> tuple[int, int]:
    """(size, stride) of the windows for an item of m shingles; an item too short for a window of the grid has windows of its own size at every shingle."""
    return (STRIDE * ((m - STRIDE + 1) // STRIDE), STRIDE) if m >= 3 * STRIDE - 1 else (m, 1)


def fingerprints(sums: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Majority bits of the windows of `size` shingles at every step; `sums`: running sums of bits over steps of `stride` shingles."""
    n = size // stride
    if len(sums) <= n:
        return np.zeros(0, np.uint64)
    most = (sums[n:] - sums[:-n]) > sums.dtype.type(size // 2)
    return np.packbits(most, axis=1).view(np.uint64).ravel()


def _running(hashes: np.ndarray, stride: int, longest: int) -> np.ndarray:
    """Running sums of the hashes' bits over steps, modulo a power of two above `longest`, the largest window; `hashes` fills whole steps."""
    kind = np.uint16 if longest < 1 << 16 else np.uint32
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, stride, 64)
    out = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits.sum(axis=1, dtype=kind), axis=0, dtype=kind, out=out[1:])
    return out


class Index:
    """The items' fingerprints by window size, and the items themselves."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.items = [x.copy() for x in shingles(*words(texts), WIDTH)]
        self.ids = ids
        by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, h in enumerate(self.items):
            if len(h):
                size, stride = _window(len(h))
                for at, fp in enumerate(fingerprints(_running(h, 1, size), size, 1).tolist()):
                    by.setdefault((size, stride), []).append((fp, k, at))
        self.longest = max((size for size, _ in by), default=0)
        self.sizes = {}
        for window, found in by.items():
            fps = np.array([f for f, _, _ in found], np.uint64)
            where = np.array([(k, at) for _, k, at in found], np.int64)
            tables = []
            for b in range(BLOCKS):
                near = (fps.view(np.uint16).reshape(-1, 4)[:, b, None] ^ _NEAR[None, :]).ravel()
                order = np.argsort(near, kind="stable")  # of 16 bits: by counting
                first = np.zeros(65537, np.int64)
                np.cumsum(np.bincount(near, minlength=65536), out=first[1:])
                tables.append((first, (order // len(_NEAR)).astype(np.uint16 if len(fps) < 1 << 16 else np.int32)))
            self.sizes[window] = (fps, where, tables)
        # each item's shingles under hashes of its own, to count a stretch's shingles that are in the item
        self.seed = mix(np.arange(1, len(self.items) + 1, dtype=np.uint64))
        self.own = np.unique(np.concatenate([mix(h ^ x) for h, x in zip(self.items, self.seed, strict=True)] or [np.zeros(0, np.uint64)]))
        self.lengths = np.array([len(h) for h in self.items], np.int64)
        self.sorted_lengths = np.unique(self.lengths[self.lengths > 0])
        held = [np.unique(h) for h in self.items]
        keys = np.concatenate([*held, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, many = np.unique(keys, return_counts=True)
        self.first_holder = np.concatenate([[0], np.cumsum(many)])
        self.holder = np.repeat(np.arange(len(held)), [len(h) for h in held])[order]

    def shorter(self, rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, items longer than it) of all pairs that can be similar enough."""
        sizes = np.array([len(h) for h in rows], np.int64)
        after = np.searchsorted(self.sorted_lengths, sizes, side="right")
        least = np.concatenate([self.sorted_lengths, [np.iinfo(np.int32).max]])[after]
        texts = np.flatnonzero(sizes * 100 >= least * PERCENT)
        if not len(texts):
            return
        flat = np.concatenate([rows[t] for t in texts])
        slot = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        holders = np.where(self.keys[slot] == flat, self.first_holder[slot + 1] - self.first_holder[slot], 0)
        at = 0
        for t in texts.tolist():
            n, m = int(sizes[t]), int(least[t])
            s, h = slot[at : at + n], holders[at : at + n]
            at += n
            # both / (m + n - both) is 0.8 at least, so that all but n - both of the text's shingles are the item's
            few = n + 1 + -PERCENT * (m + n) // (100 + PERCENT)
            chosen = np.argpartition(h, few - 1)[:few]
            chosen = np.unique(s[chosen[h[chosen] > 0]])
            if len(chosen):
                items = np.unique(np.concatenate([self.holder[self.first_holder[c] : self.first_holder[c + 1]] for c in chosen.tolist()]))
                yield t, items[(self.lengths[items] > n) & (self.lengths[items] * PERCENT <= n * 100)]

    def near(self, window: tuple[int, int], prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in prints, position in the items' fingerprints) of all pairs within RADIUS."""
        fps, _, tables = self.sizes[window]
        blocks = prints.view(np.uint16).reshape(-1, 4)
        for b, (first, member) in enumerate(tables):
            low = first[blocks[:, b]]
            many = first[blocks[:, b].astype(np.int64) + 1] - low
            at = np.flatnonzero(many)
            low, many = low[at], many[at]
            left = np.repeat(at, many)
            right = member[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(left))]
            close = np.bitwise_count(prints[left] ^ fps[right]) <= RADIUS
            yield left[close], right[close]

    def likely(self, rows: list[np.ndarray], candidates: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Those (text, item, place) whose stretch holds enough shingles of the item, each counted as often as it occurs: a bound on what both share."""
        kept = []
        for some in stretches([int(self.lengths[item]) for _, item, _ in candidates]):
            part = candidates[some]
            cut = [rows[doc][at : at + int(self.lengths[item])] for doc, item, at in part]
            n = np.array([len(c) for c in cut], np.int64)
            of = np.array([item for _, item, _ in part], np.int64)
            keys = mix(np.concatenate(cut) ^ np.repeat(self.seed[of], n))
            slot = np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)
            ends = np.concatenate([[0], np.cumsum(self.own[slot] == keys)])
            both = np.minimum(np.diff(ends[np.concatenate([[0], np.cumsum(n)])]), self.lengths[of])
            enough = both * (100 + PERCENT) >= PERCENT * (self.lengths[of] + n)
            kept += [c for c, ok in zip(part, enough.tolist(), strict=True) if ok]
        return kept

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        a, b = Counter(self.items[item].tolist()), Counter(hashes.tolist())
        both = (a & b).total()
        return both / (a.total() + b.total() - both)


def _search(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, similarity, first word of the passage), the best of each pair."""
    rows = [h.copy() for h in shingles(*words(texts), WIDTH)]
    candidates: set[tuple[int, int, int]] = set()
    for stride in {s for _, s in index.sizes}:
        steps = np.array([-(-len(h) // stride) for h in rows])
        first = np.cumsum(steps) - steps
        flat = np.zeros(int(steps.sum()) * stride, np.uint64)
        for h, f in zip(rows, first.tolist(), strict=True):
            flat[f * stride : f * stride + len(h)] = h
        sums = _running(flat, stride, index.longest)
        owner = np.repeat(np.arange(len(rows)), steps)
        left = np.repeat(np.array([len(h) for h in rows], np.int64), steps) - (np.arange(len(owner)) - first[owner]) * stride
        for window in index.sizes:
            if window[1] != stride:
                continue
            where = index.sizes[window][1]
            starts = np.flatnonzero(left >= window[0])
            prints = fingerprints(sums, *window)[starts] if len(starts) else np.zeros(0, np.uint64)
            for x, y in index.near(window, prints):
                doc = owner[starts[x]]
                at = (starts[x] - first[doc]) * stride - where[y, 1]
                candidates.update(zip(doc.tolist(), where[y, 0].tolist(), np.maximum(at, 0).tolist(), strict=True))
    for doc, items in index.shorter(rows):
        candidates.update((doc, item, 0) for item in items.tolist())
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for doc, item, at in index.likely(rows, sorted(candidates)):
        score = index.similarity(item, rows[doc][at : at + len(index.items[item])])
        if score * 100 >= PERCENT and score > best.get((doc, item), (0.0, 0))[0]:
            best[doc, item] = score, at
    for (doc, item), (score, at) in best.items():
        yield doc, item, score, at


_workers: dict[str, Index] = {}


def _index(key: str, sent) -> Index:
    """This worker's index of a block of items, built once; a few blocks' indexes are kept."""
    if key not in _workers:
        if len(_workers) > 2:
            _workers.clear()
        _workers[key] = Index(*sent.value)
    return _workers[key]


def annotate(df: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "passages", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`df`, or its columns `keep`, with the passages of each text: an array of (item, similarity, first_word), empty for a clean text.

    A row stays in its partition: nothing is joined or shuffled. A column that has the result's name is replaced.
    """
    df = df.drop(into)
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.coalesce(item_text, F.lit("")).alias("text"))
    size, count = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(size // ITEM_BYTES, count // ITEMS) + 1
    kept = df.columns if keep is None else keep
    passage = T.StructType([T.StructField("item", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])

    def found(df: DataFrame, part: int, kept: list[str]) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        sent = df.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["text"].encode().lower() for r in rows]))
        name, key = f"{into}_{part}", uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent)
            kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))
            for batch in batches:
                raw = text_bytes(batch.column(batch.schema.get_field_index(text)))
                out: list[list[dict]] = [[] for _ in raw]
                for rows in stretches([len(x) for x in raw]) if index.sizes else ():
                    for doc, item, score, at in _search(index, raw[rows]):
                        out[rows.start + doc].append({"item": index.ids[item], "similarity": score, "first_word": at})
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(out, kind)], names=[*kept, name])

        fields = [df.schema[c] for c in kept]
        return df.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(passage))]))

    names = [f"{into}_{part}" for part in range(parts)]
    for part in range(parts):
        last = part == parts - 1
        df = found(df, part, [*(kept if last else dict.fromkeys([*kept, text])), *names[:part]])
    return df.select(*kept, F.concat(*names).alias(into))


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, similarity, first_word) for each text and each item of which it holds a passage as long as the item and similar to it."""
    found = annotate(docs.select(id, text), benchmark, text, "passages", [id], item_id, item_text)
    one = found.select(id, F.explode("passages").alias("p"))
    return one.select(id, F.col("p.item").alias(item_id), "p.similarity", "p.first_word").distinct()
