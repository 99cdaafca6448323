"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: its words and its pairs of neighbouring words each have a learned
vector (by BUCKETS hashes), whose means over the passage go, with shares of kinds of characters, lengths and repetition, through one learned
layer. Gated attention (a tanh and a sigmoid branch) weighs the passages, the weighted mean stands for the document, and a logistic unit
scores it. Labels belong to documents only; vectors and layers are fitted together, by Adam on the cross-entropy, on a bounded sample: PER_CLASS
documents of each label, by the hash of their id, each with PER_TEXT passages at most, spread evenly over it, and no more than PASSAGES in all.

Defined results: a null text or one without words is one passage without words, scored like any other; without labels of both classes the score is
their share, 0.5 if there is none; repeated rows are scored one by one, and of several texts of an id the first is learned from; an empty table gives an empty table; other columns stay as they are, and one
that has the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shingles import mix, stretches, text_bytes, words

PASSAGE, BUCKETS, DIM = 64, 1024, 8
PER_CLASS, PER_TEXT, PASSAGES = 1500, 12, 12_000
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 200, 0.02, 1e-4
#: Kinds of bytes whose shares are features.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "#*$%&|<>", ".,;:?", "\"'()[]{}-_/\\@+=~^`")
WIDTH = len(KINDS) + 7
_KIND = np.full(256, len(KINDS), np.int64)
for _k, _chars in enumerate(KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
_KIND[[9, 10, 11, 12, 13, 32]] = len(KINDS) + 1


@dataclass
class Bags:
    """Passages of several texts: their figures, and the bucket of each word and of the pair it ends, with the passage it is in, ascending."""

    x: np.ndarray
    passages: np.ndarray
    at: np.ndarray
    word: np.ndarray
    pair: np.ndarray

    def only(self, kept: np.ndarray) -> Bags:
        """The bags with the passages `kept` (a mask) alone; each text must keep one."""
        text_of = np.repeat(np.arange(len(self.passages)), self.passages)
        number, mine = np.cumsum(kept) - 1, kept[self.at]
        return Bags(self.x[kept], np.bincount(text_of[kept], minlength=len(self.passages)), number[self.at[mine]], self.word[mine], self.pair[mine])

    def first(self, most: int) -> Bags:
        """The first texts, as many as have `most` passages together."""
        n = int(np.searchsorted(np.cumsum(self.passages), most, side="right"))
        rows = int(self.passages[:n].sum())
        end = int(np.searchsorted(self.at, rows))
        return Bags(self.x[:rows], self.passages[:n], self.at[:end], self.word[:end], self.pair[:end])

    def spread(self, most: int) -> Bags:
        """Of texts with more than `most` passages, so many of them, evenly spaced."""
        n = np.repeat(self.passages, self.passages)
        k = np.arange(len(n)) - np.repeat(np.cumsum(self.passages) - self.passages, self.passages)
        return self.only((n <= most) | (k * most // n != (k - 1) * most // n))


def encode(texts: list[bytes]) -> Bags:
    """All passages of the texts."""
    hashes, counts = words(texts)
    passages = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(passages) - passages
    x = np.zeros((int(passages.sum()), WIDTH), np.float32)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return Bags(x, passages, none, none, none)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    blank = kind == len(KINDS) + 1
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    text_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_word = first[text_of] + place // PASSAGE
    n = np.bincount(of_word, minlength=len(x)).astype(np.float64)
    some = np.maximum(n, 1)
    word_at = np.cumsum(~blank & np.concatenate([[True], blank[:-1]])) - 1
    inside = np.flatnonzero(~blank)
    by = np.bincount(of_word[word_at[inside]] * (len(KINDS) + 1) + kind[inside], minlength=len(x) * (len(KINDS) + 1)).reshape(len(x), -1)
    chars = by.sum(axis=1)
    k = len(KINDS)
    x[:, : k + 1] = by / np.maximum(chars, 1)[:, None]
    x[:, k + 1] = chars / some / 10
    x[:, k + 2] = n / PASSAGE
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    x[:, k + 3] = np.bincount(of_word, same, len(x)) / some
    _, one = np.unique(mix(hashes ^ (of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    x[:, k + 4] = np.bincount(of_word[one], minlength=len(x)) / some
    _, one = np.unique(mix(hashes ^ (text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)
    x[:, k + 5] = np.bincount(of_word[one], minlength=len(x)) / some
    lines = np.bincount(of_word[np.clip(word_at[data == 10], 0, None)], minlength=len(x))
    x[:, k + 6] = lines / some
    before = np.zeros_like(hashes)
    before[1:] = np.where(text_of[1:] == text_of[:-1], hashes[:-1], 0)
    bucket = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
    assert len(start) == len(hashes)
    return Bags(x, passages, of_word, bucket(hashes), bucket(mix(hashes ^ (before * np.uint64(0x9E3779B97F4A7C15)))))


def _pooled(table: np.ndarray, at: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """For each of n passages the mean of its words' vectors; 0 without words."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    if len(at):
        start = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[start]] = np.add.reduceat(table[bucket], start, axis=0) / np.diff(np.append(start, len(at)))[:, None]
    return out


def _shares(at: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """For each passage the shares of its words by bucket."""
    counts = np.bincount(at * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Layers; `constant` where there was nothing to learn from."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: dict[str, np.ndarray] | None = None

    def _forward(self, x: np.ndarray, u: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        p, start = self.layers, np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        e = np.tanh(x @ p["encode"] + u @ p["mix"] + p["encode_b"])
        t, s = np.tanh(e @ p["tanh"]), _sigmoid(e @ p["gate"])
        a = (t * s) @ p["attend"]
        a = np.exp(a - np.maximum.reduceat(a, start)[bag])
        a = a / np.add.reduceat(a, start)[bag]
        z = np.add.reduceat(a[:, None] * e, start, axis=0)
        return {"bag": bag, "start": start, "e": e, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["score"] + p["score_b"][0])}

    def scores(self, bags: Bags) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags.passages), self.constant)
        n = len(bags.x)
        u = np.concatenate([_pooled(self.layers["words"], bags.at, bags.word, n), _pooled(self.layers["pairs"], bags.at, bags.pair, n)], axis=1)
        return self._forward((bags.x - self.mean) / self.scale, u, bags.passages)["score"]


def gradients(model: Model, x: np.ndarray, shares: tuple[np.ndarray, np.ndarray], passages: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy, by layer."""
    p = model.layers
    u = np.concatenate([shares[0] @ p["words"], shares[1] @ p["pairs"]], axis=1)
    f = model._forward(x, u, passages)
    d = (f["score"] - label) * weight
    g = {"score": f["z"].T @ d, "score_b": d.sum(keepdims=True)}
    dz = (d[:, None] * p["score"])[f["bag"]]
    along = (dz * f["e"]).sum(axis=1)
    da = f["a"] * (along - np.add.reduceat(f["a"] * along, f["start"])[f["bag"]])
    g["attend"] = (f["t"] * f["s"]).T @ da
    dts = da[:, None] * p["attend"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    g["tanh"], g["gate"] = f["e"].T @ dt, f["e"].T @ ds
    de = (f["a"][:, None] * dz + dt @ p["tanh"].T + ds @ p["gate"].T) * (1 - f["e"] ** 2)
    g["encode"], g["mix"], g["encode_b"] = x.T @ de, u.T @ de, de.sum(axis=0)
    du = (de @ p["mix"].T).astype(shares[0].dtype)
    g["words"], g["pairs"] = shares[0].T @ du[:, :DIM], shares[1].T @ du[:, DIM:]
    return g


def train(bags: Bags, label: np.ndarray) -> Model:
    """Fit vectors and layers on whole bags; both classes weigh the same."""
    if len(set(label.tolist())) < 2:
        return Model(constant=float(label.mean()) if len(label) else 0.5)
    draw = np.random.default_rng(7)
    shapes = {"words": (BUCKETS, DIM), "pairs": (BUCKETS, DIM), "encode": (WIDTH, HIDDEN), "mix": (2 * DIM, HIDDEN), "encode_b": (HIDDEN,), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "score": (HIDDEN,), "score_b": (1,)}
    p = {k: np.zeros(s) if k.endswith("_b") else draw.normal(0, 1 / np.sqrt(DIM if k in ("words", "pairs") else s[0]), s) for k, s in shapes.items()}
    p["words"], p["pairs"] = p["words"].astype(np.float32), p["pairs"].astype(np.float32)
    model = Model(mean=bags.x.mean(axis=0), scale=bags.x.std(axis=0) + 1e-3, layers=p)
    x, n = ((bags.x - model.mean) / model.scale).astype(np.float64), len(bags.x)
    shares = _shares(bags.at, bags.word, n), _shares(bags.at, bags.pair, n)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label)
    first, second = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    for step in range(1, STEPS + 1):
        for k, g in gradients(model, x, shares, bags.passages, label, weight).items():
            g = g + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return model


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """The model of the documents that `labels` marks with 0 or 1."""
    marked = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").withColumn("h", F.xxhash64("id"))
    picked = marked.where("y = 0").orderBy("h", "id").limit(per_class).unionByName(marked.where("y = 1").orderBy("h", "id").limit(per_class))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    # an id that very many rows share is one text, its first, before anything is brought together
    texts = texts.groupBy("h", "id", "y").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(3), lower=False)
            for part in stretches([len(t) for t in raw]):
                b = encode(raw[part]).spread(PER_TEXT)
                ends = np.cumsum(b.passages)[:-1]
                cut = np.searchsorted(b.at, ends)
                place = b.at - np.repeat(np.concatenate([[0], ends]), np.diff(np.concatenate([[0], cut, [len(b.at)]])))
                flat = [np.split(b.x, ends), *(np.split(a.astype(np.uint16), cut) for a in (place, b.word, b.pair))]
                rows = batch.slice(part.start, len(b.passages))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array([a.tobytes() for a in f], pa.binary()) for f in flat)], names=["h", "id", "y", "x", "at", "word", "pair"])

    kind = dict(texts.dtypes)["id"]
    rows = texts.mapInArrow(extract, f"h long, id {kind}, y int, x binary, at binary, word binary, pair binary").toPandas().sort_values(["h", "id", "y", "x", "word"])
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]]
    flat = {c: [np.frombuffer(b, np.uint16).astype(np.int64) for b in rows[c]] for c in ("at", "word", "pair")}
    passages = np.array([len(b) for b in x], np.int64)
    first = np.cumsum(passages) - passages
    joined = lambda parts, empty: np.concatenate(parts) if parts else empty
    none = np.zeros(0, np.int64)
    bags = Bags(joined(x, np.zeros((0, WIDTH), np.float32)), passages, joined([a + f for a, f in zip(flat["at"], first)], none), joined(flat["word"], none), joined(flat["pair"], none)).first(PASSAGES)
    return train(bags, rows["y"].to_numpy(float)[: len(bags.passages)])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """`df` with the score of each whole text, higher where label 1 is likelier."""
    df = df.drop(into)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(batch.schema.get_field_index(text)), lower=False)
            got = [sent.value.scores(encode(raw[part])) for part in stretches([len(t) for t in raw])]
            column = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())]))
