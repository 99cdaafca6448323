"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text, with each run of other characters than letters as one blank.
Document frequencies come from all training texts. The model is fitted by follow-the-regularised-leader (FTRL-proximal) with an
elastic-net penalty, on a bounded sample of the training texts (PER_CLASS distinct texts of each language, by the hash of their text), and a
temperature fitted on a part of the sample that the weights have not seen scales its scores.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learned; of equal scores the
first language in alphabetical order wins; repeated rows are predicted one by one; an empty table gives an empty table; rows without
a language teach nothing; other columns stay as they are, and one that has a result's name is replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, PER_CLASS, EPOCHS = 1 << 14, 600, 3
#: FTRL's learning rate and its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of the whole text; none if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(letter, code, np.uint32(32))
    c = c[letter | np.concatenate([[False], letter[:-1]])]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint64)
    h, all_ = c * np.uint64(0x9E3779B97F4A7C15), [c[1:] * np.uint64(0xD6E8FEB86659FD93)]
    for n in (2, 3):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29)) ^ (c[n - 1 :] + np.uint64(n << 32))) * np.uint64(0xBF58476D1CE4E5B9)
        all_.append(h)
    counts = np.bincount((np.concatenate(all_) >> np.uint64(64 - 14)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    """Weights by bucket and language, after the inverse document frequencies and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        p = _softmax(self.logits(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over `rows` of (language's number, buckets, counts), then the temperature on every fifth of them."""
    k = len(langs)
    z, n, model = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), Model(langs, idf, np.zeros((BUCKETS, k)))
    seen, unseen = [r for i, r in enumerate(rows) if i % 5], rows[::5]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, found, counts in seen:
            x, zi, ni = model.vector(found, counts), z[found], n[found]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[found] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[found] = more
    model.weights = weights(z, n)
    logits = [(y, model.logits(f, c)) for y, f, c in unseen]

    doubt = 1 / (len(logits) + 2)  # as Platt's targets: a sample without an error doesn't prove that there is none

    def loss(t: float) -> float:
        logs = ((y, np.log(np.maximum(1e-300, _softmax(x / t)))) for y, x in logits)
        return -sum(float((1 - doubt) * p[y] + doubt * p.mean()) for y, p in logs)

    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss)) if logits else 1.0
    return model


def fit(df: DataFrame, text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> Model:
    """The model of all rows of `df` with a text and a language."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, by = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for x, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, _ = features(x.as_py())
                if len(found):
                    seen[found] += 1
                    by[label] = by.get(label, 0) + 1
        used = np.flatnonzero(seen)
        langs = [None] * len(used) + list(by)
        columns = [pa.array([*used.tolist(), *[-1] * len(by)], pa.int32()), pa.array(langs, pa.string()), pa.array([*seen[used].tolist(), *by.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "n"])

    total = rows.mapInArrow(count, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    by = {r.lang: int(r.n) for r in total[total.bucket < 0].itertuples()}
    langs = sorted(by)
    grams = total[total.bucket >= 0]
    seen = np.zeros(BUCKETS)
    seen[grams.bucket.to_numpy(int)] = grams.n.to_numpy(float)
    idf = np.log((1 + sum(by.values())) / (1 + seen)) + 1
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)))

    # a text is in the sample if its hash is below its language's share; copies have one hash and count once, in the share as well
    distinct = {r["lang"]: r["count"] for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()}
    share = F.create_map(*(F.lit(x) for name in langs for x in (name, min(1.0, 2 * per_class / distinct[name]))))
    hashed = rows.withColumn("h", F.xxhash64("text")).where((F.col("h").cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")])
    picked = hashed.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([f.tolist() for f, _ in got], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "buckets", "counts"])

    # a language has about 2 per_class texts below its share, however many it has in all
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = picked.withColumn("rank", rank).where(F.col("rank") <= per_class).select("lang", "h", "text")
    got = least.mapInArrow(extract, "lang string, h long, buckets array<int>, counts array<int>").toPandas()
    sample = [(r.lang, r.h, np.asarray(r.buckets, np.int64), np.asarray(r.counts, np.int64)) for r in got.itertuples()]
    sample.sort(key=lambda r: (r[1], r[0]))
    number = {name: i for i, name in enumerate(langs)}
    return train([(number[name], f, c) for name, _, f, c in sample if len(f)], langs, idf)


def predict(df: DataFrame, model: Model, text: str = "text", lang_into: str = "lang_pred", score_into: str = "score") -> DataFrame:
    """`df` with the predicted language of each whole text and its calibrated probability."""
    df = df.drop(lang_into, score_into)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            columns = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, lang_into, score_into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_into, T.StringType()), T.StructField(score_into, T.DoubleType())]))
