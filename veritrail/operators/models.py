"""Scores of language models: an interface, and a stand-in that is counted from the corpus.

A model is a function from a batch of texts to (losses of the tokens); where none is installed, `bigram_losses` gives each word the negative
logarithm of its smoothed frequency after the word before it, from counts over all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions.text import long_sentences, stripped, words
from veritrail.operators import scoring

#: The greatest loss that a perplexity is taken from, in training, in scoring and of a sentence; the greatest loss of a text that has none.
LOSS_CAP, ONLINE_CAP, SENTENCE_CAP, NO_SPIKE = 50.0, 25.0, 20.0, 5.0

#: Characters of the texts that one chunk counts the words of.
CHUNK = 1 << 24


def token_losses(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], into: str = "losses") -> DataFrame:
    """`df` with the losses that a model gives each text's tokens; `load` runs once a worker's batch of batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return df.withColumn(into, score(text))


def bigram_table(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((id, a, b, n), (a, b, loss)): neighbouring words of each text, and of all texts -ln((n(a, b) + 1) / (n(a) + v)), v the number of different words."""
    tokens = docs.select(F.col(id).alias("id"), words(F.lower(text)).alias("w"))
    pairs = tokens.select("id", F.explode(_neighbours(F.col("w"))).alias("p")).groupBy("id", "p.a", "p.b").agg(F.count("*").alias("n"))
    ab = pairs.groupBy("a", "b").agg(F.sum("n").alias("nab"))
    na = ab.groupBy("a").agg(F.sum("nab").alias("na"))
    v = tokens.select(F.explode("w").alias("w")).agg(F.count_distinct("w").alias("v"))
    return pairs, ab.join(na, "a").crossJoin(F.broadcast(v)).select("a", "b", (-F.log((F.col("nab") + 1) / (F.col("na") + F.col("v")))).alias("loss"))


def _neighbours(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.element_at(w, i).alias("a"), F.element_at(w, i + 1).alias("b")))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def _named(words_: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the different ones in order, and these."""
    found = words_.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[found.indices.to_numpy()] if len(order) else np.zeros(0, np.int64), found.dictionary.take(pa.array(order))


class _Chunk:
    """Neighbouring words of a chunk's texts, whose words come joined by blanks.

    `known`, its different words in order; `unit`, `key`, for each pair the text it is of and both words' places in one number; `keys`, the different ones in order.
    """

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), " ")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        code, self.known = _named(pc.list_flatten(lists).cast(pa.large_string()))
        unit = np.repeat(np.arange(len(size)), size)
        next_ = unit[1:] == unit[:-1]
        self.unit, self.key = unit[:-1][next_], ((code[:-1] << 32) | code[1:])[next_]
        self.keys, self.count = np.unique(self.key, return_counts=True)

    def part(self, parts: int) -> np.ndarray:
        """The part that a word's counts are taken in."""
        return np.fromiter((zlib.crc32(w.encode()) % parts for w in self.known.to_pylist()), np.int64, len(self.known))


def _stored(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _loaded(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _counts_of_pairs(docs: DataFrame, id: str, text: str, sentences: bool) -> DataFrame:
    """(id, at, loss, n) of neighbouring words, as `bigram_losses`: of the whole text, at is null; of its sentences of more than two words, if these are asked for, at is their place.

    Texts are dealt into chunks of some CHUNK characters. A chunk asks the part of each first word, once for each pair that it has, as compressed Arrow; a part
    sums up how often all chunks have its pairs and words, and answers in the order asked. A chunk then gives its texts their losses. What moves is each
    text and the different pairs of each chunk, twice, not each document's pairs; a part is as large as a chunk or two.
    """
    every = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = every.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = int(chars // CHUNK) + 1
    parts = chunks
    dealt = every.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).repartition("chunk")
    joined = lambda t: F.array_join(words(F.lower(t)), " ")
    of = F.transform(long_sentences(F.col("text")), joined) if sentences else F.array().cast("array<string>")
    ready = dealt.select("chunk", "id", joined(F.col("text")).alias("w"), of.alias("s"))

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = _Chunk(table.column("w").combine_chunks())
        part = c.part(parts)
        first, second = c.keys >> 32, c.keys & 0xFFFFFFFF
        rows = []
        for p in range(parts):
            at = np.flatnonzero(part[first] == p)
            used, place = np.unique(np.concatenate([first[at], second[at]]), return_inverse=True)
            own = np.flatnonzero(part == p)
            lists = {"known": c.known.take(pa.array(used)), "first": pa.array(place[: len(at)].astype(np.int32)), "second": pa.array(place[len(at) :].astype(np.int32)), "n": pa.array(c.count[at].astype(np.int32)), "own": c.known.take(pa.array(own))}
            rows.append(_stored({k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for k, v in lists.items()}))
        return pa.table({"chunk": pa.array([key[0].as_py()] * parts, pa.int32()), "part": pa.array(range(parts), pa.int32()), "data": pa.array(rows, pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = [{k: x.column(k).combine_chunks().flatten() for k in x.column_names} for x in map(_loaded, table.column("data").to_pylist())]
        code, known = _named(pa.concat_arrays([x["known"] for x in asked]))
        begin = np.cumsum([0, *(len(x["known"]) for x in asked)])
        place = [code[begin[i] : begin[i + 1]] for i in range(len(asked))]
        pair = [(q[x["first"].to_numpy()] << 32) | q[x["second"].to_numpy()] for q, x in zip(place, asked, strict=True)]
        keys, at = np.unique(np.concatenate(pair), return_inverse=True)
        nab = np.bincount(at, np.concatenate([x["n"].to_numpy() for x in asked]), minlength=len(keys)).astype(np.int64)
        na = np.bincount(keys >> 32, nab, minlength=len(known)).astype(np.int64)
        own = len(pc.unique(pa.concat_arrays([x["own"] for x in asked])))
        out, start = [], 0
        for x in pair:
            k = at[start : start + len(x)]
            start += len(x)
            out.append(_stored({"nab": pa.array(nab[k]), "na": pa.array(na[keys[k] >> 32])}))
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "v": pa.array([own] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})

    def give(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(texts.column("w").combine_chunks())
        part, loss = c.part(parts), np.zeros(len(c.keys))
        v = sum(answers.column("v").to_pylist())
        for p, data in zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True):
            got = _loaded(data)
            loss[part[c.keys >> 32] == p] = -np.log((got.column("nab").to_numpy() + 1) / (got.column("na").to_numpy() + v))
        unit, k, n = _summed(c.unit, np.searchsorted(c.keys, c.key), len(c.keys))
        ids, at, losses, times = [unit], [np.full(len(unit), -1)], [loss[k]], [n]
        if sentences:
            lists = texts.column("s").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            doc, nth = np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(x) for x in size]) if len(size) else np.zeros(0, np.int64)
            s = _Chunk(lists.flatten())
            # a sentence's words are the text's; those of two words or less count for nothing
            place = np.searchsorted(c.known.to_numpy(zero_copy_only=False), s.known.to_numpy(zero_copy_only=False)) if len(s.known) else np.zeros(0, np.int64)
            unit, k, n = _summed(s.unit, np.searchsorted(c.keys, (place[s.key >> 32] << 32) | place[s.key & 0xFFFFFFFF]), len(c.keys))
            long = np.bincount(s.unit, minlength=len(doc))[unit] > 1
            unit, k, n = unit[long], k[long], n[long]
            ids.append(doc[unit]), at.append(nth[unit]), losses.append(loss[k]), times.append(n)
        where = np.concatenate(at)
        return pa.table({"id": texts.column("id").take(pa.array(np.concatenate(ids))), "at": pa.array(where.astype(np.int32), mask=where < 0), "loss": np.concatenate(losses), "n": np.concatenate(times)})

    kind = dict(ready.dtypes)["id"]
    requests = ready.groupBy("chunk").applyInArrow(ask, "chunk int, part int, data binary")
    answers = requests.groupBy("part").applyInArrow(answer, "chunk int, part int, v long, data binary")
    return ready.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(give, f"id {kind}, at int, loss double, n long")


def _summed(unit: np.ndarray, k: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, k, how often) of each different pair of a text."""
    both, n = np.unique(unit * max(keys, 1) + k, return_counts=True)
    return both // max(keys, 1), both % max(keys, 1), n


def bigram_losses(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, loss, n) for each pair of neighbouring words that a text has n times: -ln((n(a, b) + 1) / (n(a) + v)) over all texts, as in `bigram_table`."""
    return _counts_of_pairs(docs, id, text, False).select("id", "loss", "n")


def sentence_statistics(docs: DataFrame, id: str, text: str, losses: DataFrame | None = None) -> DataFrame:
    """(id, mean_perplexity, offline_perplexity, perplexity_variance, entropy, greatest, burstiness_cv, sentences, fallback) of each text.

    `losses` (a, b, loss) are of neighbouring words; they are the corpus's own by default. A sentence's tokens are losses of its own: those of
    more than two words give exp of their mean loss, at most SENTENCE_CAP, and burstiness is the sample deviation of these over their mean; 0 for one
    sentence. The perplexity of the text is capped at ONLINE_CAP, and at LOSS_CAP as it is trained with. Texts below 50 characters or without
    two words have the fixed statistics.
    """
    n, s, q = F.sum("n"), F.sum(F.col("loss") * F.col("n")), F.sum(F.col("loss") * F.col("loss") * F.col("n"))
    if losses is None:
        both = _counts_of_pairs(docs, id, text, True)
    else:
        pairs = bigram_table(docs, id, text)[0].select("id", F.lit(None).cast("int").alias("at"), "a", "b", "n")
        sentence = docs.select(F.col(id).alias("id"), F.posexplode(long_sentences(F.col(text))).alias("at", "s")).select("id", "at", words(F.lower("s")).alias("w")).where(F.size("w") > 2)
        of = sentence.select("id", "at", F.explode(_neighbours(F.col("w"))).alias("p")).select("id", "at", "p.a", "p.b", F.lit(1).cast("long").alias("n"))
        both = pairs.unionByName(of).join(losses, ["a", "b"]).select("id", "at", "loss", "n")
    summed = both.groupBy("id", "at").agg(n.alias("n"), (s / n).alias("mean"), F.when(n > 1, (q - s * s / n) / (n - 1)).otherwise(F.lit(0.0)).alias("variance"), F.max("loss").alias("greatest"))
    whole, x = F.col("at").isNull(), F.when(F.col("at").isNotNull(), F.exp(F.least("mean", F.lit(SENTENCE_CAP))))
    got = summed.groupBy("id").agg(
        *(F.max(F.when(whole, F.col(c))).alias(c) for c in ("n", "mean", "variance", "greatest")), F.count("at").alias("sentences"),
        F.when(F.count("at") > 1, F.stddev_samp(x) / F.avg(x)).otherwise(0.0).alias("cv"),
    )
    every = docs.select(F.col(id).alias("id"), F.length(stripped(F.coalesce(text, F.lit("")))).alias("length")).join(got, "id", "left")
    short = (F.col("length") < 50) | F.col("mean").isNull()
    plain = scoring.NO_STATISTICS
    return every.select(
        F.col("id").alias(id),
        *(F.round(F.when(short, plain["mean_perplexity"]).otherwise(F.exp(F.least("mean", F.lit(cap)))), 2).alias(c) for c, cap in (("mean_perplexity", ONLINE_CAP), ("offline_perplexity", LOSS_CAP))),
        F.round(F.when(short, plain["perplexity_variance"]).otherwise(F.abs("variance")), 4).alias("perplexity_variance"), F.round(F.when(short, plain["entropy"]).otherwise(F.col("mean")), 4).alias("entropy"),
        F.round(F.when(short, NO_SPIKE).otherwise(F.col("greatest")), 4).alias("greatest"), F.round(F.when(short, 0.0).otherwise(F.coalesce("cv", F.lit(0.0))), 4).alias("burstiness_cv"),
        F.when(short, 0).otherwise(F.coalesce("sentences", F.lit(0))).alias("sentences"), short.alias("fallback"),
    )


def perplexity(losses: DataFrame, id: str) -> DataFrame:
    """(id, mean_token_loss, perplexity, loss_variance, greatest): of each text's losses, weighed by how often they occur; the variance is the sample's."""
    n, s, q = F.sum("n"), F.sum(F.col("loss") * F.col("n")), F.sum(F.col("loss") * F.col("loss") * F.col("n"))
    got = losses.groupBy("id").agg(n.alias("n"), (s / n).alias("mean"), F.when(n > 1, (q - s * s / n) / (n - 1)).otherwise(F.lit(0.0)).alias("variance"), F.max("loss").alias("greatest"))
    return got.select(F.col("id").alias(id), F.round("mean", 4).alias("mean_token_loss"), F.round(F.exp(F.least("mean", F.lit(LOSS_CAP))), 2).alias("perplexity"), F.round(F.abs("variance"), 4).alias("loss_variance"), F.round("greatest", 4).alias("greatest"))


def subject_relevance(docs: DataFrame, keywords: DataFrame, id: str, subject: str, text: str) -> DataFrame:
    """(id, hits, confidence) of each text for its subject's `keywords` (subject, keyword): from two hits on, their share, at most 1; 0.8 below; 1 for
    texts below 50 characters and subjects without keywords. The keywords of a subject are one array, so that a text meets one row."""
    known = keywords.groupBy("subject").agg(F.sort_array(F.collect_set(F.lower("keyword"))).alias("known"))
    both = docs.select(F.col(id).alias("id"), F.col(subject).alias("subject"), F.lower(F.coalesce(text, F.lit(""))).alias("text")).join(known, "subject", "left")
    hits = F.size(F.filter("known", lambda k: F.contains(F.col("text"), k)))
    scored = both.withColumn("hits", F.when(F.col("known").isNull() | (F.length(F.trim("text")) < 50), F.lit(None).cast("int")).otherwise(hits))
    share = F.round(F.least(F.lit(1.0), F.col("hits") / F.size("known")), 4)
    return scored.select(F.col("id").alias(id), "hits", F.when(F.col("hits").isNull(), 1.0).when(F.col("hits") >= 2, share).otherwise(0.8).alias("confidence"))
