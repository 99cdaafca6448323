"""Token-ID output: one wavelet matrix a shard.

A shard's tokens become bit-planes, the highest bit first; after each plane the tokens are dealt into those with a 0 and those with a 1, order
kept. Counts of ones before each block of 512 bits give rank, and with a search select, so that one file answers which token stands at a
place, how often a token occurs before it, and where its k-th occurrence is. Planes lie in the file one by one, compressed, and are
opened when first needed. The documents' ids and lengths follow.

Texts are dealt out by ranges of their id and sorted, each task writes its stretch as shards of about SHARD tokens, and the shards' names sort like
the ids. Only the tasks' totals, one number each, are summed up in one place.

Defined results: a token that the vocabulary's file adds is its own id wherever a text holds it literally; a null text encodes like the empty text, to the end id alone; rows without id come first; rows that repeat an id keep their own
entries, in the order of their texts' hashes; an empty table writes no shard and gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.bpe import REMEMBERED, Memory, flattened, splitter
from veritrail.llm.files import get, put
from veritrail.llm.shingles import stretches
from veritrail.sources.catalog import materialise

#: Tokens of a shard, about, bits between two counts of ones, and bytes of text whose distinct words are looked up together.
SHARD, EVERY, READ = 1 << 22, 512, 2_000_000
MAGIC = b"WVM1"
#: The vocabulary's split of a text, as its file states it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_codec = pa.Codec("zstd", compression_level=1)


def _ones_before(plane: np.ndarray) -> np.ndarray:
    """Number of ones before each block of EVERY bits of the packed plane."""
    per_byte = np.bitwise_count(plane)
    padded = np.zeros(-(-len(plane) // (EVERY // 8)) * (EVERY // 8), np.uint8)
    padded[: len(plane)] = per_byte
    counts = padded.reshape(-1, EVERY // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)


def build(tokens: np.ndarray, bits: int, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    a = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, parts = [], []
    for bit in range(bits - 1, -1, -1):
        on = ((a >> a.dtype.type(bit)).astype(np.uint8) & np.uint8(1)).view(bool)
        plane = np.packbits(on)
        parts += [plane.tobytes(), _ones_before(plane).tobytes()]
        zeros.append(len(a) - int(np.count_nonzero(on)))
        a = np.concatenate([np.compress(~on, a), np.compress(on, a)])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), lengths.astype("<i8").tobytes()]
    packed = [_codec.compress(p, asbytes=True) for p in parts]
    head = json.dumps({"n": len(tokens), "bits": bits, "zeros": zeros, "docs": len(doc_ids), "parts": [[len(p), len(c)] for p, c in zip(parts, packed, strict=True)]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(packed)


class Shard:
    """A shard's file, opened for access, counting and look-up."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(data[8 : 8 + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self.data, self.places, at = data, [], 8 + size
        for raw, packed in self.head["parts"]:
            self.places.append((at, raw, packed))
            at += packed
        self._open: dict[int, np.ndarray] = {}

    def _part(self, k: int, kind) -> np.ndarray:
        if k not in self._open:
            at, raw, packed = self.places[k]
            self._open[k] = np.frombuffer(_codec.decompress(self.data[at : at + packed], raw, asbytes=True) if raw else b"", kind)
        return self._open[k]

    def plane(self, level: int) -> np.ndarray:
        return self._part(2 * level, np.uint8)

    def doc_ids(self) -> list[int | None]:
        known = self._part(2 * self.bits + 1, np.uint8)
        return [int(x) if k else None for x, k in zip(self._part(2 * self.bits, "<i8"), known, strict=True)]

    def lengths(self) -> np.ndarray:
        return self._part(2 * self.bits + 2, "<i8")

    def rank1(self, level: int, i: int) -> int:
        """Ones before bit i of a plane."""
        plane, block = self.plane(level), i // EVERY
        total = int(self._part(2 * level + 1, np.uint32)[block])
        whole = plane[block * EVERY // 8 : i // 8]
        total += int(np.bitwise_count(whole).sum())
        return total + (int(plane[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else total

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) `bit` of a plane."""
        ones = self._part(2 * level + 1, np.uint32).astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * EVERY, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.plane(level)[block * EVERY // 8 : (block + 1) * EVERY // 8])[: self.n - block * EVERY]
        return block * EVERY + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        token = 0
        for level in range(self.bits):
            bit = int(self.plane(level)[i // 8]) >> (7 - i % 8) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            a, b = self.rank1(level, start), self.rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, end: int | None = None) -> int:
        """How often `token` occurs before place `end`."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of `token`."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self.plane(level), count=self.n).view(bool)
            z, out = self.zeros[level], np.empty(self.n, kind)
            out[np.flatnonzero(~on)] = a[:z]
            out[np.flatnonzero(on)] = a[z:] | kind(1 << (self.bits - 1 - level))
            a = out
        return a.astype(np.uint32)


#: Letters for bytes: those that print stand for themselves, the others are counted up from U+0100.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = {chr(b): chr(256 + sum(x not in _PRINTS for x in range(b))) for b in range(256) if b not in _PRINTS and b != ord("\n")}
_SPELT_ANEW = re.compile(f"[{re.escape(''.join(_SPELLING))}]")
#: What a vocabulary's file must state: how it normalises and splits texts, and which parts its model must leave out.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_PLAIN = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class WordEncoder:
    """Ids of texts by the library's model, word by word.

    The file normalises (NFC, white space, lower case by code point), drops white space, splits at WORDS, spells each piece's bytes as letters and
    merges inside the piece, so that a text's ids are those of its words between blanks, and a word's are those of its pieces. A token that
    the file adds is cut out of a word as it stands. A file that states anything else is refused.
    """

    def __init__(self, vocabulary: str, end_id: int) -> None:
        from tokenizers import models

        told = json.loads(vocabulary)
        split, spell = (told["pre_tokenizer"] or {}).get("pretokenizers") or [None, {}]
        model = told["model"]
        if told["normalizer"] != _NORMALIZER or split != _SPLIT or not _BYTES.items() <= spell.items() or not _PLAIN.items() <= model.items() or told["truncation"]:
            raise ValueError("a vocabulary that normalises, splits or merges in another way")
        odd = [t["content"] for t in told["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"[ \n]", t["content"])]
        if odd:
            raise ValueError(f"added tokens that are not matched as they stand: {odd}")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        # what the model remembers itself costs more than it saves: each piece comes once
        self.model = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if self.added else None
        self.split, self.end_id = splitter(WORDS + r"|\n"), end_id
        self.pieces, self.words = Memory(self._new_pieces, REMEMBERED // 2), Memory(self._new_words, REMEMBERED)

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join("" if p == "\n" else p for p in pieces).encode().decode("latin-1")
        spelled = _SPELT_ANEW.sub(lambda m: _SPELLING[m[0]], text).split("\n") if pieces else []
        tokenize = self.model.tokenize
        return flattened([t.id for t in tokenize(p)] if p else [] for p in spelled)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without added tokens; each word ends with a line end, which is a piece of its own without ids."""
        text = "\n".join([*words, ""])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = self.split(text.lower())
        self.pieces.turn()
        end = self.pieces.numbers["\n"]
        used = np.fromiter(map(self.pieces.numbers.__getitem__, pieces), np.int64, len(pieces))
        self.pieces.learn()
        ids, many = self.pieces.ids(used)
        return ids, np.diff(np.cumsum(many)[used == end], prepend=0)

    def _new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join(words)
        if not any(t in text for t in self.added):
            return self._plain(words)
        cut = [self.cut(w) for w in words]
        ids, many = self._plain([x for parts in cut for x in parts[::2]])
        stretches = iter(np.split(ids, np.cumsum(many)[:-1]))
        return flattened([y for i, x in enumerate(parts) for y in ([self.added[x]] if i % 2 else next(stretches).tolist())] for parts in cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end's id behind it, one after the other, and how many each has."""
        self.words.turn()
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        distinct = words.flatten().dictionary_encode()
        number = self.words.numbers.__getitem__
        used = np.fromiter(map(number, distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(distinct.dictionary))
        self.words.learn()
        ids, many = self.words.ids(used[distinct.indices.to_numpy()])
        per_text = np.diff(np.concatenate([[0], np.cumsum(many)])[words.offsets.to_numpy() - words.offsets[0].as_py()])
        return np.insert(ids, np.cumsum(per_text), np.uint32(self.end_id)), per_text + 1


_workers: dict[tuple[str, int], WordEncoder] = {}


def _encoder(key: tuple[str, int], vocabulary) -> WordEncoder:
    """This worker's encoder; what it remembers serves its later tasks as well."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = WordEncoder(vocabulary.value, key[1])
    return _workers[key]


def write(df: DataFrame, out: str, tokenizer_path: str, end_id: int, bits: int = 16, id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Write the shards of all texts below `out`; returns (shard, first, tokens, docs): each shard's name, the tokens before it, its tokens and documents."""
    with open(tokenizer_path) as f:
        told = f.read()
    WordEncoder(told, end_id)  # refuses here what it can't follow
    vocabulary = df.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder((tokenizer_path, end_id), vocabulary), TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        made = size = 0

        def close() -> pa.RecordBatch:
            name = f"{task:07d}-{made:05d}"
            put(f"{out}/{name}.wvm", build(np.concatenate(parts), bits, ids, np.concatenate(lengths)))
            return pa.RecordBatch.from_pydict({"shard": [name], "tokens": [size], "docs": [len(ids)]})

        for batch in batches:
            for rows in stretches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), READ):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found, many = encoder.encode(part.column(1))
                ids += part.column(0).to_pylist()
                parts.append(found)
                lengths.append(many)
                size += len(found)
                if size >= shard:
                    yield close()
                    ids, parts, lengths, made, size = [], [], [], made + 1, 0
        if ids:
            yield close()

    dealt = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    # rows of one id, or without one, are ranges by their text, so that no id is one task's
    dealt = dealt.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    shards = materialise(dealt.mapInArrow(run, "shard string, tokens long, docs long"), "shards")
    # a task's shards stand in one partition of names; only the tasks' totals are summed up in one place
    by_task = shards.withColumn("task", F.substring("shard", 1, 7))
    totals = by_task.groupBy("task").agg(F.sum("tokens").alias("of_task"))
    tasks = totals.withColumn("before", F.sum("of_task").over(Window.orderBy("task")) - F.col("of_task")).select("task", "before")
    inside = F.sum("tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("tokens")
    return by_task.withColumn("inside", inside).join(tasks, "task").select("shard", (F.col("before") + F.col("inside")).alias("first"), "tokens", "docs")


def read(spark: SparkSession, out: str, shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, from the files below `out`; ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Shard(get(f"{out}/{name}.wvm"))
                tokens, lengths = file.tokens().astype("<u4"), file.lengths()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                found = [tokens[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(file.doc_ids(), pa.int64()), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids"])

    one_by_one = shards.select("shard", "first").repartition(max(1, shards.count()), "shard")
    return one_by_one.mapInArrow(run, "id long, start long, n_tokens long, ids binary")
