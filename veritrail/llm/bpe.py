"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash (hash and displace, checked against the key it stands for) resolves pre-tokens that are in the vocabulary
as a whole; the others are merged with a heap of candidate pairs over a linked list of their bytes. Both run on the distinct pre-tokens
of a stretch of documents; a memory of pre-tokens, bounded in bytes, lives as long as its worker.

Defined results: a null text encodes like the empty text, to no ids; null ids decode to no bytes; repeated rows are encoded one by one;
an empty table gives an empty table; other columns stay as they are, and one that has a result's name is replaced.
The vocabulary's size bounds what is sent to the workers.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a generation of remembered pieces, those that an entry takes beside its text and ids, and characters of a piece worth remembering.
REMEMBERED, ENTRY, LONG = 64 << 20, 160, 64
STRETCH = 128
#: And of how many bytes together, unless one is larger.
STRETCH_BYTES = 4 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(token) for token, n in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must count up from 0")
    return [ranks[i] for i in range(len(ranks))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """As many slots as keys. A key's bucket has a displacement; with it, the key's hash gives its slot. Buckets of one key name the slot itself."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = self.hashed(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have the same 64-bit hash")
        groups: dict[int, list[int]] = {}
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            groups.setdefault(b, []).append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key = np.full(n, -1, np.int32)
        free = np.ones(n, bool)
        todo = sorted(groups.items(), key=lambda g: -len(g[1]))
        tries = np.arange(1, 257, dtype=np.uint64)
        for b, members in todo:
            if len(members) == 1:
                break
            base, h = 0, hashes[members]
            while True:
                slots = (_mix(h[None, :] + (tries + np.uint64(base))[:, None] * _GOLDEN) % np.uint64(n)).astype(np.int64)
                fits = free[slots].all(axis=1)
                for t in np.flatnonzero(fits):
                    if len(set(slots[t].tolist())) == len(members):
                        break
                else:
                    base += len(tries)
                    continue
                self.shift[b], free[slots[t]], self.key[slots[t]] = base + int(t) + 1, False, members
                break
        left = iter(np.flatnonzero(free).tolist())
        for b, members in todo:
            if len(members) == 1:
                slot = next(left)
                self.shift[b], self.key[slot] = -1 - slot, members[0]

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each of `keys` the number of the only key that it can be."""
        h = self.hashed(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = (_mix(h + shift.astype(np.uint64) * _GOLDEN) % np.uint64(self.n)).astype(np.int64)
        return self.key[np.where(shift < 0, -1 - shift, moved)]


class Vocabulary:
    """Tokens by rank, with the perfect hash over them and, built when first used, the merges by pair of ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        self.merges: dict[int, int] | None = None

    def ready(self) -> Vocabulary:
        if self.merges is None:
            rank = {t: i for i, t in enumerate(self.tokens)}
            self.merges = {}
            for t, i in rank.items():
                for cut in range(1, len(t)):
                    a, b = rank.get(t[:cut]), rank.get(t[cut:])
                    if a is not None and b is not None:
                        self.merges[a << 32 | b] = i
            self.byte = [rank[bytes([b])] for b in range(256)]
            ends = np.cumsum([len(t) for t in self.tokens])
            self.length = np.array([len(t) for t in self.tokens], np.int64)
            self.start, self.flat = ends - self.length, np.frombuffer(b"".join(self.tokens), np.uint8)
        return self

    def whole(self, pieces: list[bytes]) -> list[int]:
        """First tier: the id of each piece that is a token, else -1."""
        tokens = self.tokens
        return [i if tokens[i] == p else -1 for i, p in zip(self.hash.find(pieces).tolist(), pieces, strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: the pair of lowest rank first, of equals the leftmost, until no pair is a token."""
        ids = [self.byte[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, p) for i in range(n - 1) if (m := merges.get(p := ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            token, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = token, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(p := token << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, p))
            if (h := before[i]) >= 0 and (m := merges.get(p := ids[h] << 32 | token)) is not None:
                heapq.heappush(heap, (m, h, p))
        return [x for x in ids if x >= 0]


class _Numbers(dict):
    """A number for each distinct piece, counted on in the order of their first use."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.used = 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.used
        self.used += 1
        self.fresh.append(piece)
        return n


class Memory:
    """Ids of pieces, remembered in two generations of at most `most` bytes: when the younger is full it becomes the older one.

    `encode_new` gives the ids of pieces, one after the other, and how many each has. What the older generation knows moves to the younger when it
    is used. Pieces of more than LONG characters are forgotten after their stretch.
    """

    def __init__(self, encode_new, most: int) -> None:
        self.encode_new, self.most = encode_new, most
        self.older: dict[str, int] = {}
        self.older_ids: tuple = ()
        self._start()

    def _start(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.flat, self.start, self.length = array("I"), array("q"), array("q")

    def turn(self) -> None:
        """Between two stretches: numbers given before hold no longer once the generation is full."""
        if self.bytes > self.most:
            self.older, self.older_ids = self.numbers, self._held()
            self._start()

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64), np.frombuffer(self.length, np.int64)

    def learn(self) -> None:
        """Ids of the pieces that have been given numbers since the last call."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        if self.older:
            place = np.fromiter((self.older.get(p, -1) for p in fresh), np.int64, len(fresh))
            new = place < 0
            flat, many = self.encode_new([p for p, n in zip(fresh, new.tolist(), strict=True) if n])
            old_flat, old_start, old_length = self.older_ids
            start, length = old_start[place], old_length[place]
            start[new], length[new] = len(old_flat) + np.cumsum(many) - many, many
            flat = gather(np.concatenate([old_flat, flat]), start, length)
        else:
            flat, length = self.encode_new(fresh)
        first = len(self.flat)
        self.start.frombytes((first + np.cumsum(length) - length).tobytes())
        self.length.frombytes(length.astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.uint32).tobytes())
        sizes = list(map(len, fresh))
        self.bytes += ENTRY * len(fresh) + sum(sizes) + 4 * len(flat)
        if max(sizes) > LONG:
            for p in fresh:
                if len(p) > LONG:
                    del self.numbers[p]

    def ids(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces `used`, one after the other, and how many each has."""
        flat, start, length = self._held()
        many = length[used]
        return gather(flat, start[used], many), many


def flattened(found: Iterator[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists one after the other, and how long each is."""
    flat, many = array("I"), array("q")
    for ids in found:
        flat.extend(ids)
        many.append(len(ids))
    return np.array(flat, np.uint32), np.array(many, np.int64)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after the other."""
    shift = start - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(int(length.sum()))]


#: For texts below U+0250, the general pattern in terms of ranges.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_BLANK = "\\t-\\r \\x85\\xa0"


def splitter(pattern: str):
    """A function from text to its pre-tokens by `pattern`; texts of Latin letters take the same pattern without property look-ups."""
    blank = r"\p{White_Space}"
    general = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{blank}\p{{L}}\p{{N}}]").replace(r"\s", blank).replace(r"\S", rf"\P{{White_Space}}"))
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANK}{_LETTER}{_DIGIT}]").replace(r"[\p{L}]", f"[{_LETTER}]").replace(r"[\p{N}]", f"[{_DIGIT}]")
    plain = plain.replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_DIGIT}]").replace(r"\s", f"[{_BLANK}]").replace(r"\S", f"[^{_BLANK}]")
    latin = re.compile(plain).findall
    return lambda text: latin(text) if text.isascii() or max(text) < "ɐ" else general.findall(text)


class Encoder:
    """Encodes stretches of texts; `encode_new` gives the ids of pieces that are not remembered."""

    def __init__(self, split, encode_new, remembered: int = REMEMBERED) -> None:
        self.split, self.memory = split, Memory(lambda pieces: flattened(encode_new(pieces)), remembered)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.memory.turn()
        number = self.memory.numbers.__getitem__
        used = [np.fromiter(map(number, p), np.int64, len(p)) for p in map(self.split, texts)]
        self.memory.learn()
        return [self.memory.ids(u)[0] if len(u) else np.zeros(0, np.uint32) for u in used]


_workers: dict[str, Encoder] = {}


def _encoder(key: str, pattern: str, vocabulary) -> Encoder:
    """This worker's encoder; pieces that it remembers serve its later tasks as well."""
    if key not in _workers:
        vocab = vocabulary.value.ready()

        def encode_new(pieces: list[str]) -> Iterator[list[int]]:
            raw = [p.encode() for p in pieces]
            for i, p in zip(vocab.whole(raw), raw, strict=True):
                yield [i] if i >= 0 else vocab.merged(p)

        _workers.clear()
        _workers[key] = Encoder(splitter(pattern), encode_new)
    return _workers[key]


def stretches(batch: pa.RecordBatch, column: str, most: int = STRETCH, size: int = STRETCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `most` rows, or fewer that hold `size` bytes in `column`; a larger value is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    begin = held = 0
    for at, n in enumerate(sizes):
        if at > begin and (at - begin == most or held + n > size):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def encode(df: DataFrame, vocab_path: str, pattern: str, text: str = "text", into: str = "ids", count: str = "n_tokens", keep: bool = True) -> DataFrame:
    """`df` with the ids of each whole text, as little-endian unsigned 32-bit integers, and their number; without the text unless it is to `keep`,
    so that texts go to the workers but not back."""
    df = df.drop(into, count)
    kept = [c for c in df.columns if keep or c != text]
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocab_path)))
    key = f"{vocab_path} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, pattern, vocabulary)
        for batch in batches:
            for part in stretches(batch, text):
                texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                ids = encoder.encode(texts)
                columns = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *columns], names=[*kept, into, count])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(into, T.BinaryType()), T.StructField(count, T.LongType())]))


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with the bytes that each row's ids stand for."""
    df = df.drop(into)
    tokens = read_ranks(vocab_path)
    sent = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = np.array([len(t) for t in sent.value], np.int64)
        start, flat = np.cumsum(length) - length, np.frombuffer(b"".join(sent.value), np.uint8)
        for batch in batches:
            for part in stretches(batch, ids):
                found = []
                for x in part.column(part.schema.get_field_index(ids)).to_pylist():
                    n = np.frombuffer(x or b"", "<u4").astype(np.int64)
                    found.append(gather(flat, start[n], length[n]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))
