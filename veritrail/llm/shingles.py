"""Hashes of words and word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose hashes are taken together.
STRETCH = 1_000_000
_fixed = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _fixed.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _fixed.integers(0, 2**64, 65, dtype=np.uint64) | np.uint64(1)
_BASE = int(_fixed.integers(0, 2**64, dtype=np.uint64)) | 1
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of all texts, and the number of words in each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _power(len(data) + 1)
    blank = _BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(start):
        end = end[len(end) - len(start) :]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    stop = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, stop), prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in order; a text of fewer words has one, of all its words, and one without words has none."""
    n = len(hashes) - width + 1
    rolled = sum((hashes[i : i + n] * _PLACE[i] for i in range(width)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
    rolled = mix(rolled + np.uint64(width))
    at = 0
    for c in counts.tolist():
        if c >= width:
            yield rolled[at : at + c - width + 1]
        else:
            yield mix((hashes[at : at + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)) if c else rolled[:0]
        at += c


def text_bytes(column: pa.Array, lower: bool = True) -> list[bytes]:
    """UTF-8 of each text; null is empty. `lower`: A-Z in lower case, nothing else."""
    raw = [x.as_py() or b"" for x in column.cast(pa.binary())]
    return [x.lower() for x in raw] if lower else raw


def stretches(sizes: list[int], most: int = STRETCH) -> Iterator[slice]:
    """Slices of rows whose texts are about `most` bytes together."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))
