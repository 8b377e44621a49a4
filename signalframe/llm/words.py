"""Vectorised tokenising of Arrow text columns: word spans and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


def spare(name: str, taken: list[str]) -> str:
    """name, with underscores until no column of taken has it in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class Words(NamedTuple):
    """Words of documents first..last: start and end byte in data, number within the chunk, hash."""

    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # of the documents in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents of about limit bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Hasher:
    """Polynomial hashes of byte spans by prefix sums modulo 2**64, then mixed."""

    FACTOR = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            for name, factor in (("power", self.FACTOR), ("inverse", pow(self.FACTOR, -1, 2**64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * self.inverse[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def split_words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of a chunk, A-Z lower-cased; no word crosses a document's end."""
    data = LOWER[data]
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = solid[cut]
    ends[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, doc, hasher.spans(data, start, end))


class Coded(NamedTuple):
    """Words of the documents of a chunk as numbers: dictionary, number of each word, and each document's first."""

    words: pa.Array  # distinct, large_string
    codes: np.ndarray
    first: np.ndarray  # of each document, and the end


def coded_words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> Coded:
    """The runs of bytes that solid (by byte value) marks, cut at the ends of documents, numbered by first place in the chunk."""
    held = solid[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = held[cut]
    start = np.flatnonzero(begins)
    # A word ends where the next one begins among the solid bytes.
    bounds = np.append(np.flatnonzero(begins[held]), np.count_nonzero(held)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[held])]).dictionary_encode()
    return Coded(words.dictionary, words.indices.to_numpy(), np.searchsorted(start, offsets))
