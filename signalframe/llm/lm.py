"""Language-model scoring by Elias-Fano n-gram tries.

Documents are tokenised once, into a written table of batches that doesn't move again. Batches send
their distinct words, in order and packed, to shards that count and number them. With the numbers
they send their distinct word pairs and triples, with the counts of the training documents among
them, to shards by their first word. A shard adds the counts up, writes a trie of memory-mapped
levels and answers every batch from it; a batch then scores its documents.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bucketed, dealt_keys, written
from .words import Hasher, chunks, mix64, split_words

END = 0x1F3D5B79A2C4E687
ADD = 0.1
#: Weights of the lower order's probability against the counts of a context of one and of two words, by the likelihood of held-out documents.
PRIOR = (2000.0, 5.0)
#: Quantised log10 probabilities: steps a unit; 0 stands for unseen.
STEPS = 4096
BATCH_BYTES = 8 << 20
#: Tokens whose pairs and triples a shard has to itself.
SHARD_TOKENS = 4 << 20
#: Words of batches that a shard counts.
SHARD_WORDS = 4 << 20
#: Entries of a level that are unpacked at once.
CHUNK = 1 << 16


class EliasFano:
    """A sorted list of 64-bit integers: whole low bytes and a unary bit vector of the rest.

    Both may be memory-mapped. Sampled places of ones let chunks of entries be unpacked alone.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, firsts: np.ndarray):
        self.low, self.high, self.ones, self.firsts = low, high, ones, firsts

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low bytes: entry by byte, packed unary bits) of sorted values."""
        n, values = len(values), np.ascontiguousarray(values, np.uint64)
        top = int(values[-1]) + 1 if n else 1
        width = 0
        while width < 8 and top >> (8 * width) > n:
            width += 1
        low = values.view(np.uint8).reshape(n, 8)[:, :width]
        upper = (values >> np.uint64(8 * width) if width < 8 else np.zeros(n, np.uint64)).astype(np.int64)
        bits = np.zeros(n + (int(upper[-1]) if n else 0) + 1, bool)
        bits[upper + np.arange(n)] = True
        return np.ascontiguousarray(low), np.packbits(bits)

    @staticmethod
    def levels(values: np.ndarray) -> tuple[np.ndarray, ...]:
        """What __init__ takes, of sorted values."""
        low, high = EliasFano.parts(values)
        ones = np.flatnonzero(np.unpackbits(high))[::CHUNK] if len(values) else np.zeros(0, np.int64)
        return low, high, ones, np.ascontiguousarray(values[::CHUNK], np.uint64)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        low, high = EliasFano.parts(values)
        return struct.pack("<QB", len(values), low.shape[1]) + low.tobytes() + high.tobytes()

    @staticmethod
    def unpack(raw: bytes) -> np.ndarray:
        n, width = struct.unpack_from("<QB", raw)
        low = np.frombuffer(raw, np.uint8, n * width, 9).reshape(n, width)
        return EliasFano._values(low, np.frombuffer(raw, np.uint8, offset=9 + n * width), 0, 0)

    @staticmethod
    def _values(low: np.ndarray, high: np.ndarray, skipped: int, first: int) -> np.ndarray:
        """Entries first, first + 1, ...: low bytes, and unary bits of which `skipped` aren't given."""
        at = np.flatnonzero(np.unpackbits(high))[: len(low)] + skipped
        out = np.zeros((len(low), 8), np.uint8)
        out[:, : low.shape[1]] = low
        values = out.view(np.uint64).ravel()
        width = low.shape[1]
        return values | ((at - np.arange(first, first + len(low))).astype(np.uint64) << np.uint64(8 * width)) if width < 8 else values

    def __len__(self) -> int:
        return len(self.low)

    def chunk(self, k: int) -> np.ndarray:
        """Entries k * CHUNK to (k + 1) * CHUNK - 1."""
        lo = int(self.ones[k])
        hi = int(self.ones[k + 1]) if k + 1 < len(self.ones) else len(self.high) * 8
        part = np.array(self.high[lo // 8 : -(-hi // 8)])
        part[0] &= 0xFF >> (lo % 8)
        return self._values(self.low[k * CHUNK : (k + 1) * CHUNK], part, lo // 8 * 8, k * CHUNK)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Entries at sorted places."""
        out = np.empty(len(at), np.uint64)
        edge = np.searchsorted(at, np.arange(len(self.ones) + 1) * CHUNK)
        for k in range(len(self.ones)):
            if edge[k] < edge[k + 1]:
                out[edge[k] : edge[k + 1]] = self.chunk(k)[at[edge[k] : edge[k + 1]] - k * CHUNK]
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each of sorted values, or -1."""
        out = np.full(len(wanted), -1)
        edge = np.append(np.searchsorted(wanted, self.firsts), len(wanted))
        for k in range(len(self.ones)):
            lo, hi = edge[k], edge[k + 1]
            if lo < hi:
                values = self.chunk(k)
                at = np.searchsorted(values, wanted[lo:hi])
                same = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == wanted[lo:hi])
                out[lo:hi] = np.where(same, at + k * CHUNK, -1)
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities (0 to 1) in STEPS a unit from -15.99 up; 0 only for probability 0."""
    level = np.rint((np.log10(np.maximum(p, 1e-15)) + 15.99) * STEPS)
    return np.where(p > 0, np.maximum(level, 1), 0).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10 ** (q / STEPS - 15.99), 0.0)


class Trie:
    """Word pairs and triples seen in training, with the quantised probabilities of both.

    Level 1 has first words, level 2 the successors of each, level 3 those of each pair. Entries
    are numbered relative to their context: place of the context * size + word. Monotone pointers
    lead from a context to its successors. All levels are mapped from one file.
    """

    def __init__(self, size: int, pairs: np.ndarray, pair_p: np.ndarray, context: np.ndarray, word: np.ndarray, triple_p: np.ndarray):
        """pairs: first word * size + second, sorted; context, word: places of triples' pairs and third words, sorted."""
        self.size = np.uint64(size)
        first = pairs // self.size
        new = np.ones(len(pairs), bool)
        new[1:] = first[1:] != first[:-1]
        parent = (np.cumsum(new) - 1).astype(np.uint64)
        lists = [
            first[new],
            np.append(np.flatnonzero(new), len(pairs)).astype(np.uint64),
            parent * self.size + pairs % self.size,
            np.searchsorted(context, np.arange(len(pairs) + 1)).astype(np.uint64),
            context.astype(np.uint64) * self.size + word,
        ]
        arrays = [a for values in lists for a in EliasFano.levels(values)] + [quantise(pair_p), quantise(triple_p)]
        self.file = tempfile.TemporaryFile()
        places = []
        for a in arrays:
            self.file.seek(-self.file.tell() % 8, 1)
            places.append((self.file.tell(), a.dtype, a.shape))
            self.file.write(a.tobytes())
        self.file.flush()
        mapped = [np.memmap(self.file, t, "r", at, shape) if np.prod(shape) else np.zeros(shape, t) for at, t, shape in places]
        self.words, self.to_pairs, self.pairs, self.to_triples, self.triples = (EliasFano(*mapped[k : k + 4]) for k in range(0, 20, 4))
        self.pair_level, self.triple_level = mapped[20:]

    def close(self) -> None:
        self.file.close()

    def _successors(self, pointers: EliasFano, level: EliasFano, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words among the successors of contexts at (rising) places, or -1."""
        out = np.full(len(place), -1)
        known = np.flatnonzero(place >= 0)
        at = place[known]
        # Contexts without successors are done with their pointers.
        known = known[pointers.get(at) < pointers.get(at + 1)] if len(at) else known
        out[known] = level.find(place[known].astype(np.uint64) * self.size + word[known])
        return out

    def find_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Places of sorted pairs (first word * size + second), or -1."""
        first, at = np.unique(pairs // self.size, return_inverse=True)
        return self._successors(self.to_pairs, self.pairs, self.words.find(first)[at], pairs % self.size)

    def find_triples(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._successors(self.to_triples, self.triples, context, word)


def _small(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them below 255, in few bytes."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(low.tobytes() + counts[low == 255].astype(np.uint64).tobytes(), 1)


def _from_small(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n).astype(np.int64)
    return out


BATCHES = "ids array<long>, held array<boolean>, n_words long, sizes binary, words binary, word_n binary, low binary, high binary"


def _batch(part: pa.RecordBatch, hasher: Hasher) -> pa.RecordBatch:
    """One row: the documents, their sizes in tokens, and tokens as places among the batch's words, frequent ones first."""
    hashes, sizes = [], []
    for first, last, data, offsets in chunks(part.column(1)):
        words = split_words(data, offsets, hasher)
        count = np.bincount(words.doc, minlength=last - first) + 1
        h = np.full(count.sum(), END, np.uint64)
        own = np.ones(len(h), bool)
        own[np.cumsum(count) - 1] = False
        h[own] = words.hash
        hashes.append(h)
        sizes.append(count)
    held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
    size = np.concatenate(sizes).astype(np.uint32)
    word, token, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    token = rank[token]
    trained = np.bincount(token, weights=~np.repeat(held, size), minlength=len(word)).astype(np.uint32)
    columns = (size, word[order], trained, (token & np.uint32(0xFFFF)).astype(np.uint16), (token >> np.uint32(16)).astype(np.uint16))
    kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([*(pa.array([part.column(c).to_pylist()], k) for c, k in zip((0, 2), kinds, strict=True)), pa.array([len(word)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], [c.split()[0] for c in BATCHES.split(", ")])


def _split(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column(1).nbytes
        step = max(1, batch.num_rows * BATCH_BYTES // max(1, size))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


class Ngrams:
    """Distinct pairs and triples of a batch, and the shards that count them, in a fixed order.

    Words have numbers, size - 1 stands before a document's first word, and words that training
    lacks take no part. An n-gram goes to the shard of its first word that isn't hot, so that no
    shard has all that begins with a frequent word.
    """

    def __init__(self, token: np.ndarray, sizes: np.ndarray, number: np.ndarray, size: int, hot: np.ndarray, shards: int):
        word = number[token]
        first = np.zeros(len(word), bool)
        first[np.cumsum(sizes, dtype=np.int64) - sizes] = True
        before = np.empty(len(word), np.int64)
        before[1:] = word[:-1]
        before[first] = size - 1
        fine = np.flatnonzero((word >= 0) & (before >= 0))
        self.pairs, at = np.unique(before[fine].astype(np.uint64) * np.uint64(size) + word[fine].astype(np.uint64), return_inverse=True)
        self.pair_at = np.full(len(word), -1, np.int32)
        self.pair_at[fine] = at
        context = np.empty(len(word), np.int32)
        context[1:] = self.pair_at[:-1]
        context[first] = -1
        fine = np.flatnonzero((word >= 0) & (context >= 0))
        triples, at = np.unique(context[fine].astype(np.uint64) * np.uint64(size) + word[fine].astype(np.uint64), return_inverse=True)
        self.triple_at = np.full(len(word), -1, np.int32)
        self.triple_at[fine] = at
        self.context, self.word = (triples // np.uint64(size)).astype(np.int64), triples % np.uint64(size)
        self.size, self.shards = size, shards
        home = lambda x: (mix64(x + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        warm = lambda x: ~np.isin(x, hot) & (x != size - 1)
        u, v = self.pairs // np.uint64(size), self.pairs % np.uint64(size)
        pair_home = np.where(warm(u), home(u), home(v))
        # A pair of a hot word and another lives with the other, and so do the triples that begin with it.
        triple_home = np.where((warm(u) | warm(v))[self.context], pair_home[self.context], home(self.word))
        self.pair_order, self.triple_order = np.argsort(pair_home, kind="stable"), np.argsort(triple_home, kind="stable")
        edges = np.arange(shards + 1)
        self.pair_edge, self.triple_edge = np.searchsorted(pair_home[self.pair_order], edges), np.searchsorted(triple_home[self.triple_order], edges)

    def questions(self, trained: np.ndarray) -> Iterator[tuple]:
        """(shard, pairs, whether they are asked, counts, triples, counts), packed, of each shard that has any."""
        pair_n = np.bincount(self.pair_at[self.pair_at >= 0], weights=trained[self.pair_at >= 0], minlength=len(self.pairs)).astype(np.int64)
        triple_n = np.bincount(self.triple_at[self.triple_at >= 0], weights=trained[self.triple_at >= 0], minlength=len(self.word)).astype(np.int64)
        for s in range(self.shards):
            own = self.pair_order[self.pair_edge[s] : self.pair_edge[s + 1]]
            triples = self.triple_order[self.triple_edge[s] : self.triple_edge[s + 1]]
            if len(own) + len(triples) == 0:
                continue
            # Triples of two hot words come here by their third: their pairs come along, without counts.
            every = np.union1d(own, self.context[triples])
            asked = np.isin(every, own, assume_unique=True)
            relative = np.searchsorted(every, self.context[triples]).astype(np.uint64) * np.uint64(self.size) + self.word[triples]
            yield s, EliasFano.pack(self.pairs[every]), b"" if asked.all() else np.packbits(asked).tobytes(), _small(np.where(asked, pair_n[every], 0)), EliasFano.pack(relative), _small(triple_n[triples])


QUESTIONS = "deal int, shard int, batch long, pairs binary, asked binary, pair_n binary, triples binary, triple_n binary"
ANSWERS = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("pairs", pa.binary()), ("triples", pa.binary())])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _answers(rows: pa.Table, size: int, total: int) -> pa.Table:
    """Quantised probabilities (of all training tokens) of the pairs and triples that each batch asks for."""
    size_ = np.uint64(size)
    pairs = [EliasFano.unpack(x.as_py()) for x in rows["pairs"]]
    edge = np.cumsum([0, *map(len, pairs)])
    every, at = np.unique(np.concatenate(pairs), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([_from_small(x.as_py(), len(p)) for x, p in zip(rows["pair_n"], pairs, strict=True)]), minlength=len(every))
    del pairs
    triples = [EliasFano.unpack(x.as_py()) for x in rows["triples"]]
    triple_edge = np.cumsum([0, *map(len, triples)])
    triple_n = np.concatenate([_from_small(x.as_py(), len(t)) for x, t in zip(rows["triple_n"], triples, strict=True)])
    for b, t in enumerate(triples):
        triples[b] = at[edge[b] : edge[b + 1]][(t // size_).astype(np.int64)].astype(np.uint64) * size_ + t % size_
    triple, triple_at = np.unique(np.concatenate(triples), return_inverse=True)
    triple_n = np.bincount(triple_at, weights=triple_n, minlength=len(triple))
    del triples
    context, word = (triple // size_).astype(np.int64), triple % size_
    seen3 = triple_n > 0
    # The trie holds what was seen in training, and the pairs on the way to it.
    seen2 = count > 0
    seen2[context[seen3]] = True
    place = np.cumsum(seen2) - 1
    trie = Trie(size, every[seen2], count[seen2] / total, place[context[seen3]], word[seen3], triple_n[seen3] / total)
    found = trie.find_pairs(every)
    level2 = np.where(found >= 0, trie.pair_level[np.maximum(found, 0)], 0).astype(np.uint16) if seen2.any() else np.zeros(len(every), np.uint16)
    found = trie.find_triples(found[context], word)
    level3 = np.where(found >= 0, trie.triple_level[np.maximum(found, 0)], 0).astype(np.uint16) if seen3.any() else np.zeros(len(triple), np.uint16)
    trie.close()
    out2, out3 = [], []
    for b, asked in enumerate(rows["asked"].to_pylist()):
        mine = level2[at[edge[b] : edge[b + 1]]]
        if asked:
            mine = mine[np.unpackbits(np.frombuffer(asked, np.uint8))[: len(mine)].astype(bool)]
        out2.append(zlib.compress(mine.tobytes(), 1))
        out3.append(zlib.compress(level3[triple_at[triple_edge[b] : triple_edge[b + 1]]].tobytes(), 1))
    return pa.table([rows["batch"], rows["shard"], pa.array(out2, pa.binary()), pa.array(out3, pa.binary())], schema=ANSWERS)


def _tokens(row: dict) -> np.ndarray:
    return np.frombuffer(row["low"], np.uint16).astype(np.int32) | (np.frombuffer(row["high"], np.uint16).astype(np.int32) << 16)


WORD_QUESTIONS = "deal int, shard int, batch long, words binary, n binary"
WORD_ANSWERS = "batch long, shard int, known binary, ranks binary, n binary, v long, total long, ends long, hot array<long>"


def word_home(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of sorted hashes, rising with them."""
    return ((words >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _ask_words(row: dict, shards: int) -> Iterator[tuple]:
    words, n = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["word_n"], np.uint32)
    order = np.argsort(words)
    words, n = words[order], n[order]
    edge = np.searchsorted(word_home(words, shards), np.arange(shards + 1))
    for s in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        lo, hi = edge[s], edge[s + 1]
        yield s, row["batch"], EliasFano.pack(words[lo:hi]), _small(n[lo:hi].astype(np.int64))


def _count_words(rows: pa.Table, hot_n: float) -> pa.Table:
    """Training counts of a shard's words, and for each batch the ranks of those that it holds among those that training has."""
    words = [EliasFano.unpack(x.as_py()) for x in rows["words"]]
    edge = np.cumsum([0, *map(len, words)])
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([_from_small(x.as_py(), len(w)) for x, w in zip(rows["n"], words, strict=True)]), minlength=len(every)).astype(np.int64)
    known = n > 0
    rank = np.cumsum(known) - 1
    facts = (int(known.sum()), int(n.sum()), int(n[every == np.uint64(END)].sum()), rank[n >= hot_n].tolist())
    out = []
    for b, batch in enumerate(rows["batch"].to_pylist()):
        mine = at[edge[b] : edge[b + 1]]
        told = mine[known[mine]]
        # A shard's facts come with its first row.
        out.append((batch, rows["shard"][b].as_py(), np.packbits(known[mine]).tobytes(), EliasFano.pack(rank[told]), _small(n[told]), *(facts if b == 0 else (None,) * 4)))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in WORD_ANSWERS.split(", ")])


def _numbers(row: dict, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number or -1, training count) of each word of a batch; starts: the first number of each word shard."""
    words = np.frombuffer(row["words"], np.uint64)
    number, count = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    order = np.argsort(words)
    edge = np.searchsorted(word_home(words[order], len(starts)), np.arange(len(starts) + 1))
    for a in row["known"] or []:
        mine = order[edge[a["shard"]] : edge[a["shard"] + 1]]
        mine = mine[np.unpackbits(np.frombuffer(a["known"], np.uint8))[: len(mine)].astype(bool)]
        number[mine] = EliasFano.unpack(a["ranks"]).astype(np.int64) + starts[a["shard"]]
        count[mine] = _from_small(a["n"], len(mine))
    return number, count


def _scores(row: dict, starts: np.ndarray, size: int, hot: np.ndarray, shards: int, total: int, ends: int) -> pa.Table:
    number, count = _numbers(row, starts)
    token, sizes = _tokens(row), np.frombuffer(row["sizes"], np.uint32)
    grams = Ngrams(token, sizes, number, size, hot, shards)
    level2, level3 = np.zeros(len(grams.pairs), np.uint16), np.zeros(len(grams.word), np.uint16)
    for a in row["answers"] or []:
        s = a["shard"]
        level2[grams.pair_order[grams.pair_edge[s] : grams.pair_edge[s + 1]]] = np.frombuffer(zlib.decompress(a["pairs"]), np.uint16)
        level3[grams.triple_order[grams.triple_edge[s] : grams.triple_edge[s + 1]]] = np.frombuffer(zlib.decompress(a["triples"]), np.uint16)
    # Expected counts; the last entry stands for n-grams with a word that training lacks.
    n2, n3 = np.append(restore(level2) * total, 0.0), np.append(restore(level3) * total, 0.0)
    own = (count + ADD) / (total + ADD * (size - 1 + 1))
    one = own[token]
    first = np.zeros(len(token), bool)
    first[np.cumsum(sizes, dtype=np.int64) - sizes] = True
    before = np.empty(len(token))
    before[1:] = count[token[:-1]]
    before[first] = ends
    two = (n2[grams.pair_at] + PRIOR[0] * one) / (before + PRIOR[0])
    context = np.empty(len(token))
    context[1:] = n2[grams.pair_at[:-1]]
    context[first] = 0.0
    # Rounding must not make a triple likelier than its context.
    three = (np.minimum(n3[grams.triple_at], context) + PRIOR[1] * two) / (context + PRIOR[1])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": sizes.astype(np.int64), "n_known": add(count[token] > 0).astype(np.int64), "train_tokens": np.full(len(sizes), total, np.int64), "base_score": add(np.log10(one)), "score": add(np.log10(three))})


def score(docs: DataFrame, held_out: Column, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """RESULT for every row of docs (doc_id, text), learning from the rows that aren't held out.

    Tokens are lower-cased words and one end; null and empty texts have the end alone. The model
    is a trigram one: Dirichlet priors lead from a word's own smoothed probability, which is what
    base_score adds up, over pairs to triples. Repeated rows count and are scored each; null ids are
    held in if held_out says so. Without training rows N is 0 and each token has probability 1. An
    empty table gives no rows. shard_tokens: how many tokens' n-grams a shard counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))

    def tokenise(batches):
        hasher = Hasher()
        for part in _split(batches):
            yield _batch(part, hasher)

    batches = bucketed(rows.mapInArrow(tokenise, BATCHES).withColumn("batch", F.monotonically_increasing_id()), "lm-batches", "batch")
    word_shards = max(1, -(-(batches.agg(F.sum("n_words")).collect()[0][0] or 0) // SHARD_WORDS))

    word_keys = dealt_keys(spark, word_shards)

    def ask_words(parts):
        for part in parts:
            for row in part.to_pylist():
                out = [(word_keys[r[0]], *r) for r in _ask_words(row, word_shards)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])], [c.split()[0] for c in WORD_QUESTIONS.split(", ")])

    asked = batches.select("batch", "words", "word_n").mapInArrow(ask_words, WORD_QUESTIONS)
    # A word that fills half a shard of n-grams is hot.
    counted = asked.repartition(word_shards, "deal").groupBy("deal").applyInArrow(lambda table: _count_words(table, shard_tokens / 2), WORD_ANSWERS)
    counted = written(counted, "lm-words")
    # One row of sums a shard of words.
    facts = sorted((r["shard"], r["v"], r["total"], r["ends"], r["hot"]) for r in counted.where("v IS NOT NULL").select("shard", "v", "total", "ends", "hot").collect())
    each = np.zeros(word_shards, np.int64)
    each[[f[0] for f in facts]] = [f[1] for f in facts]
    starts = np.cumsum(each) - each
    hot = np.array(sorted(starts[f[0]] + k for f in facts for k in f[4]), np.int64).astype(np.uint64)
    total, size, ends = sum(f[2] for f in facts), sum(f[1] for f in facts) + 1, sum(f[3] for f in facts)
    shards = max(1, -(-total // shard_tokens))
    keys = dealt_keys(spark, shards)
    known = counted.groupBy("batch").agg(F.collect_list(F.struct("shard", "known", "ranks", "n")).alias("known"))
    told = batches.join(known, "batch", "left")

    def ask(key, table):
        out = []
        for row in table.to_pylist():
            number, _ = _numbers(row, starts)
            sizes = np.frombuffer(row["sizes"], np.uint32)
            grams = Ngrams(_tokens(row), sizes, number, size, hot, shards)
            out += [(keys[s], s, row["batch"], *rest) for s, *rest in grams.questions(~np.repeat(np.array(row["held"], bool), sizes))]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5])], [c.split()[0] for c in QUESTIONS.split(", ")])

    questions = told.select("batch", "held", "sizes", "words", "low", "high", "known").groupBy("batch").applyInArrow(ask, QUESTIONS)
    answered = questions.repartition(shards, "deal").groupBy("deal").applyInArrow(lambda table: _answers(table, size, total), "batch long, shard int, pairs binary, triples binary")
    answers = answered.groupBy("batch").agg(F.collect_list(F.struct("shard", "pairs", "triples")).alias("answers"))

    def tell(key, table):
        return pa.concat_tables([_scores(row, starts, size, hot, shards, total, ends) for row in table.to_pylist()])

    return told.drop("word_n", "n_words").join(answers, "batch", "left").groupBy("batch").applyInArrow(tell, RESULT)
