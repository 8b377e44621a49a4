"""Periodic runs of words: bit planes of word numbers against themselves at each lag.

A run of period q is a stretch of words that equal those q places on. Bit k of all word numbers
is one big integer, a plane; planes XORed with themselves shifted by q and ORed have a zero where
words agree, and ANDs with shifts that double isolate the zero stretches that are long enough.
Lags beyond 63 words are tried only where a block of words recurs at them, which no run lacks.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, chunks, coded_words, mix64, spare

#: Least words of a run.
LEAST = 12
#: Lags below are all tried; and the first width of the blocks that choose further ones.
NEAR, BLOCK = 64, 32
#: Planes after which the stretches are looked for, so that most lags need no further ones.
PLANES = 4
#: Comparisons of blocks held at once.
COMPARED = 1 << 22


class Planes:
    """Word numbers as big integers, bit i of plane k being bit k of word i; planes are made when first asked for."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.width = int(ids.max()).bit_length() if len(ids) else 0
        self.made: list[int] = []

    def __getitem__(self, k: int) -> int:
        while len(self.made) <= k:
            bits = (self.ids >> len(self.made) & 1).astype(np.uint8)
            self.made.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        return self.made[k]

    def stretches(self, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each maximal stretch of at least `least` words that equal those `lag` places on."""
        whole = (1 << (self.n - lag)) - 1
        differs = k = 0
        while True:
            for k in range(k, min(k + PLANES, self.width)):  # noqa: B020
                differs |= self[k] ^ self[k] >> lag
            k += 1
            # Bit i stays while words i to i + held - 1 agree.
            left, held = whole & ~differs, 1
            while left and held < least:
                step = min(held, least - held)
                left &= left >> step
                held += step
            if not left:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if k >= self.width:
                break
        begins, ends = places(left & ~(left << 1)), places(left & ~(left >> 1))
        return begins, ends - begins + least


def places(bits: int) -> np.ndarray:
    """The numbers of the set bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))


def divisors(q: int) -> list[int]:
    """Those below q."""
    low = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return [d for d in {*low, *(q // d for d in low)} if d < q]


class Found:
    """Runs so far, by period in order of start; a stretch inside one of a period that divides its lag is that run again."""

    def __init__(self):
        self.by: dict[int, tuple[list[int], list[int]]] = {}

    def holds(self, lag: int, start: int, end: int) -> bool:
        for p in divisors(lag):
            if p in self.by:
                starts, ends = self.by[p]
                k = bisect_right(starts, start) - 1
                if k >= 0 and ends[k] >= end:
                    return True
        return False

    def covered(self, at: np.ndarray, most: int) -> np.ndarray:
        """How far the runs of periods up to `most` that hold a place reach; the place itself without any."""
        rows = sorted((s, e) for p, (a, b) in self.by.items() if p <= most for s, e in zip(a, b, strict=True))
        if not rows:
            return at
        starts, ends = np.array(rows).T
        k = np.searchsorted(starts, at, "right")
        return np.maximum(at, np.concatenate([[0], np.maximum.accumulate(ends)])[k])


def likely_lags(names: np.ndarray, m: int, most: int, found: Found) -> np.ndarray:
    """Lags from 2m to 4m - 1, at most `most`, at which a block of m words that starts at a multiple of m recurs.

    names: of the m words from each place on. A run of such a period q has a block among its first
    q words that recurs q places on. If the block and its recurrence lie in one run of a period of
    m or less, then q's stretch has that smaller period as well, so such a pair needs no trial.
    """
    blocks = np.arange(0, len(names) - 2 * m, m)
    if not len(blocks):
        return np.zeros(0, np.int64)
    reach = found.covered(blocks, m)
    after = np.lib.stride_tricks.sliding_window_view(np.append(names, np.zeros(4 * m, names.dtype)), 2 * m)
    lags = np.zeros(2 * m, bool)
    for lo in range(0, len(blocks), step := max(1, COMPARED // (2 * m))):
        b = blocks[lo : lo + step]
        # Of the lags 2m + k, those at which the two aren't in one covered stretch.
        same = after[b + 2 * m] == names[b][:, None]
        inner = reach[lo : lo + step] - b - 3 * m
        for row in np.flatnonzero(inner >= 0):
            same[row, : inner[row] + 1] = False
        lags |= same.any(axis=0)
    q = np.flatnonzero(lags) + 2 * m
    return q[q <= most]


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, ordered by start, then period.

    A run is a stretch with smallest period q, of at least `least` and 2q words, that no word beside
    it extends. By the theorem of Fine and Wilf a smaller period of such a stretch divides q, so a
    stretch is a run unless it lies in a run of a smaller period that divides its own.
    """
    ids = np.asarray(ids, np.int64)
    n, found = len(ids), Found()
    if n < least:
        return []
    planes, most = Planes(ids), n // 2
    if planes.width == 0:
        return [(0, n, 1)]

    def tried(q: int) -> None:
        starts, sizes = planes.stretches(q, max(least - q, q))
        own = [(s, s + size + q) for s, size in zip(starts.tolist(), sizes.tolist(), strict=True)]
        if own := [x for x in own if not found.holds(q, *x)]:
            found.by[q] = ([s for s, _ in own], [e for _, e in own])

    for q in range(1, min(most, NEAR - 1) + 1):
        tried(q)
    m, names = 1, mix64(ids.astype(np.uint64) + np.uint64(1))
    while 2 * m <= most:
        if m >= BLOCK:
            for q in likely_lags(names, m, most, found).tolist():
                tried(q)
        # The name of 2m words is made of those of its halves.
        names = mix64(names[:-m] * np.uint64(0x9E3779B97F4A7C15) + names[m:])
        m *= 2
    return sorted((s, e - s, q) for q, (a, b) in found.by.items() for s, e in zip(a, b, strict=True))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: not those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For ids whose crc32 ends in 0: which original word stands at each place, a tail of the text being made periodic.

    Other ids, a null id and texts without words keep their order (None).
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


FIELDS = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
DIGESTS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def _batches(batches, least: int, order, digests: bool):
    for batch in batches:
        keep = batch.num_columns - 2
        for first, last, data, offsets in chunks(batch.column(keep)):
            keys = batch.column(keep + 1).slice(first, last - first).to_pylist()
            words, codes, at = coded_words(data, offsets, ~SPACE)
            vocabulary = [w.encode() for w in words.to_pylist()]
            rows = []
            for key, lo, hi in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = codes[lo:hi]
                if order is not None and (moved := order(key, len(ids))) is not None:
                    ids = ids[moved]
                runs = find_runs(ids, least)
                text = b" ".join([vocabulary[k] for k in ids[kept_words(len(ids), runs)].tolist()])
                if digests:
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                    power = 1000 * best[1] // best[2] if runs else None
                    rows.append((len(runs), *best, power, _digest("".join(f"{s},{z},{p}\n" for s, z, p in runs).encode()), _digest(text)))
                else:
                    rows.append((len(ids), [{"start": s, "length": z, "period": p} for s, z, p in runs], text.decode()))
            kinds = {"long": pa.int64(), "string": pa.string()}
            names = DIGESTS if digests else FIELDS
            made = [pa.array(c, kinds.get(t) or pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)]
            kept = batch.slice(first, last - first).columns[:keep]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:keep], *names])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, least: int = LEAST, order=None, digests: bool = False) -> DataFrame:
    """Columns keep plus n_words, runs (start, length and period in words) and collapsed, of each row's whole text.

    Words are runs of other characters than ASCII white space, case counts. collapsed has the words
    that no run holds after its first period, joined by one space. order: a function of key and
    number of words that gives the places of the words to judge in their place (None: as they are).
    digests: counts, the longest run and SHA-256 digests instead (DIGESTS). Null and empty texts,
    and those of white space, have no words: no run, an empty collapsed text. Repeated rows and
    extra columns pass through, a kept column named as a result is refused, and an empty table has
    an empty result. Texts are worked on alone, in time that grows with their length times the lags
    at which blocks recur.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    result = DIGESTS if digests else FIELDS
    if clash := set(keep) & set(result):
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} {t}" for c, t in result.items()])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(spare("__text", keep)), F.col(f"`{key}`").alias(spare("__key", keep)))
    return rows.mapInArrow(lambda batches: _batches(batches, least, order, digests), schema)
