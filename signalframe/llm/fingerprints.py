"""Document fingerprints by a randomised edit embedding.

A walk reads a text's characters; after each step a shared random function of the step and the
character tells whether it goes on to the next one. Walks over texts with few edits fall into step
again, so edit distance becomes Hamming distance between what the walks read. A fingerprint
samples bits of the walk; masks that cover all small differences find candidates, and the whole
fingerprint decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .link import components, matrix
from .storage import dealt_keys, sent_if_small, written

PERIOD = 4096
SYMBOLS = 256
#: Bits of a fingerprint, each of a step of its own.
SAMPLES = 512
#: Likeness from which fingerprints link.
LEAST = 0.8
#: Up to so many fingerprints are searched by one task; more are dealt to this many parts at least, of so many rows at most.
FEW, PARTS, PART_ROWS = 4096, 8, 1 << 18
GROUP_CHARS = 1 << 23
#: Texts that are walked together while so many are left; the rest one by one.
TOGETHER = 48


class Embedding:
    """Shared walks: wait[c, t] is the number of steps spent at character class c from time t on."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        go = rng.random((SYMBOLS, PERIOD)) < 0.5
        go[:, -1] = True
        wait = np.zeros((SYMBOLS, PERIOD), np.int32)
        for t in range(PERIOD - 2, -1, -1):
            wait[:, t] = np.where(go[:, t], 0, wait[:, t + 1] + 1)
        self.wait, self.waits = wait.ravel(), None
        #: The bit that each sample tells of a character class.
        self.bit = rng.random((SAMPLES, SYMBOLS)) < 0.5
        self.records = [self._records(np.random.default_rng([seed, k])) for k in range(SAMPLES)]

    @staticmethod
    def _records(rng) -> np.ndarray:
        """Where a run of uniform draws has new minima: the last below n is uniform over n steps,
        and walks of lengths m < n share it with odds of m / n."""
        at, low = [0], rng.random()
        while at[-1] < 2**40 and low > 1e-15:
            at.append(at[-1] + 1 + int(np.log(rng.random()) / np.log1p(-low)))
            low *= rng.random()
        return np.array(at, np.int64)

    def _alone(self, symbols: bytes, time: int) -> list[int]:
        """When each of the characters is left, from a time on, and the time after the last."""
        if self.waits is None:
            self.waits = self.wait.tolist()
        waits, out = self.waits, []
        for c in symbols:
            time += waits[c * PERIOD + time % PERIOD]
            out.append(time)
            time += 1
        return out

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """Text by byte: SAMPLES bits of the character classes read at the sampled steps; 0 throughout if empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = ((code * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        kind = np.int32 if longest < 2**28 else np.int64
        starts, alive = first[order], len(order) - np.searchsorted(sizes[order][::-1], np.arange(longest), "right")
        left = np.empty(len(symbol), kind)  # the step at which each character is left
        time = np.zeros(len(order), kind)
        wait, mask = self.wait, kind(PERIOD - 1)
        together = int(np.searchsorted(-alive, -TOGETHER, "right")) if longest else 0
        for step, n in enumerate(alive[:together].tolist()):
            at = starts[:n] + step
            now = time[:n]
            row = symbol[at].astype(np.int32)
            row *= PERIOD
            row += (now & mask).astype(np.int32)
            now += wait[row]
            left[at] = now
            now += 1
        for k in range(int(alive[together]) if together < longest else 0):
            lo, hi = starts[k] + together, starts[k] + sizes[order[k]]
            left[lo:hi] = self._alone(symbol[lo:hi].tobytes(), int(time[k]))
            time[k] = left[hi - 1] + 1
        bits = np.zeros((len(texts), SAMPLES), bool)
        length = np.zeros(len(texts), np.int64)
        length[order] = time
        steps = np.stack([r[np.searchsorted(r, np.maximum(length, 1) - 1, "right") - 1] for r in self.records], axis=1)
        sample = np.arange(SAMPLES)
        for i in np.flatnonzero(sizes):
            own = left[first[i] : first[i] + sizes[i]]
            bits[i] = self.bit[sample, symbol[first[i] + np.searchsorted(own, steps[i])]]
        return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: how many of the sampled steps read alike, from the bits that agree; unlike ones agree by halves."""
    unlike = np.bitwise_count(np.bitwise_xor(a, b)).sum(axis=1, dtype=np.int64)
    return np.maximum(1 - 2 * unlike / SAMPLES, 0.0)


def most_unlike(least: float = LEAST) -> int:
    """How many bits of two fingerprints of likeness `least` (above 0) may differ."""
    most = SAMPLES // 2
    while most and 1 - 2 * most / SAMPLES < least:
        most -= 1
    return most


def _words(flat: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as a number each."""
    packed = np.packbits(flat, axis=1)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)[:, 0]


def cover(prints: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits, masks) of blocks of bits: of any two fingerprints with at most `most` unlike bits, one mask hides them in its block.

    So many blocks that one of them holds at most `radius` unlike bits. There each bit has a vector of
    radius + 1 bits, and a mask a vector too: it keeps the bits whose vectors have an odd product with
    its own. Some mask's vector is orthogonal to any `radius` vectors (covering locality-sensitive
    hashing, Pagh 2016). The radius is that of the least work for so many prints.
    """

    def work(radius):
        blocks = max(SAMPLES // 64, most // (radius + 1) + 1)
        kept = SAMPLES / blocks * 2**radius / (2 ** (radius + 1) - 1)
        # Sorting a key takes about a quarter of what a pair takes; bits of unlike prints agree somewhat more often than by halves.
        return blocks * (2 ** (radius + 1) - 1) * (prints + 2 * prints**2 * 2 ** (-0.8 * kept)), radius, blocks

    _, radius, blocks = min(work(r) for r in range(1, 7))
    rng, out = np.random.default_rng(17), []
    for bits in np.array_split(rng.permutation(SAMPLES), blocks):
        vector = np.resize(1 + rng.permutation(2 ** (radius + 1) - 1), len(bits))
        kept = np.bitwise_count(vector & np.arange(1, 2 ** (radius + 1))[:, None]) % 2
        out.append((bits, _words(kept.astype(np.uint8))))
    return out


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """label with those of each a and b made one, and the places of the pairs that joined two."""
    up: dict[int, int] = {}

    def top(x):
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    new = np.arange(len(label))
    for x in up:
        new[x] = top(x)
    return new[label], kept


def near_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of prints with at most `most` unlike bits that join all rows which such pairs join."""
    n, words, plan = len(prints), np.ascontiguousarray(prints).view(np.uint64), cover(len(prints), most)
    block = np.empty((len(plan), n), np.uint64)
    for lo in range(0, n, 16_384):
        flat = np.unpackbits(prints[lo : lo + 16_384], axis=1)
        for k, (bits, _) in enumerate(plan):
            block[k, lo : lo + 16_384] = _words(flat[:, bits])
    label, found = np.arange(n), [np.zeros((2, 0), np.int64)]
    for k, mask in ((k, m) for k, (_, masks) in enumerate(plan) for m in masks):
        key = block[k] & mask
        order = np.argsort(key)
        key, step = key[order], 1
        at = np.flatnonzero(key[1:] == key[:-1])
        # All pairs of each run of equal keys, by their distance in it; runs of one label are done.
        while len(at):
            a, b = order[at], order[at + step]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            near = np.concatenate([np.bitwise_count(words[a[i : i + 65_536]] ^ words[b[i : i + 65_536]]).sum(axis=1, dtype=np.int64) <= most for i in range(0, len(a), 65_536)] or [np.zeros(0, bool)])
            if near.any():
                a, b = a[near], b[near]
                label, kept = _joined(label, a, b)
                found.append(np.stack([a[kept], b[kept]]))
            step += 1
            at = at[at + step < n]
            at = at[key[at] == key[at + step]]
            if len(at) and step & (step - 1) == 0:
                named = label[order]
                turns = np.concatenate([[0], np.cumsum(named[1:] != named[:-1])])
                at = at[turns[np.searchsorted(key, key[at], "right") - 1] > turns[np.searchsorted(key, key[at], "left")]]
    return tuple(np.concatenate(found, axis=1))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's start."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex of SAMPLES bytes) of each whole text; null is empty."""

    def run(batches):
        embedding = Embedding()
        for batch in batches:
            for rows in _groups(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                prints = embedding.fingerprints([t for _, t in rows])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([p.tobytes().hex() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def near_classes(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """sig (the fingerprint's bytes) and component_id of those (doc_id, fingerprint) that aren't alone.

    All fingerprints of likeness `least` or more link; component_id is the smallest doc_id that links
    lead to. Equal fingerprints form a class. Classes are dealt to parts, and each two parts are
    searched by a task of their own, which tells links that join its rows.
    """
    spark, most = prints.sparkSession, most_unlike(least)
    real = (F.col("fingerprint") != "0" * (SAMPLES // 4)) & F.col("doc_id").isNotNull()
    classes = prints.where(real).groupBy(F.unhex("fingerprint").alias("sig")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "print-classes")
    count = nodes.count()
    parts = 1 if count <= FEW else max(PARTS, math.ceil(count / PART_ROWS))
    tiles = [(x, y) for x in range(parts) for y in range(x + 1, parts)] or [(0, 0)]
    of_part = [[k for k, tile in enumerate(tiles) if x in tile] for x in range(parts)]
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts)).cast("int")
    places = spark.createDataFrame([(x, k) for x in range(parts) for k in of_part[x]], "part int, tile int")
    dealt = spark.createDataFrame(list(enumerate(dealt_keys(spark, len(tiles)))), "tile int, k int")
    rows = nodes.select("node", "sig", part.alias("part")).join(F.broadcast(places.join(F.broadcast(dealt), "tile")), "part").select("k", "node", "sig")

    def run(tile: pa.Table) -> pa.Table:
        node = tile["node"].to_numpy()
        a, b = near_links(matrix(tile["sig"]), most)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    links = written(rows.repartition(len(tiles), "k").groupBy("k").applyInArrow(run, "a long, b long"), "print-links")
    labels = written(components(links), "labels")
    placed = written(nodes.select("node", "sig", "id", "n").join(sent_if_small(labels, 32), "node", "left").where("component IS NOT NULL OR n > 1"), "print-placed")
    first = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("first"))
    named = placed.join(first, "component", "left").select("sig", F.coalesce("first", "id").alias("component_id"))
    return written(named, "print-named")


def grouped(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """prints (doc_id, fingerprint and others) with component_id, by near_classes().

    Null fingerprints, and those of empty texts (all 0), link with nothing; rows with a null id
    have a null component. Repeated rows have a row each, an empty table none.
    """
    named = sent_if_small(near_classes(prints, least), 128)
    found = prints.withColumn("sig", F.unhex("fingerprint")).join(named, "sig", "left").drop("sig")
    return found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _groups(rows, size: int = GROUP_CHARS) -> Iterator[list]:
    held, chars = [], 0
    for i, t in rows:
        held.append((i, t or ""))
        chars += len(t or "")
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _compare(rows: list, following: list[str], embedding: Embedding) -> dict:
    """Result columns of rows (doc_id, text) given the text that follows each."""
    texts = [t for _, t in rows]
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    prints = embedding.fingerprints(texts + following[-1:] + changed)
    own, nxt, new = prints[: len(rows)], prints[1 : len(rows) + 1], prints[len(rows) + 1 :]
    return {
        "doc_id": pa.array([i for i, _ in rows], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([p.tobytes().hex() for p in own], pa.string()),
        "edited_fingerprint": pa.array([p.tobytes().hex() for p in new], pa.string()),
        "near_edited": pa.array(likeness(own, new), pa.float64()),
        "near_next": pa.array(likeness(own, nxt), pa.float64()),
    }


def _walk_partition(batches):
    """Finished rows, and for each partition its first and last text, whose neighbours are elsewhere."""
    embedding, names, part = None, ["edge", "part", "text", *[c.split()[0] for c in RESULT.split(", ")]], TaskContext.get().partitionId()
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def edge(name, doc_id, text):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([name, part, text, doc_id, *[None] * 6], kinds, strict=True)], names)

    last = None
    unpack = zstandard.ZstdDecompressor().decompress
    source = ((i, unpack(t).decode("utf-8", "surrogatepass")) for batch in batches for lo in range(0, batch.num_rows, 512) for i, t in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist(), strict=True))
    for rows in _groups(source):
        if embedding is None:
            embedding = Embedding()
            yield edge("first", *rows[0])
        if last is not None:
            rows = [last, *rows]
        last = rows[-1]
        if len(rows) > 1:
            done = _compare(rows[:-1], [t for _, t in rows[1:]], embedding)
            n = len(rows) - 1
            yield pa.RecordBatch.from_arrays([pa.nulls(n, k) for k in kinds[:3]] + list(done.values()), names)
    if last is not None:
        yield edge("last", *last)


def compare_edits(docs: DataFrame) -> DataFrame:
    """RESULT for every row of docs (doc_id, text): its fingerprint, that of its edited text and likenesses.

    The next document is that of the next smaller doc_id, and the largest after the smallest; of
    repeated ids the next by a hash of the text; null ids come last. Null texts are empty: their
    fingerprints are all 0, and their likeness is 1 to empty texts only by that. A table of one row
    follows itself; an empty one gives no rows. Texts move once, packed and in order of their ids; repeated
    rows are told apart by where they were read, so that no range holds them all.
    """
    spark = docs.sparkSession
    def packed(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(t or b"") for t in texts], pa.binary()), *part.columns[2:]], ["doc_id", "text", "h", "at"])

    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("at")]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.mapInArrow(packed, "doc_id long, text binary, h long, at long").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    table = written(rows.mapInArrow(_walk_partition, f"edge string, part long, text string, {RESULT}"), "walks")
    # Two edges a partition: a bound list of numbers, and rows that meet by them.
    parts = sorted(r["part"] for r in table.where("edge = 'first'").select("part").collect())
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    pairs = spark.createDataFrame(list(after.items()), "part long, next long")
    lasts = table.where("edge = 'last'").select("part", "doc_id", "text").join(pairs, "part")
    firsts = table.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def run(batches):
        embedding = Embedding()
        for batch in batches:
            for i, t, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                done = _compare([(i, t or "")], [n or ""], embedding)
                yield pa.RecordBatch.from_arrays(list(done.values()), list(done))

    closed = lasts.join(firsts, "next").select("doc_id", "text", "following").mapInArrow(run, RESULT)
    return table.where("edge IS NULL").drop("edge", "part", "text").unionByName(closed)


def compare_and_group(docs: DataFrame) -> DataFrame:
    """compare_edits() with component_id: the smallest doc_id among near documents, found by covering masks and verified."""
    return grouped(compare_edits(docs))
