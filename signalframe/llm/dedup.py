"""Near-duplicates by b-bit MinHash over word shingles (of 2 words by default), links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .link import linked
from .storage import sent_if_small, written
from .words import Hasher, chunks, mix64, spare, split_words

BANDS = 40
ROWS = 5  # a pair of similarity 0.8 misses all bands with odds of 1e-7
MINIMA = BANDS * ROWS
BITS = 4
PERCENT = 80
#: Estimates below this can't belong to a link but with odds of 1e-9.
LEAST_ESTIMATE = 0.62
SET_BYTES = 6
#: Words in a shingle.
SHINGLE = 2


def shingle_sets(texts: pa.Array, hasher: Hasher, length: int = SHINGLE):
    """Sorted distinct 64-bit hashes of each whole text's shingles of length words.

    A text of fewer words has its words as its one shingle; null, or no word, an empty set.
    """
    for first, last, data, offsets in chunks(texts):
        words = split_words(data, offsets, hasher)
        # grown[n - 1][i] covers the n words from i on.
        grown = [mix64(words.hash + np.uint64(1)), words.hash]
        for n in range(1, length):
            last_grown = grown[-1]
            grown.append(mix64(last_grown[:-1] * np.uint64(0xD6E8FEB86659FD93) + words.hash[n:]))
        grown = [grown[0], *grown[2:]]
        edge = np.searchsorted(words.doc, np.arange(last - first + 1))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            n = min(length, hi - lo)
            yield np.unique(grown[n - 1][lo : hi - n + 1]) if n else words.hash[:0]


def set_key_of(s: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return np.array([s.sum(), np.bitwise_xor.reduce(s * s + s), len(s)], np.uint64).tobytes()


class Permutations:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 2**32, MINIMA, np.uint32)
        self.factor = rng.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """Set by permutation: the least permuted 32-bit hash; sets must not be empty."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((MINIMA, len(sets)), np.uint32)
        y = np.empty_like(x)
        for k in range(MINIMA):
            np.bitwise_xor(x, self.flip[k], out=y)
            np.multiply(y, self.factor[k], out=y)
            out[k] = np.minimum.reduceat(y, starts)
        return out.T


def packed(minima: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, as bit planes of whole bytes."""
    return np.concatenate([np.packbits((minima >> np.uint32(b)) & np.uint32(1), axis=1) for b in range(BITS)], axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: bit counts of unlike minima, corrected for collisions."""
    unlike = a ^ b
    width = unlike.shape[1] // BITS
    any_bit = np.bitwise_or.reduce(unlike.reshape(len(unlike), BITS, width), axis=1)
    same = 1 - np.bitwise_count(any_bit).sum(axis=1, dtype=np.int64) / MINIMA
    return (same - 2.0**-BITS) / (1 - 2.0**-BITS)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """Set by band: a 64-bit key of the band's number and full minima."""
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _signatures(batches, length: int):
    hasher, permutations = Hasher(), Permutations()
    names = ["doc_id", "text_key", "n", "set_key", "sig", "keys"]

    def flush(ids, texts, sets):
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        set_key, sig, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if len(full):
            minima = permutations.minima([sets[i] for i in full])
            bits, bands = packed(minima), band_keys(minima)
            for row, i in enumerate(full):
                set_key[i] = set_key_of(sets[i])
                sig[i], keys[i] = bits[row].tobytes(), bands[row]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(n), pa.array(set_key, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    for batch in batches:
        ids, text_keys, kept, texts, sets, size = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], [], [], 0
        for i, t, s in zip(ids, text_keys, shingle_sets(batch.column(1), hasher, length), strict=True):
            kept.append(i)
            texts.append(t)
            sets.append(s)
            size += len(s)
            if size > 50_000:
                yield flush(kept, texts, sets)
                kept, texts, sets, size = [], [], [], 0
        if kept:
            yield flush(kept, texts, sets)


def text_key() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n, set_key (equal for equal sets), sig and band keys of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"))
    return rows.mapInArrow(lambda batches: _signatures(batches, length), "doc_id long, text_key long, n long, set_key binary, sig binary, keys array<long>")


def _packed_set(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :].tobytes()


def _sets(packed_sets: list[bytes]) -> list[np.ndarray]:
    out = []
    for raw in packed_sets:
        rows = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
        out.append(np.concatenate([rows, np.zeros((len(rows), 8 - SET_BYTES), np.uint8)], axis=1).view(np.uint64).ravel())
    return out


def exact_test(packed_sets: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """test(i, others): which of the others have a similarity of PERCENT or more with set i.

    An index from shingles to the sets that hold them counts all intersections of a set at once.
    """
    sets = _sets(packed_sets)
    size = np.array([len(s) for s in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    edge = np.searchsorted(np.sort(shingle), np.arange(shingle.max(initial=-1) + 2))
    start = np.cumsum(size) - size

    def test(i: int, others: np.ndarray) -> np.ndarray:
        own = shingle[start[i] : start[i] + size[i]]
        n = edge[own + 1] - edge[own]
        at = np.repeat(edge[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holder[at], minlength=len(sets))[others]
        return 100 * common >= PERCENT * (size[i] + size[others] - common)

    return test


def _payloads(docs: DataFrame, classes: DataFrame, length: int) -> Callable[[DataFrame], DataFrame]:
    """For linked(): the packed sets of nodes, from the text of each class's smallest id."""

    def sets_of(batches):
        hasher = Hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                named = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2), hasher, length), strict=True)
                # An id may come with other texts as well.
                rows = [(node, _packed_set(s)) for node, key, s in named if set_key_of(s) == key]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "payload"])

    def of(nodes: DataFrame) -> DataFrame:
        wanted = written(classes.select("node", "set_key", "id").join(nodes, "node").select("node", "set_key", F.col("id").alias("doc_id")), "wanted")
        rows = docs.join(sent_if_small(wanted, 96), "doc_id").select("node", "set_key", "text")
        return rows.mapInArrow(sets_of, "node long, payload binary").groupBy("node").agg(F.any_value("payload").alias("payload"))

    return of


def near_duplicates(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    docs: doc_id, text. Links join texts whose sets of shingles of length words have a similarity of 0.8 or
    more. Equal sets form a class, which its smallest id stands for; classes meet by band keys and
    are confirmed on their full sets. Null texts and texts without a word have an empty set, link
    with nothing and are kept. Rows with a null id have a null component, link with nothing and
    are kept. Rows that repeat an id and a text share a result; if an id comes with different
    texts, each of its rows has the component of its own text. An empty table gives no rows.
    """
    return labelled(docs, length).drop("text_key", "component")


def one_of_each(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, and of its texts one.

    docs: doc_id, text and others. Rows are dropped by id and text. Texts without a word and rows
    with a null id stay, but of rows that repeat an id and a text one stays.
    """
    keys = ["doc_id", "text_key"]
    found = written(labelled(docs.select("doc_id", "text"), length).where("doc_id IS NOT NULL"), "labelled")
    several = found.where("kept AND n_shingles > 0").groupBy("component").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first < last")
    other = found.join(several.select("component", "first"), "component").where("kept AND n_shingles > 0 AND text_key > first")
    gone = written(found.where("NOT kept").select(keys).unionByName(other.select(keys)).distinct(), "gone")
    left = found.where("kept").groupBy(keys).count().where("count > 1").join(gone, keys, "left_anti")
    repeated = written(left.select(keys), "repeated")
    # One join tells each row's fate, so that texts move once at most.
    fate = written(gone.withColumn("again", F.lit(False)).unionByName(repeated.withColumn("again", F.lit(True))), "fate")
    own = spare("__text_key", docs.columns)
    told = fate.select(F.col("doc_id").alias(spare("__id", docs.columns)), F.col("text_key").alias(own), F.col("again").alias(spare("__again", docs.columns)))
    id_, again = told.columns[0], told.columns[2]
    rows = docs.join(sent_if_small(told, 48), (docs["doc_id"].cast("long") == told[id_]) & (F.xxhash64(docs["text"]) == told[own]), "left")
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    alone = rows.where(F.col(again).isNull()).select([F.col(f"`{c}`") for c in docs.columns])
    first = rows.where(F.col(again)).groupBy(id_, own).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select(names)
    return alone.unionByName(first)


def labelled(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """near_duplicates() with the text_key of each row and a key of its component, which others of the same id don't share."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(signatures(docs, length), "signatures")
    full = table.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
    # Numbered once, as the table is written, so that no two classes share a node.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = linked(classes.select("node", "keys", "sig"), estimate, LEAST_ESTIMATE, _payloads(docs, classes, length), exact_test)
    placed = classes.select("set_key", "node", "id").join(labels, "node", "left").select("set_key", "id", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    least = written(placed.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    named = written(placed.join(least, "component").select("set_key", "component_id", "component"), "named")
    rows = table.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    alone = F.concat(F.lit("#"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).cast("binary")
    rows = rows.withColumn("set_key", F.coalesce("set_key", alone))
    joined = rows.join(named, "set_key", "left").select("doc_id", "text_key", "component", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
