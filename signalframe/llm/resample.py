"""Importance resampling towards a target distribution over hashed word n-grams.

Distinct words get integer ids in a dictionary table. n-grams are tuples of ids; the bytes of each
distinct tuple are put together and hashed once, and its bucket joins back to the counts of texts.
Texts travel as packs of some megabytes that name their distinct words and tuples, so that what is
dealt by word or tuple has a row a pack, however often a word is used.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import LOWER, chunks, coded_words

#: Words are runs of digits, lower-case letters and bytes beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LENGTH = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of a pack's texts; larger ones have fewer distinct words a byte.
PACK_BYTES = 8 << 20
PACK = "pack long, target boolean, doc_ids array<long>, n_words array<long>, n_features array<long>, sizes array<int>, steps binary, times binary, words array<string>, grams array<int>, counts array<long>"


def local_grams(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tuples of up to n consecutive words of one document (rows of n word numbers, -1 beyond a tuple's end), and the tuple's number and document of every occurrence."""
    known, which, owner, total = [], [], [], 0
    key, size = np.zeros(len(codes), np.int64), int(codes.max()) + 1 if len(codes) else 1
    place = np.arange(len(codes))
    for k in range(n):
        # Tuples of k + 1 words: the tuple of k that begins there and the word after it.
        place = place[(place + k < len(codes))]
        place = place[doc[place] == doc[place + k]]
        _, first, number = np.unique(key[place] * size + codes[place + k], return_index=True, return_inverse=True)
        rows = np.full((len(first), n), -1, np.int64)
        for j in range(k + 1):
            rows[:, j] = codes[place[first] + j]
        known.append(rows)
        which.append(number + total)
        owner.append(doc[place])
        total += len(first)
        key = np.zeros(len(codes), np.int64)
        key[place] = number
    return np.concatenate(known), np.concatenate(which), np.concatenate(owner)


def _packed(batches, n: int, target: bool):
    made = 0
    task = TaskContext.get().partitionId()
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(1), PACK_BYTES):
            words, codes, at = coded_words(LOWER[data], offsets, WORD)
            doc = np.repeat(np.arange(last - first), np.diff(at))
            grams, which, owner = local_grams(codes.astype(np.int64), doc, n)
            features = np.bincount(owner, minlength=last - first)
            # Each document's tuples with their numbers of times.
            pairs, times = np.unique(owner * max(1, len(grams)) + which, return_counts=True)
            holder, local = np.divmod(pairs, max(1, len(grams)))
            one = lambda values, kind: pa.array([values], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 33 | made) << 1 | int(target)], pa.int64()),
                    pa.array([target]),
                    one(batch.column(0).slice(first, last - first).to_pylist(), pa.list_(pa.int64())),
                    one(np.diff(at), pa.list_(pa.int64())),
                    one(features, pa.list_(pa.int64())),
                    one(np.bincount(holder, minlength=last - first), pa.list_(pa.int32())),
                    # Steps from one to the next are small numbers.
                    pa.array([np.diff(local, prepend=0).astype("<i4").tobytes()]),
                    pa.array([times.astype("<u4").tobytes()]),
                    one(words.to_pylist(), pa.list_(pa.string())),
                    one(grams.ravel(), pa.list_(pa.int32())),
                    one(np.bincount(which, minlength=len(grams)), pa.list_(pa.int64())),
                ],
                names=[f.split()[0] for f in PACK.split(", ")],
            )
            made += 1


def packs(docs: DataFrame, n: int = LENGTH, target: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs of about 1 MB of whole texts, a longer text alone: documents, distinct words, distinct tuples of word numbers with counts, and each document's tuples."""
    rows = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(lambda batches: _packed(batches, n, target), PACK)


def _numbered(batches, buckets: int):
    """(word, pack, at, c) sorted by word, with the word's id and its bucket, which is hashed once."""
    task, made, last = TaskContext.get().partitionId(), 0, None
    bucket = 0
    for batch in batches:
        words = batch.column(0).dictionary_encode()
        ids, hashes = [], []
        for word in words.dictionary.to_pylist():
            if word != last:
                last, made = word, made + 1
                bucket = zlib.crc32(word.encode()) % buckets
            ids.append(task << 33 | made)
            hashes.append(bucket)
        at = words.indices.to_numpy()
        columns = [batch.column("pack"), batch.column("at"), batch.column("c"), batch.column(0), pa.array(np.array(ids, np.int64)[at], pa.int64()), pa.array(np.array(hashes, np.int32)[at], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["pack", "at", "c", "word", "id", "bucket"])


def numbered(table: DataFrame, buckets: int) -> DataFrame:
    """pack, at, c, word, id and bucket of each pack's distinct words (c: times in the pack), equal words with equal ids.

    A word has a row a pack at most, so no word fills a task.
    """
    words = table.select("pack", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(F.col("w.words").alias("word"), "pack", "at", F.col("w.counts").alias("c"))
    # Tuples of one word come first among the tuples, in the order of the words.
    rows = words.where("word IS NOT NULL").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(lambda batches: _numbered(batches, buckets), "pack long, at int, c long, word string, id long, bucket int")


def by_pack(rows: DataFrame, value: str) -> DataFrame:
    """rows (pack, at, value) as one row a pack, with the values in order of at."""
    placed = F.array_sort(F.collect_list(F.struct("at", value)))
    return rows.groupBy("pack").agg(F.transform(placed, lambda s: s[value]).alias(f"{value}s"))


def hashed_grams(table: DataFrame, words: DataFrame, n: int, buckets: int) -> DataFrame:
    """pack, at, c and bucket of each pack's distinct tuples of up to n words.

    words: those of numbered(). Each distinct tuple of ids gets its words from the dictionary, and
    its bytes are hashed once.
    """
    dictionary = words.groupBy("id").agg(F.first("word").alias("word"))
    names = [f"w{j}" for j in range(n)]
    number = lambda k, j: F.get("grams", k * n + j)
    whole = F.transform(F.sequence(F.lit(0), F.size("counts") - 1), lambda k: F.struct(*[F.coalesce(F.get("ids", number(k, j)), F.lit(-1).cast("long")).alias(w) for j, w in enumerate(names)], F.get("counts", k).alias("c")))
    grams = table.where(F.size("counts") > 0).select("pack", "grams", "counts").join(by_pack(words.select("pack", "at", "id"), "id"), "pack")
    grams = written(grams.select("pack", F.posexplode(whole).alias("at", "g")).select("pack", "at", "g.*"), "resample-grams")
    distinct = grams.select(*names).distinct()
    named = reduce(lambda df, w: df.join(dictionary.select(F.col("id").alias(w), F.col("word").alias(f"{w}_word")), w, "left"), names, distinct)
    hashed = named.select(*names, (F.crc32(F.concat_ws(" ", *[f"{w}_word" for w in names]).cast("binary")) % buckets).cast("int").alias("bucket"))
    return grams.join(hashed, names).select("pack", "at", "c", "bucket")


def log_gains(counts: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(bucket, gain) of (bucket, times in the raw texts, times in the target): thousandths of the log ratio of the two smoothed shares, rounded down."""
    raw, aim = float(sum(s for _, s, _ in counts)), float(sum(t for _, _, t in counts))
    return [(b, math.floor(1000 * math.log((t + 1.0) * (raw + buckets) / ((s + 1.0) * (aim + buckets))))) for b, s, t in counts]


def _weighed(batches, gains: np.ndarray):
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            buckets = np.array(row["buckets"] or [0])
            local, times = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int64), np.frombuffer(row["times"], "<u4")
            sums = np.concatenate([[0], np.cumsum(gains[buckets[local]] * times.astype(np.int64))])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(row["n_features"], pa.int64()), pa.array(np.diff(sums[ends]), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, n: int = LENGTH, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row: the sum of its features' gains (0 without any).

    Features are all runs of 1 to n consecutive words, hashed to `buckets` by crc32; a bucket's gain
    compares its share of all features of target with that of docs. The table of gains, a number a
    bucket, is all that passes the driver.
    """
    aims = target.select(F.lit(None).cast("long").alias(key), F.col(f"`{target_text}`").alias(text))
    table = written(packs(docs, n, False, key, text).unionByName(packs(aims, n, True, key, text)), "resample-packs", "zstd")
    words = numbered(table, buckets)
    # A tuple of one word is an id of the dictionary, and has its bucket already.
    hashed = written(words.select("pack", "at", "c", "bucket") if n == 1 else hashed_grams(table, written(words, "resample-words", "zstd"), n, buckets), "resample-hashed", "zstd")
    aimed = F.col("pack") % 2 == 1
    counts = hashed.groupBy("bucket").agg(F.sum(F.when(~aimed, F.col("c")).otherwise(0)), F.sum(F.when(aimed, F.col("c")).otherwise(0))).collect()
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in log_gains([tuple(r) for r in counts], buckets):
        gains[bucket] = gain
    back = by_pack(hashed.where(~aimed).select("pack", "at", "bucket"), "bucket")
    own = table.where("NOT target").select("pack", "doc_ids", "n_words", "n_features", "sizes", "steps", "times").join(back, "pack", "left").drop("pack")
    return own.mapInArrow(lambda batches: _weighed(batches, gains), "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel draw, by a hash of seed and id, rounded down; a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3... of the highest percent of rows of least_words words or more, else null.

    Ties go to the smaller id (null last), equal rows to any. The order is dealt to tasks by ranges;
    only the sizes of these reach the driver.
    """
    spark = scored.sparkSession
    table = written(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = table.where(F.col("n_words") >= least_words).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fit = written(fit.withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, fit.groupBy(part.alias("part")).count().collect()))
    before = spark.createDataFrame([(p, sum(c for _, c in sizes[:k])) for k, (p, _) in enumerate(sizes)], "part long, before long")
    total = sum(c for _, c in sizes)
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = fit.withColumn("part", part).join(F.broadcast(before), "part", "left").withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("part", "before", "place")
    rest = table.where(F.coalesce(F.col("n_words") < least_words, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")


def resample(docs: DataFrame, target: DataFrame, n: int = LENGTH, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text), by the texts of target.

    score is weight plus the id's Gumbel noise, so that the highest scores are a draw without
    replacement by the importance weights. Null and empty texts have no words, weight 0 and no
    rank; null texts of target count as empty. Rows that repeat an id repeat its noise. Extra
    columns are left out, and an empty table has an empty result.
    """
    scored = weights(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(scored, least_words, percent)
