"""Exact top-k search by tiled integer matrix products and tree merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Quantised components and scores lie below this, or the search fails.
LIMIT = 2**63
TILE_ROWS = 2048
#: Queries that one pass broadcasts; further ones take further passes.
BLOCK_QUERIES = 32_768
#: Groups of tasks whose lists the first round merges.
FAN_IN = 16


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component as array<long>; null if the vector or a component is null or non-finite.

    A component that doesn't fit 63 bits is an error.
    """
    x = vector.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    wide = F.raise_error(F.lit("a component of 1024 times a vector doesn't fit 63 bits")).cast("long")
    return F.when(whole & (F.size(x) > 0), F.transform(x, lambda v: F.when(F.abs(v * SCALE) < float(LIMIT), F.floor(v * SCALE)).otherwise(wide)))


def exact_scores(queries: np.ndarray, tile: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products as integers, but of own pairs; an error if one doesn't fit 63 bits."""
    scores = queries.astype(float) @ tile.T.astype(float)
    bound = lambda m: np.abs(m).max(axis=1, initial=0).astype(float)
    a, b = bound(queries) * max(1, tile.shape[1]), bound(tile)
    if a.max(initial=0) * b.max(initial=0) < 2**53:
        return scores.astype(np.int64)
    # Doubles hold the others exactly; the margin covers the rounding of bounds.
    wide = (np.outer(a, b) >= 2**52) & ~own
    scores = np.where(wide | own, 0, scores).astype(np.int64)
    rows, columns = np.nonzero(wide)
    for lo in range(0, len(rows), 2**16):
        i, j = rows[lo : lo + 2**16], columns[lo : lo + 2**16]
        scores[i, j] = np.einsum("ij,ij->i", queries[i], tile[j])
        for p in np.flatnonzero(a[i] * b[j] >= 2**62):
            whole = sum(x * y for x, y in zip(queries[i[p]].tolist(), tile[j[p]].tolist(), strict=True))
            if abs(whole) >= LIMIT:
                raise OverflowError("an inner product doesn't fit 63 bits")
            scores[i[p], j[p]] = whole
    return scores


def tile_top(queries: np.ndarray, query_ids: np.ndarray, tile: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, vec_id, score) of each query's k best in a tile, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    tile, ids = tile[order], ids[order]
    own = query_ids[:, None] == ids[None, :]
    scores = exact_scores(queries, tile, own)
    low = np.iinfo(np.int64).min
    scores[own] = low
    k = min(k, len(ids))
    # The score at the k-th place; of those equal to it the smallest ids stay.
    edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
    above = scores > edge
    level = scores == edge
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]
    row, at = np.nonzero((above | level) & (scores != low))
    return row, ids[at], scores[row, at]


def best_of(row: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row's entries, ties to smaller ids."""
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], vec[keep], score[keep]


def _tiles(batches, numbers, query_ids, queries, k: int):
    """One running top list a query through a task: what leaves it is at most k rows a query."""
    none = np.zeros(0, np.int64)
    held = (none, none, none)
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(lo, TILE_ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            tile = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            step = max(1, 2**22 // max(1, len(ids)))
            found = [held]
            for first in range(0, len(query_ids), step):
                row, vec, score = tile_top(queries[first : first + step], query_ids[first : first + step], tile, ids, k)
                found.append((row + first, vec, score))
            held = best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
    row, vec, score = held
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (numbers[row], query_ids[row], vec, score)], ["query", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest inner products of each query.

    vectors: vec_id, embedding and others. Components become floor(1024 * x); if one, or a score,
    doesn't fit 63 bits, the search fails, as the SQL does. Rows with a null id, and vectors that
    are null, empty or hold null or non-finite components, take no part; vectors of different
    lengths aren't compared. Every row is a candidate, repeated ones each, but none for a query of
    its own id. Query rows that repeat id and vector are one query; those of one id with different
    vectors have a list each. Ties go to the smaller vec_id. Fewer candidates than k give fewer
    rows; no rows give none.

    The queries go out in blocks of at most block_queries, one pass over all rows a block. A task
    keeps one list of k rows a query, and two rounds of merging, the first within groups of
    tasks, leave k rows a query.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    best, after, numbered = None, None, 0
    ordered = rows.where("q").select("vec_id", "v").distinct()
    while True:
        left = ordered if after is None else ordered.where(F.struct(F.col("vec_id"), F.col("v")) > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("array<bigint>")))
        block = left.orderBy("vec_id", "v").limit(block_queries).toPandas()
        for size, part in block.groupby(block["v"].map(len)):
            numbers, ids, matrix = numbered + part.index.to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.int64)
            shared = spark.sparkContext.broadcast((numbers, ids, matrix))
            same = rows.where(F.size("v") == int(size)).select("vec_id", "v")
            found = same.mapInArrow(lambda batches, shared=shared: _tiles(batches, *shared.value, k), "query long, query_id long, vec_id long, score long")
            best = found if best is None else best.unionByName(found)
        numbered += len(block)
        if len(block) < block_queries:
            break
        after = (int(block["vec_id"].iloc[-1]), [int(x) for x in block["v"].iloc[-1]])
    if best is None:
        best = spark.createDataFrame([], "query long, query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    near = best.withColumn("part", F.spark_partition_id() % FAN_IN)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
