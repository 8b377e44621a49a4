"""Interval joins: overlap, nearest, containment, votes and anti-joins.

Every join is an equi-join on the owner and a time bucket, so a long owner is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 60.0
# Fixed value: how far, in seconds, a word may lie from the turn that it is given to.
SPEAKER_SNAP = 2.0


def bucketed(df: DataFrame, start: Column, end: Column, width: float = BUCKET) -> DataFrame:
    """A row for each time bucket that [start, end] touches, numbered in __t."""
    return df.withColumn("__t", F.explode(F.sequence(F.floor(F.least(start, end) / width), F.floor(F.greatest(start, end) / width))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, closed: bool = False, width: float = BUCKET) -> DataFrame:
    """Pairs of a key that overlap (strictly, or with closed also where they touch), once each."""
    a = bucketed(left, F.col(ls), F.col(le), width)
    b = bucketed(right.withColumnRenamed(key, "__k"), F.col(rs), F.col(re), width).withColumnRenamed("__t", "__u")
    hit = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if closed else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    on = (F.col(key) == F.col("__k")) & (F.col("__t") == F.col("__u")) & hit
    # The bucket where the overlap begins tells each pair once.
    once = F.col("__t") == F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return a.join(b, on & once, "inner").drop("__k", "__t", "__u")


def drop_overlapping(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, unique: list[str], closed: bool = False) -> DataFrame:
    """Rows of left, told apart by the columns unique, that overlap no row of right."""
    met = overlap_join(left, right.select(key, rs, re), key, ls, le, rs, re, closed).select(*unique).distinct()
    return left.join(met, unique, "left_anti")


def word_speakers(words: DataFrame, turns: DataFrame, key: str, snap: float = SPEAKER_SNAP) -> DataFrame:
    """key, word, start, end, speaker: of the turn that overlaps most, else the nearest within snap.

    words: key, word (its number), start, end. turns: key, ord, t_start, t_end, speaker. The first
    turn wins ties. A word that meets no turn has a null speaker.
    """
    near = words.withColumns({"__s": F.col("start") - snap, "__e": F.col("end") + snap})
    pairs = overlap_join(near, turns, key, "__s", "__e", "t_start", "t_end", closed=True)
    overlap = F.least("end", "t_end") - F.greatest("start", "t_start")
    gap = F.greatest(F.col("t_start") - F.col("end"), F.col("start") - F.col("t_end"), F.lit(0.0))
    best = pairs.select(key, "word", "speaker", F.greatest(overlap, F.lit(0.0)).alias("o"), gap.alias("g"), "ord").groupBy(key, "word").agg(
        F.min_by("speaker", F.struct((-F.col("o")).alias("o"), F.when(F.col("o") > 0, 0.0).otherwise(F.col("g")).alias("g"), "ord")).alias("speaker"))
    return words.select(key, "word", "start", "end").join(best, [key, "word"], "left")


def dominant_speakers(segments: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, seg, speaker with the most word time in each segment; the lower id wins ties.

    segments: key, seg, s_start, s_end. words: key, start, end, speaker. Words that touch vote with
    at least 1 ms.
    """
    pairs = overlap_join(segments, words.where("speaker IS NOT NULL"), key, "s_start", "s_end", "start", "end", closed=True)
    inside = F.greatest(F.least("end", "s_end") - F.greatest("start", "s_start"), F.lit(1e-3))
    votes = pairs.groupBy(key, "seg", "speaker").agg(F.sum(inside).alias("w"))
    best = votes.groupBy(key, "seg").agg(F.min_by("speaker", F.struct((-F.round("w", 9)).alias("w"), "speaker")).alias("speaker"))
    return segments.select(key, "seg").join(best, [key, "seg"], "left")


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str) -> DataFrame:
    """points with the nearest mark of their key (the earlier on ties), or null without marks.

    As-of in both directions over one ordering, so no point meets all marks.
    """
    from pyspark.sql import Window

    both = points.select(key, F.col(at).alias("__t"), F.struct(*points.columns).alias("__p"), F.lit(None).cast("double").alias("__m")).unionByName(
        marks.select(key, F.col(mark).alias("__t"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("__p"), F.col(mark).alias("__m")))
    back = Window.partitionBy(key).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("__t").rangeBetween(0, Window.unboundedFollowing)
    rows = both.withColumns({"lo": F.max("__m").over(back), "hi": F.min("__m").over(ahead)}).where("__p IS NOT NULL")
    pick = F.when(F.col("hi").isNull() | (F.col("__t") - F.col("lo") <= F.col("hi") - F.col("__t")), F.col("lo")).otherwise(F.col("hi"))
    return rows.select("__p.*", pick.alias("nearest"))


def hop_owners(hops: DataFrame, turns: DataFrame, key: str, hop_seconds: float) -> DataFrame:
    """key, hop, speaker whose turn [t_start, t_end) holds the hop's middle; the last turn wins."""
    mid = hops.withColumn("__m", (F.col("hop") + 0.5) * hop_seconds)
    pairs = overlap_join(mid, turns, key, "__m", "__m", "t_start", "t_end", closed=True).where("__m < t_end")
    best = pairs.groupBy(key, "hop").agg(F.max_by("speaker", "ord").alias("speaker"))
    return hops.select(key, "hop").join(best, [key, "hop"], "left")


def talk_time(turns: DataFrame, key: str) -> DataFrame:
    """key, speaker, seconds; overlapping turns count each."""
    return turns.groupBy(key, "speaker").agg(F.sum(F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))).alias("seconds"))
