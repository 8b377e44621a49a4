"""Cut planning: silences and fillers to cuts, merging, edit lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import drop_overlapping
from .islands import complement, merge_intervals

# Fillers that are always cut, and hedges cut on request.
FILLERS = ["um", "uh", "erm", "hmm", "uhm", "mm"]
HEDGES = ["like"]
PHRASE = ("you", "know")


def silence_cuts(silences: DataFrame, music: DataFrame, protected: DataFrame, key: str, min_gap: float, target_gap: float, floor: float = 0.4) -> DataFrame:
    """key, start, end, kind, label, accepted: the middle of silences (key, start, end) that are long enough.

    Not over music (key, m_start, m_end), nor with a protected time (key, t) inside or at an end.
    """
    keep = max(target_gap, floor)
    d = F.col("end") - F.col("start")
    rows = silences.where((d >= min_gap) & (d > keep))
    rows = drop_overlapping(rows, music, key, "start", "end", "m_start", "m_end", [key, "start", "end"])
    rows = drop_overlapping(rows, protected.withColumn("t2", F.col("t")), key, "start", "end", "t", "t2", [key, "start", "end"], closed=True)
    label = F.format_string(f"silence %.1fs→{keep:.1f}s", d)
    return rows.select(key, (F.col("start") + keep / 2).alias("start"), (F.col("end") - keep / 2).alias("end"), F.lit("silence").alias("kind"), label.alias("label"), F.lit(True).alias("accepted"))


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"^[^\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}']+$", ""))


def filler_cuts(words: DataFrame, music: DataFrame, key: str, language: str = "en", aggressive: bool = False, confidence: float = 0.85, pad: float = 0.04) -> DataFrame:
    """Cuts of words (key, word, text, start, end, confidence) that are fillers, in English only.

    A phrase of two words takes both. Phrases can't overlap, since their words differ.
    """
    if not (language == "" or language == "en" or language.startswith("en-")):
        words = words.limit(0)
    w = Window.partitionBy(key).orderBy("word")
    rows = words.withColumn("t", normalised(F.col("text"))).withColumns({"nt": F.lead("t").over(w), "ne": F.lead("end").over(w), "nc": F.lead("confidence").over(w)})
    both = (F.col("t") == PHRASE[0]) & (F.col("nt") == PHRASE[1]) & F.lit(aggressive)
    one = F.col("t").isin(FILLERS + (HEDGES if aggressive else []))
    rows = rows.withColumn("two", F.coalesce(both, F.lit(False))).where(F.col("two") | one)
    sure = F.when(F.col("two"), F.least("confidence", "nc")).otherwise(F.col("confidence")) >= confidence
    cuts = rows.where(sure).select(key, F.greatest(F.col("start") - pad, F.lit(0.0)).alias("start"), (F.when(F.col("two"), F.col("ne")).otherwise(F.col("end")) + pad).alias("end"), F.lit("filler").alias("kind"), F.when(F.col("two"), " ".join(PHRASE)).otherwise(F.col("t")).alias("label"), F.lit(True).alias("accepted"))
    return drop_overlapping(cuts, music, key, "start", "end", "m_start", "m_end", [key, "start", "end"])


def merge_cuts(cuts: DataFrame, key: str, gap: float = 0.10) -> DataFrame:
    """Cuts within gap of each other as one: accepted if all are, silence if any is.

    Labels are joined in time order; one that equals all that was joined before it isn't repeated.
    """
    labels = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "label"))), lambda x: x["label"])
    joined = F.aggregate(labels, F.lit(""), lambda a, x: F.when(a == "", x).when(a == x, a).otherwise(F.concat(a, F.lit(" + "), x)))
    aggs = [F.bool_and("accepted").alias("accepted"), F.when(F.bool_or(F.col("kind") == "silence"), "silence").otherwise("filler").alias("kind"), joined.alias("label")]
    return merge_intervals(cuts, key, slack=gap, aggs=aggs)


def edit_list(cuts: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """key, start, end, kept: what accepted cuts leave of 0 to duration (durations: key, duration)."""
    d = F.greatest("duration", F.lit(0.0))
    inside = cuts.where("accepted").join(durations, key).select(key, F.least(F.greatest("start", F.lit(0.0)), d).alias("start"), F.least(F.greatest("end", F.lit(0.0)), d).alias("end")).where("end > start")
    return complement(merge_intervals(inside, key), durations.select(key, d.alias("duration")), key)


def removed_seconds(cuts: DataFrame, key: str) -> DataFrame:
    return cuts.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("end") - F.col("start"))), F.lit(0.0)).alias("removed"))


SAMPLES_A_BUCKET = 1 << 16


def render(samples: DataFrame, edits: DataFrame, key: str, rate: float, crossfade: float = 0.060) -> DataFrame:
    """key, n, x of the kept ranges one after another, with equal-power crossfades where they join.

    samples: key, n, x. A join is as long as crossfade, or as the shorter of its two ranges; what a
    later join fades out is all that lies under it, earlier joins included. Samples meet ranges by
    buckets of places, so a long signal with many ranges is dealt over tasks.
    """
    place = lambda c: F.floor(F.greatest(F.col(c), F.lit(0.0)) * rate + 0.5).cast("long")
    ends = samples.groupBy(key).agg((F.max("n") + 1).alias("__frames"))
    kept = edits.where("kept").join(ends, key).select(key, F.least(place("start"), F.col("__frames")).alias("__lo"), F.least(place("end"), F.col("__frames")).alias("__hi"), "start").where("__hi > __lo")
    order = Window.partitionBy(key).orderBy("start", "__lo")
    size = F.col("__hi") - F.col("__lo")
    fade = F.when(F.lag(size).over(order).isNull(), 0).otherwise(F.least(F.lit(int(crossfade * rate + 0.5)), F.lag(size).over(order), size))
    kept = kept.withColumns({"__r": F.row_number().over(order), "__fade": fade})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("__at", F.coalesce(F.sum(size).over(before), F.lit(0)) - F.sum("__fade").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bucket = lambda c: F.floor(c / SAMPLES_A_BUCKET)
    ranges = kept.withColumn("__b", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi") - 1))))
    parts = samples.select(key, "n", "x", bucket(F.col("n")).alias("__b")).join(ranges, [key, "__b"]).where("n >= __lo AND n < __hi")
    i = F.col("n") - F.col("__lo")
    rising = F.when(i < F.col("__fade"), F.sin(F.lit(math.pi / 2) * (i + 0.5) / F.col("__fade"))).otherwise(1.0)
    parts = parts.select(key, (F.col("__at") + i).alias("__p"), "__r", (F.col("x") * rising).alias("x")).withColumn("__b", bucket(F.col("__p")))
    joins = kept.where("__fade > 0").select(F.col(key).alias("__key"), F.col("__r").alias("__join"), F.col("__at").alias("__from"), (F.col("__at") + F.col("__fade")).alias("__to"), F.col("__fade").alias("__width"))
    joins = joins.withColumn("__c", F.explode(F.sequence(bucket(F.col("__from")), bucket(F.col("__to") - 1))))
    under = (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__c")) & (F.col("__join") > F.col("__r")) & (F.col("__p") >= F.col("__from")) & (F.col("__p") < F.col("__to"))
    falling = F.log(F.cos(F.lit(math.pi / 2) * (F.col("__p") - F.col("__from") + 0.5) / F.col("__width")))
    faded = parts.join(joins, under, "left").groupBy(key, "__p", "__r").agg(F.first("x").alias("x"), F.exp(F.coalesce(F.sum(falling), F.lit(0.0))).alias("__w"))
    return faded.groupBy(key, F.col("__p").alias("n")).agg(F.sum(F.col("x") * F.col("__w")).alias("x"))


def valid_clips(clips: DataFrame, durations: DataFrame, key: str, rate: float) -> DataFrame:
    """clips (key, start, end) with an end behind their start and a sample inside 0 to duration."""
    d = durations.select(key, "duration")
    lo, hi = (F.floor(F.least(F.greatest(c, F.lit(0.0)), F.col("duration")) * rate + 0.5) for c in ("start", "end"))
    return clips.join(d, key).where((F.col("end") > F.col("start")) & (hi > lo)).drop("duration")
