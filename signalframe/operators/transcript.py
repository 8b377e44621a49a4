"""Transcripts: segments from words, captions and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ass_time, caption_text, srt_time
from .folds import caption_lines

SEGMENT_GAP = 0.8


def derive_segments(words: DataFrame, key: str, gap: float = SEGMENT_GAP) -> DataFrame:
    """key, seg, start, end, text: a segment ends after . ! or ?, before a gap, or with the words."""
    w = Window.partitionBy(key).orderBy("word")
    ends = F.rtrim("text").rlike(r"[.!?]$") | (F.lead("start").over(w) - F.col("end") > gap)
    rows = words.withColumn("__e", F.coalesce(ends, F.lit(False)).cast("int"))
    rows = rows.withColumn("seg", F.coalesce(F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(key, "seg").agg(F.min_by("start", "word").alias("start"), F.max_by("end", "word").alias("end"), texts.alias("text"))


def caption_cues(words: DataFrame, key: str, hold: float = 0.15, least: float = 0.02, duration: float = 1e9) -> DataFrame:
    """key, word, line, start, end of the cue that lights each word until the next one starts."""
    lines = caption_lines(words.withColumn("text", caption_text(F.col("text"))), key)
    w = Window.partitionBy(key).orderBy("start", "word")
    rows = lines.withColumns({"next": F.lead("start").over(w), "nl": F.lead("line").over(w)})
    last = F.col("nl").isNull() | (F.col("nl") != F.col("line"))
    held = F.greatest(F.least(F.col("end") + hold, F.coalesce("next", F.lit(duration))), F.col("end"))
    until = F.greatest(F.when(last, held).otherwise(F.col("next")), F.col("start") + least)
    return rows.select(key, "word", "line", "start", until.alias("end"))


def srt(segments: DataFrame, key: str) -> DataFrame:
    """key, body: numbered cues of segments (key, seg, start, end, text)."""
    rows = segments.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("seg")))
    cue = F.concat(F.col("i"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.trim("text"), F.lit("\n"))
    return _joined(rows.withColumn("cue", cue), key, "\n")


def vtt(segments: DataFrame, key: str) -> DataFrame:
    cue = F.concat(srt_time(F.col("start"), "."), F.lit(" --> "), srt_time(F.col("end"), "."), F.lit("\n"), F.trim("text"), F.lit("\n"))
    body = _joined(segments.withColumn("i", F.col("seg")).withColumn("cue", cue), key, "\n")
    return body.withColumn("body", F.concat(F.lit("WEBVTT\n\n"), F.col("body")))


def plain(segments: DataFrame, key: str) -> DataFrame:
    return _joined(segments.withColumn("i", F.col("seg")).withColumn("cue", F.trim("text")), key, "\n")


def json_lines(segments: DataFrame, key: str) -> DataFrame:
    return _joined(segments.withColumn("i", F.col("seg")).withColumn("cue", F.to_json(F.struct("start", "end", "text"))), key, ",").withColumn("body", F.concat(F.lit("["), F.col("body"), F.lit("]")))


def ass_dialogue(cues: DataFrame, key: str) -> DataFrame:
    """key, body: a Dialogue line a cue (key, word, start, end, text)."""
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Caption,,0,0,0,,"), caption_text(F.col("text")))
    return _joined(cues.withColumn("i", F.col("word")).withColumn("cue", line), key, "\n")


def _joined(rows: DataFrame, key: str, mark: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "cue"))), lambda x: x["cue"]), mark)
    return rows.groupBy(key).agg(body.alias("body"))


def stride_sample(segments: DataFrame, key: str, order: str, most: int = 80) -> DataFrame:
    """Every ceil(n / most)-th segment of a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = segments.withColumns({"__n": n, "__i": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1})
    return rows.where(F.col("__i") % F.ceil(F.col("__n") / most) == 0).drop("__n", "__i")


def drop_adjacent_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    last = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__l", last).where(F.col("__l").isNull() | (F.col("__l") != F.col(value))).drop("__l")


def dense_ids(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """df with id: labels of a key numbered from 0 by first appearance."""
    first = df.groupBy(key, label).agg(F.min(F.struct(*order)).alias("__f"))
    first = first.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("__f")) - 1).drop("__f")
    return df.join(first, [key, label])
