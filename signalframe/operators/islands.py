"""Runs, dilation, sliding frames and interval merging over ordered rows.

A signal can be longer than a task should hold: ordered frames work on blocks of rows, each with
copies of the rows beside it that its frames need, and runs found in blocks are joined after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def framed(df: DataFrame, key: str, order: str, before: int, after: int, columns: Callable[[Callable], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """df with columns computed over ordered frames that reach at most before and after rows.

    columns gets a window maker (lo, hi) -> WindowSpec and returns the new columns. order numbers
    the rows of a key 0, 1, ... without gaps.
    """
    n = F.col(order)
    own = F.floor(n / block)
    # Each row goes to its own block, and beside it to the blocks whose frames reach it.
    reach = F.sequence(F.greatest(F.floor((n - after) / block), F.lit(0)), F.floor((n + before) / block))
    rows = df.withColumn("__b", F.explode(reach)).withColumn("__home", F.col("__b") == own)

    def window(lo: int, hi: int):
        return Window.partitionBy(key, "__b").orderBy(order).rowsBetween(lo, hi)

    return rows.select("*", *[c.alias(k) for k, c in columns(window).items()]).where("__home").drop("__b", "__home")


def lagged(df: DataFrame, key: str, order: str, value: str, steps: int) -> DataFrame:
    """df with value_lag1..value_lag<steps>; null before the first row."""
    at = lambda w, k: F.max(value).over(w(-k, -k))
    return framed(df, key, order, steps, 0, lambda w: {f"{value}_lag{k}": at(w, k) for k in range(1, steps + 1)})


def second_difference(df: DataFrame, key: str = "signal_id", order: str = "n", value: str = "x") -> DataFrame:
    """d2 = x - 2 x[-1] + x[-2]; 0 for the first two rows."""
    rows = lagged(df, key, order, value, 2)
    d2 = F.col(value) - 2 * F.col(f"{value}_lag1") + F.col(f"{value}_lag2")
    return rows.withColumn("d2", F.coalesce(d2, F.lit(0.0))).drop(f"{value}_lag1", f"{value}_lag2")


def runs(df: DataFrame, key: str, order: str, flag: Column, block: int = BLOCK, extra: list[Column] | None = None) -> DataFrame:
    """key, start, end (inclusive), length of maximal runs of rows whose flag is true.

    extra: sums or other aggregates that can be added up again, as F.sum(...).alias(name).
    """
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__b", F.floor(F.col(order) / block))
    rows = rows.where("__f").withColumn("__r", F.col(order) - F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)))
    parts = rows.groupBy(key, "__b", "__r").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    w = Window.partitionBy(key).orderBy("start")
    first = F.coalesce((F.col("start") != F.lag("end").over(w) + 1).cast("int"), F.lit(1))
    parts = parts.withColumn("__first", first).withColumn("__g", F.sum("__first").over(w))
    whole = parts.groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.select(key, "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def merge_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end", slack: float = 0.0, aggs: list[Column] | None = None) -> DataFrame:
    """Intervals of a key merged where start <= the furthest end so far + slack."""
    w = Window.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(far.isNull() | (F.col(start) > far + slack), 1).otherwise(0)
    rows = df.withColumn("__o", opens).withColumn("__g", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), *(aggs or []))
    return merged.drop("__g")


def complement(merged: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, start, end, kept: merged intervals as cut, and what lies between 0 and spans.duration as kept.

    merged: disjoint intervals inside the span. Rows of a key alternate in time order.
    """
    w = Window.partitionBy(key).orderBy("start")
    cut = merged.select(key, "start", "end")
    before = cut.select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    last = spans.join(cut.groupBy(key).agg(F.max("end").alias("e")), key, "left")
    tail = last.select(key, F.coalesce("e", F.lit(0.0)).alias("start"), F.col("duration").alias("end"))
    kept = before.unionByName(tail).where("end > start")
    return cut.withColumn("kept", F.lit(False)).unionByName(kept.withColumn("kept", F.lit(True)))


def dilate(df: DataFrame, key: str, order: str, flag: str, back: int, ahead: int, name: str) -> DataFrame:
    """name: whether a flag is set within `back` rows before or `ahead` rows after a row."""
    value = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    return framed(df, key, order, back, ahead, lambda w: {name: F.max(value).over(w(-back, ahead)) == 1})


def sliding(df: DataFrame, key: str, order: str, before: int, after: int, **columns: Column) -> DataFrame:
    """Aggregates over a frame of rows from `before` rows back to `after` rows on."""
    return framed(df, key, order, before, after, lambda w: {k: c.over(w(-before, after)) for k, c in columns.items()})


def local_baseline(df: DataFrame, key: str, order: str, value: str, wide: int = 32, near: int = 4, name: str = "baseline") -> DataFrame:
    """Mean of value within `wide` rows without those within `near` rows."""

    def columns(w):
        s = lambda k: F.sum(value).over(w(-k, k))
        n = lambda k: F.count(value).over(w(-k, k))
        rest = n(wide) - n(near)
        return {name: F.when(rest > 0, (s(wide) - s(near)) / rest).otherwise(0.0)}

    return framed(df, key, order, wide, wide, columns)


def centred_mean(df: DataFrame, key: str, order: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Mean over 2 half + 1 rows; rows beyond an end count as the row at that end."""
    ends = df.groupBy(key).agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"), F.max(order).alias("__top"))
    rows = framed(df, key, order, half, half, lambda w: {"__s": F.sum(value).over(w(-half, half))}).join(ends, key)
    low = F.greatest(F.lit(half) - F.col(order), F.lit(0))
    high = F.greatest(F.col(order) + half - F.col("__top"), F.lit(0))
    mean = (F.col("__s") + low * F.col("__first") + high * F.col("__last")) / (2 * half + 1)
    return rows.withColumn(name, mean).drop("__s", "__first", "__last", "__top")
