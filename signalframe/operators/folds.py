"""Ordered folds whose state isn't associative, over ordered groups.

Folds of one number a group stay in the JVM as aggregate(); those that tell something of each row
run over sorted groups (grouped.py), linear in their rows. Sample-level recursions are in recursive.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import grouped_map, numbers


def ordered(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and rows: its rows as structs (order, columns), sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def thin(df: DataFrame, key: str, at: str, gap: float, columns: list[str]) -> DataFrame:
    """Rows kept in order, each at least gap after the last kept one."""
    kinds = dict(df.dtypes)

    def run(group):
        v = numbers(group, at)
        kept, k = [], 0
        while k < len(v):
            kept.append(k)
            k = int(np.searchsorted(v, v[k] + gap))
            # Rounding of the sum mustn't keep a row that lies nearer.
            while k < len(v) and v[k] - v[kept[-1]] < gap:
                k += 1
            k = max(k, kept[-1] + 1)
        rows = group.take(kept)
        return {c: rows[c].to_pylist() for c in [at, *columns]}

    return grouped_map(df, [key], [at], columns, run, ", ".join(f"`{c}` {kinds[c]}" for c in [at, *columns]))


def greedy_far(df: DataFrame, key: str, score: str, at: str, gap: float, most: int) -> DataFrame:
    """key, at of rows taken by falling score (then rising at), each at least gap from all taken; most at most."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(at).alias("t")))).alias("rows"))
    far = lambda kept, t: F.forall(kept, lambda k: F.abs(k - t) >= gap)
    step = lambda kept, x: F.when((F.size(kept) < most) & far(kept, x["t"]), F.array_append(kept, x["t"])).otherwise(kept)
    return rows.select(key, F.explode(F.aggregate("rows", F.array().cast("array<double>"), step)).alias(at))


def slew(df: DataFrame, key: str, order: str, wanted: str, up: float, down: float, start: float = 0.0, hold: str | None = None, name: str = "gain") -> DataFrame:
    """key, order, name: follows wanted by at most up or down a row; rows with hold keep the last value."""

    def run(group):
        held = group[hold].to_pylist() if hold else [False] * group.num_rows
        g, out = float(start), np.empty(group.num_rows)
        for i, (want, keep) in enumerate(zip(numbers(group, wanted).tolist(), held, strict=True)):
            if not keep:
                g += min(max(want - g, -down), up)
            out[i] = g
        return {order: group[order].to_pylist(), name: out}

    return grouped_map(df, [key], [order], [wanted, *([hold] if hold else [])], run, f"`{order}` {dict(df.dtypes)[order]}, `{name}` double")


def dc_block(df: DataFrame, key: str, order: str, value: str, pole: float = 0.9975) -> DataFrame:
    """key, order, y of y = x - x[-1] + pole * y[-1], from zero."""
    from .recursive import dc_blocked

    def run(group):
        return {order: group[order].to_pylist(), "y": dc_blocked(numbers(group, value), pole)}

    return grouped_map(df, [key], [order], [value], run, f"`{order}` {dict(df.dtypes)[order]}, y double")


def caption_lines(words: DataFrame, key: str, most_words: int = 6, most_chars: int = 32, pause: float = 0.7) -> DataFrame:
    """words (key, start, end, text, word) with line: a new one beyond the words, characters or pause."""
    kinds = dict(words.dtypes)

    def run(group):
        line = n = chars = 0
        last, out = 0.0, []
        for start, end, size in zip(numbers(group, "start").tolist(), numbers(group, "end").tolist(), map(len, group["text"].to_pylist()), strict=True):
            if n and (n >= most_words or chars + 1 + size > most_chars or start - last > pause):
                line, n, chars = line + 1, 0, 0
            chars = chars + 1 + size if n else size
            n, last = n + 1, end
            out.append(line)
        return {**{c: group[c].to_pylist() for c in ("start", "end", "text", "word")}, "line": out}

    return grouped_map(words, [key], ["start", "word"], ["end", "text"], run, f"start {kinds['start']}, end {kinds['end']}, text string, word {kinds['word']}, line int")


BANDS = "array<struct<freq:double,gain:double,q:double>>"


def merged_bands(old, new, n):
    """Bands matched by their place and averaged as the n-th of a history; those that one side lacks stay as they are."""
    mean = lambda a, b: a + (b - a) / n
    both = lambda a, b: F.struct(*[mean(a[c], b[c]).alias(c) for c in ("freq", "gain", "q")])
    return F.zip_with(old, new, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both(a, b)))


def running_profiles(history: DataFrame, key: str, order: str, values: list[str], bands: str | None = None) -> DataFrame:
    """key, n and values after a history of rows in order: 'merge' averages in, 'upsert' replaces.

    history has a column op. A merge into nothing is an upsert; after an upsert n is 1. bands: a
    column of BANDS, merged by place.
    """
    rows = ordered(history, key, order, ["op", *values, *([bands] if bands else [])])

    def step(acc, x):
        fresh = (x["op"] == "upsert") | (acc["n"] == 0)
        n = F.when(fresh, 1).otherwise(acc["n"] + 1)
        told = [F.when(fresh, x[v].cast("double")).otherwise(acc[v] + (x[v] - acc[v]) / n).alias(v) for v in values]
        if bands:
            told.append(F.when(fresh, x[bands].cast(BANDS)).otherwise(merged_bands(acc[bands], x[bands].cast(BANDS), n)).cast(BANDS).alias(bands))
        return F.struct(n.alias("n"), *told)

    begin = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(v) for v in values], *([F.array().cast(BANDS).alias(bands)] if bands else []))
    return rows.select(key, F.aggregate("rows", begin, step).alias("x")).select(key, "x.*")


def greedy_chunks(df: DataFrame, key: str, order: str, size: str, budget: int, overlap: float = 0.08) -> DataFrame:
    """key, chunk, first, last: places (from 0) of rows in order, packed to the budget of sizes + 1.

    Each chunk after the first begins with whole rows of the last one worth up to the overlap, but
    always later than it began. A row beyond the budget makes a chunk alone.
    """
    back = int(budget * overlap)

    def run(group):
        sizes = group[size].to_pylist()
        out, start = [], 0
        while start < len(sizes):
            end, used = start, 0
            while end < len(sizes) and (end == start or used + sizes[end] + 1 <= budget):
                used += sizes[end] + 1
                end += 1
            out.append((len(out), start, end - 1))
            if end == len(sizes):
                break
            again, spare = end, back
            while again > start + 1 and sizes[again - 1] + 1 <= spare:
                spare -= sizes[again - 1] + 1
                again -= 1
            start = again
        return {c: [r[k] for r in out] for k, c in enumerate(("chunk", "first", "last"))}

    return grouped_map(df, [key], [order], [size], run, "chunk int, first int, last int")


def zipped(df: DataFrame, columns: list[str], name: str = "zipped", uneven: str = "error") -> DataFrame:
    """df with name: the arrays of columns as one array of structs, by place.

    uneven: what lists of other lengths do: "error", "shortest" (the rest is left out) or "longest"
    (nulls in the place of what is missing). A null array has no places.
    """
    lists = [F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c])) for c in columns]
    sizes = [F.size(c) for c in lists]
    whole = F.arrays_zip(*[c.alias(n) for c, n in zip(lists, columns, strict=True)])
    if uneven == "longest":
        return df.withColumn(name, whole)
    low, high = (F.least(*sizes), F.greatest(*sizes)) if len(sizes) > 1 else (sizes[0], sizes[0])
    if uneven == "shortest":
        return df.withColumn(name, F.slice(whole, F.lit(1), low))
    return df.withColumn(name, F.when(low == high, whole).otherwise(F.raise_error(F.lit(f"lists of other lengths: {', '.join(columns)}"))))
