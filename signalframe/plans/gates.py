"""Evaluation gates: manifests, deltas, regression bands, diarization error, rubric."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import grouped_map

#: Columns and the deviations from a baseline that still count as noise.
BANDS = {"lufs": 0.2, "true_peak": 0.1, "ovrl": 0.1}


def manifest_errors(clips: DataFrame, classes: list[str], required: list[str]) -> DataFrame:
    """clip, error: missing fields, repeated ids and unknown classes."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    own = F.filter(F.array(*missing, F.when(~F.col("class").isin(classes), F.lit("unknown class"))), lambda x: x.isNotNull())
    rows = clips.select(F.col("id").alias("clip"), F.explode(own).alias("error"))
    twice = clips.groupBy(F.col("id").alias("clip")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("clip", F.lit("repeated id").alias("error"))
    return rows.unionByName(twice)


def class_coverage(clips: DataFrame, classes: DataFrame) -> DataFrame:
    """class, clips for every class, 0 where it has none."""
    n = clips.groupBy("class").agg(F.count(F.lit(1)).alias("clips"))
    return classes.join(n, "class", "left").select("class", F.coalesce("clips", F.lit(0)).alias("clips"))


def regressions(now: DataFrame, before: DataFrame, key: str, bands: dict[str, float] = BANDS) -> DataFrame:
    """key, metric, delta, verdict: ok, changed, new or gone, over a full join."""
    cols = [c for c in bands if c in now.columns]
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in cols])).alias("x")).select(key, "x.*")
    band = F.create_map(*[F.lit(x) for c in cols for x in (c, bands[c])])
    rows = long(now, "now").join(long(before, "before"), [key, "metric"], "full")
    delta = F.col("now") - F.col("before")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.abs(delta) > band[F.col("metric")], "changed").otherwise("ok")
    return rows.select(key, "metric", delta.alias("delta"), verdict.alias("verdict"))


def delta_gate(before: DataFrame, after: DataFrame, key: str, metric: str, least: float) -> DataFrame:
    rows = before.select(key, F.col(metric).alias("b")).join(after.select(key, F.col(metric).alias("a")), key)
    return rows.select(key, (F.col("a") - F.col("b")).alias("delta"), (F.col("a") - F.col("b") >= least).alias("passed"))


def clip_gates(clips: DataFrame, key: str) -> DataFrame:
    """key, gate, status, value of each clip's gates: pass, fail, skip (not measured) or report.

    clips: lufs, target_lufs, true_peak, ceiling, real_speech, noisy, bak, ovrl, sig (differences
    after less before), pesq (difference), stoi, spread_before, spread_after, music_delta.
    Perceptual gates judge real speech only; intelligibility is only reported.
    """
    c = F.col
    speech = F.coalesce(c("real_speech"), F.lit(False))
    drop = F.when(c("spread_before") > 0, 1 - c("spread_after") / c("spread_before"))
    rules = [
        ("loudness", F.abs(c("lufs") - c("target_lufs")), F.abs(c("lufs") - c("target_lufs")) <= 0.5, F.lit(True)),
        ("true_peak", c("true_peak"), c("true_peak") <= c("ceiling"), F.lit(True)),
        ("background", c("bak"), c("bak") >= 1.0, speech & c("noisy")),
        ("overall", c("ovrl"), c("ovrl") >= F.when(c("noisy"), 0.4).otherwise(-0.05), speech),
        ("signal", c("sig"), c("sig") >= -0.1, speech),
        ("pesq", c("pesq"), c("pesq") >= 0.4, speech & c("noisy")),
        ("leveler", drop, drop >= 0.5, F.lit(True)),
        ("music", c("music_delta"), F.abs(c("music_delta")) <= 2.0, F.lit(True)),
        ("stoi", c("stoi"), None, speech),
    ]
    rows = [F.struct(F.lit(n).alias("gate"), F.when(v.isNull() | ~F.coalesce(on, F.lit(False)), "skip").when(F.lit(ok is None), "report").when(F.coalesce(ok if ok is not None else F.lit(True), F.lit(False)), "pass").otherwise("fail").alias("status"), v.cast("double").alias("value")) for n, v, ok, on in rules]
    return clips.select(key, F.explode(F.array(*rows)).alias("g")).select(key, "g.*")


def verdict(results: DataFrame, key: str) -> DataFrame:
    """key, passed: whether all gates that weren't skipped or only reported passed."""
    return results.groupBy(key).agg(F.coalesce(F.bool_and(F.when(~F.col("status").isin("skip", "report"), F.col("status") == "pass")), F.lit(True)).alias("passed"))


def assigned(gain: np.ndarray) -> float:
    """The largest total gain of a matching of rows to columns, each used once at most; gains are 0 or more.

    Shortest augmenting paths with potentials, a row at a time: cubic in the smaller side.
    """
    cost = -(gain if gain.shape[0] <= gain.shape[1] else gain.T)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j = row, -1
        while i >= 0:
            if j >= 0:
                used[j] = True
            slack = cost[i] - u[i] - v
            better = ~used & (slack < least)
            least[better], back[better] = slack[better], j
            j = int(np.argmin(np.where(used, np.inf, least)))
            step = least[j]
            # Rows on the tree and their columns move by the step; the other columns come nearer.
            u[row] += step
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            i = owner[j]
        while j >= 0:
            owner[j] = owner[back[j]] if back[j] >= 0 else row
            j = back[j]
    return float(-sum(cost[owner[j], j] for j in range(m) if owner[j] >= 0))


def diarization_error(reference: DataFrame, found: DataFrame, key: str, step: float = 0.01, collar: float = 0.25) -> DataFrame:
    """key, der over a grid of steps: missed, false and confused speech over the reference's speech.

    reference and found: key, speaker (any labels, any number of them), t_start, t_end. Steps within
    the collar of a reference boundary don't count; the mapping of found to reference speakers with
    the most common time does. Common steps of pairs are sums; a key's pairs, few numbers, are
    matched where they are grouped.
    """
    def grid(df: DataFrame, name: str) -> DataFrame:
        first, last = F.ceil(F.col("t_start") / step - 0.5), F.ceil(F.col("t_end") / step - 0.5) - 1
        rows = df.where(last >= first).select(key, F.col("speaker").cast("string").alias("speaker"), F.explode(F.sequence(first, last)).alias("i"))
        return rows.groupBy(key, "i").agg(F.array_sort(F.collect_set("speaker")).alias(name))

    edges = reference.select(key, F.explode(F.array("t_start", "t_end")).alias("e"))
    near = edges.select(key, F.explode(F.sequence(F.ceil((F.col("e") - collar) / step - 0.5), F.floor((F.col("e") + collar) / step - 0.5))).alias("i")).distinct()
    cells = grid(reference, "r").join(grid(found, "h"), [key, "i"], "full").join(near, [key, "i"], "left_anti")
    none = F.array().cast("array<string>")
    # Steps with the same speakers on both sides count together.
    cells = cells.groupBy(key, F.coalesce("r", none).alias("r"), F.coalesce("h", none).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    all_ = cells.groupBy(key).agg(F.sum(F.size("r") * F.col("n")).alias("speech"), F.sum(F.greatest(F.size("r"), F.size("h")) * F.col("n")).alias("most"))
    pairs = cells.select(key, "n", F.explode("r").alias("a"), "h").select(key, "n", "a", F.explode("h").alias("b")).groupBy(key, "a", "b").agg(F.sum("n").alias("common"))

    def match(group):
        a, rows = np.unique(group["a"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        b, columns = np.unique(group["b"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        gain = np.zeros((len(a), len(b)))
        gain[rows, columns] = group["common"].to_numpy()
        return {"right": [assigned(gain)]}

    right = grouped_map(pairs, [key], ["a", "b"], ["common"], match, "right double").withColumnRenamed(key, "__key")
    rows = all_.join(right, F.col(key).eqNullSafe(F.col("__key")), "left")
    return rows.select(key, F.when(F.col("speech") > 0, (F.col("most") - F.coalesce("right", F.lit(0.0))) / F.col("speech")).otherwise(0.0).alias("der"))


def rubric(notes: DataFrame, key: str, duration: Column, least_bullets: int = 3, least_chapters: int = 2, chapters_after: float = 600.0, least_keywords: int = 3, first: float = 0.0) -> DataFrame:
    """key, score, usable, failed of notes (summary, bullets, chapters(start, title), titles, keywords)."""
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    filled = lambda a: F.forall(a, lambda s: F.trim(s) != "")
    starts = F.transform("chapters", lambda c: c["start"])
    n = F.size("chapters")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.get(starts, i) > F.get(starts, i - 1)))
    # Names, weights and which ones are required.
    checks = [
        ("summary_length", words(F.col("summary")).between(20, 250), 2.0, True),
        ("bullets_count", F.size("bullets").between(least_bullets, 10) & filled(F.col("bullets")), 1.5, True),
        ("chapters_count", n >= F.when(duration > chapters_after, least_chapters).otherwise(1), 1.5, False),
        ("chapters_monotonic", rising, 2.0, True),
        ("chapters_in_range", F.forall(starts, lambda s: (s >= first) & (s <= duration)), 2.0, True),
        ("chapters_open_the_episode", (n == 0) | (F.abs(F.get(starts, F.lit(0)) - first) < 1), 1.0, False),
        ("chapters_titled", F.forall("chapters", lambda c: (F.trim(c["title"]) != "") & (F.length(c["title"]) <= 80)), 1.0, True),
        ("titles_present", (F.size("titles") > 0) & F.forall("titles", lambda t: (F.trim(t) != "") & (F.length(t) <= 120)), 1.0, True),
        ("keywords_present", (F.size("keywords") >= least_keywords) & filled(F.col("keywords")), 1.0, False),
    ]
    ok = {name: F.coalesce(c, F.lit(False)) for name, c, _, _ in checks}
    earned = reduce(lambda a, b: a + b, [F.when(ok[name], w).otherwise(0.0) for name, _, w, _ in checks])
    score = earned / sum(w for _, _, w, _ in checks)
    required = reduce(lambda a, b: a & b, [ok[name] for name, _, _, r in checks if r])
    failed = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in ok.items()]), lambda x: x.isNotNull())
    return notes.select(key, score.alias("score"), (required & (score >= 0.8)).alias("usable"), failed.alias("failed"))
