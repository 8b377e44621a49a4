"""Mixing to target weights by soft domain membership, in DataFrame functions only.

A classifier learned from a labelled table gives each document posteriors over domains: its marks,
short character strings whose frequencies differ most between the domains, are found in the
labelled texts, and class Gaussians over their log shares give the odds. Projected gradient steps
then fit nonnegative document rates whose expected token totals by domain meet the targets. Only
sums by domain reach the driver; a document's rate is a fold over the steps.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

MARKS = 16
#: Bounds of the sample in which marks are looked for: labelled rows a domain, and characters a text.
MARK_ROWS = 128
MARK_CHARS = 65_536
#: Starts of strings in a piece of a word; a piece has two characters more, so that pieces hold all strings of a word.
PIECE_STARTS = 62
LEAST_VARIANCE = 0.05
STEPS = 60
#: Steps after which rates are written, so that a rate isn't folded anew from the first step.
FOLD_STEPS = 8
TOLERANCE = 1e-4
#: Token shares by language that the registered query and the pipeline aim at.
TARGETS = {"de": 0.16, "en": 0.56, "es": 0.13, "fr": 0.15}


def tokens(text: Column) -> Column:
    """Words by their separators: spaces and line feeds plus one; 0 for null and empty."""
    gaps = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("double")


def _cuts(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda at: F.substring(F.col("w"), at, F.lit(size)))


def learn_marks(docs: DataFrame, labelled: DataFrame, domains: list[str], marks: int = MARKS, rows: int = MARK_ROWS, chars: int = MARK_CHARS) -> tuple[str, ...]:
    """The strings of 1 to 3 characters whose shares differ most between the domains of labelled texts.

    docs: doc_id, text; labelled: doc_id, domain. Each domain's sample is the `rows` ids with the
    smallest hashes among its texts of at most `chars` characters, lower-cased. Strings lie in a word, however
    long, and the spaces beside it. Shares count by their roots; of two strings of two or three
    characters of which one holds the other, the better one stays. Without a sample there are no
    marks.
    """
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    fit = docs.select("doc_id", F.lower("text").alias("t")).where((F.length("t") > 0) & (F.length("t") <= chars))
    # At most `rows` ids a domain.
    chosen = known.join(fit.select("doc_id"), "doc_id", "left_semi").withColumn("at", F.row_number().over(order)).where(F.col("at") <= rows).select("doc_id", "domain")
    texts = fit.join(F.broadcast(chosen), "doc_id")
    # Words are counted first, with a space on each side; their strings are few.
    words = texts.select("domain", F.explode(F.split("t", "[ \n]+")).alias("w")).groupBy("domain", "w").agg(F.count(F.lit(1)).alias("c"))
    words = words.where(F.length("w") > 0).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    starts = F.sequence(F.lit(0), F.length("w") - 1, F.lit(PIECE_STARTS))
    words = words.select("domain", "c", F.explode(F.transform(starts, lambda at: F.substring(F.col("w"), at + 1, F.lit(PIECE_STARTS + 2)))).alias("w"))
    firsts = F.sequence(F.lit(1), F.least(F.length("w"), F.lit(PIECE_STARTS)))
    cuts = F.flatten(F.array(*[_cuts(firsts, size) for size in (1, 2, 3)]))
    grams = words.select("domain", "c", F.explode(cuts).alias("g")).groupBy("domain", "g").agg(F.sum("c").alias("c"))
    grams = written(grams, "mix-grams")
    sizes = grams.groupBy("domain").agg(F.sum("c").alias("n"))
    root = F.sqrt(F.col("c") / F.col("n"))
    spread = F.sum(root * root) - F.sum(root) * F.sum(root) / len(domains)
    best = grams.join(F.broadcast(sizes), "domain").groupBy("g").agg(F.round(spread, 9).alias("s")).orderBy(F.desc("s"), "g").limit(marks * 32)
    found: list[str] = []
    for r in best.collect():
        if len(found) < marks and not any(len(m) > 1 and len(r["g"]) > 1 and (r["g"] in m or m in r["g"]) for m in found):
            found.append(r["g"])
    return tuple(found)


def features(text: Column, marks: tuple[str, ...]) -> Column:
    """log share of each mark in the lower-cased text; a null text counts as empty."""
    text = F.lower(F.coalesce(text, F.lit("")))
    size = F.octet_length(text)
    return F.array(*[F.log(((size - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode()) + 0.5) / (size + 50)) for m in marks]).cast("array<double>")


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def posteriors(table: DataFrame, labelled: DataFrame, domains: list[str], marks: int) -> list[Column]:
    """Posterior expressions over table.f (of `marks` numbers) by a Gaussian class model learned from labelled (doc_id, domain).

    Rows of other domains, and null ids, aren't learned from; repeated labels count once. Domains
    without a labelled row have posterior 0; if there is none at all, all posteriors are equal.
    """
    rows = table.join(labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain").distinct(), "doc_id")
    f = [F.col("f")[i] for i in range(marks)]
    sums = rows.groupBy("domain").agg(F.count(F.lit(1)), *[F.avg(x) for x in f], *[F.var_pop(x) for x in f]).collect()
    known = {r[0]: (r[1], r[2 : 2 + len(f)], r[2 + len(f) :]) for r in sums}
    if not known:
        return [F.lit(1.0 / len(domains)) for _ in domains]
    n = sum(k[0] for k in known.values())
    logs = {}
    for d, (count, mean, var) in known.items():
        var = [v + LEAST_VARIANCE for v in var]
        logs[d] = _total([F.lit(math.log(count / n)), *[-0.5 * (x - m) * (x - m) / v - 0.5 * math.log(v) for x, m, v in zip(f, mean, var, strict=True)]])
    top = F.greatest(*logs.values()) if len(logs) > 1 else next(iter(logs.values()))
    odds = {d: F.exp(x - top) for d, x in logs.items()}
    return [odds[d] / _total(list(odds.values())) if d in odds else F.lit(0.0) for d in domains]


def rate_after(start: Column, history: list[list[float]], p: Column, least: float) -> Column:
    """A document's rate after the steps: from start, r = max(least, r - step . p) for each."""
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])
    move = lambda step: F.aggregate(F.zip_with(step, p, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(steps, start, lambda r, step: F.greatest(F.lit(float(least)), r - move(step)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, grow: bool = False, marks: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, tokens, posterior (array in the order of sorted targets), rate and copies of each row.

    Minimises the squares of sum(rate * tokens * posterior) - target by domain, in the metric of
    the domains' token products, over rates of at least `least` (0 or more), from rate 1, by
    projected gradient steps that move documents of like posteriors alike, long or short. The target
    total is that of all tokens, or with grow the least total that takes none from a domain; a
    domain without tokens has no target. copies is the rate rounded by a hash of the id, so its
    expected value is the rate. A gap beyond TOLERANCE after STEPS steps is told as a warning.

    marks: the strings to judge texts by; those of learn_marks() by default. Null and empty texts
    have no tokens and keep what their posterior gives. Repeated rows are rows; an empty table has
    an empty result.
    """
    domains = sorted(targets)
    if marks is None:
        marks = learn_marks(docs, labelled, domains)
    base = written(docs.select("doc_id", tokens(F.col("text")).alias("tokens"), features(F.col("text"), marks).alias("f")), "mix-features")
    p = posteriors(base, labelled, domains, len(marks))
    soft = written(base.select("doc_id", "tokens", F.array(*p).alias("p"), F.lit(1.0).alias("r")), "mix-posteriors")
    k = range(len(domains))
    post = [F.col("p")[i] for i in k]
    first = soft.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * x).alias(f"m{i}") for i, x in enumerate(post)], *[F.sum(F.col("tokens") * x * y).alias(f"g{i}_{j}") for i, x in enumerate(post) for j, y in enumerate(post)]).collect()[0]
    history: list[list[float]] = []
    if first["n"]:
        mass = [first[f"m{i}"] for i in k]
        share = [targets[d] * (mass[i] > 0) for i, d in enumerate(domains)]
        total = max((m / s for m, s in zip(mass, share, strict=True) if s > 0), default=0.0) if grow else sum(mass) / (sum(share) or 1)
        goal = [total * s for s in share]
        # In this metric a step of 1 is exact while no rate meets its bound, and never too long.
        metric = np.linalg.pinv([[first[f"g{i}_{j}"] for j in k] for i in k], rcond=1e-9, hermitian=True)
        for step in range(STEPS + 1):
            gap = [m - g for m, g in zip(mass, goal, strict=True)]
            if max(abs(x) for x in gap) <= TOLERANCE * total:
                break
            if step == STEPS:
                warnings.warn(f"mixing stops {max(abs(x) for x in gap) / total:.2g} of all tokens from its targets", stacklevel=2)
                break
            if len(history) == FOLD_STEPS:
                soft, history = written(soft.select("doc_id", "tokens", "p", rate_after(F.col("r"), history, F.col("p"), least).alias("r")), "mix-rates"), []
            history.append((metric @ gap).tolist())
            rate = rate_after(F.col("r"), history, F.col("p"), least)
            mass = list(soft.agg(*[F.sum(rate * F.col("tokens") * x) for x in post]).collect()[0])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rate = rate_after(F.col("r"), history, F.col("p"), least)
    return soft.select("doc_id", "tokens", F.col("p").alias("posterior"), rate.alias("rate")).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
