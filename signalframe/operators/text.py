"""Transcript text: terms, weights, keywords, topic drift, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English function words and verbal tics that never count as terms.
STOPWORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were what "
    "about there think would these thing things really going yeah okay right actually basically kind sort mean maybe gonna something anything everything because could should still guess "
    "little lot bit said says also into even back look looking talk talking talked got getting goes went does doing done made makes making give gives given need needs wants wanted"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and apostrophes, apostrophes taken out."""
    return F.filter(F.transform(_parts(text), lambda t: F.replace(t, F.lit("'"), F.lit(""))), lambda t: t != "")


def _parts(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}']+")


def fold_plural(term: Column) -> Column:
    """Without a final s, where longer than 3 bytes and not ending in ss, us or is."""
    plural = (F.octet_length(term) > 3) & term.endswith("s") & ~term.endswith("ss") & ~term.endswith("us") & ~term.endswith("is")
    return F.when(plural, F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def term_counts(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, term, tf. Terms have 3 bytes or more, aren't numbers or stopwords, plurals folded.

    Texts are dealt by the first key before they are split, as a file of few row groups is read by few tasks;
    what groups by that key, and by others beside it, moves no term.
    """
    dealt = segments.select(*keys, text).repartition(keys[0])
    t = dealt.select(*keys, F.explode(_parts(F.col(text))).alias("t")).withColumn("t", F.replace("t", F.lit("'"), F.lit("")))
    t = t.where((F.octet_length("t") >= 3) & ~F.col("t").isin(STOPWORDS))
    # Numbers have no plural, so they are told from the terms, of which there are fewer.
    found = t.groupBy(*keys, fold_plural(F.col("t")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    return found.where(~F.col("term").rlike(r"^\p{N}+$"))


def postings(terms: DataFrame, owner: str, seg: str) -> DataFrame:
    """owner, term, tf, posts: a term's count and its segments as structs (seg, tf), in order."""
    return terms.groupBy(owner, "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.collect_list(F.struct(F.col(seg).alias("seg"), "tf"))).alias("posts"))


def idf(posts: DataFrame, docs: DataFrame, owner: str) -> DataFrame:
    """owner, term, tf, posts, df, idf = ln(1 + N / df), n = N, the owner's segments (docs: owner, n)."""
    df = posts.withColumn("df", F.size("posts").cast("long"))
    return df.join(docs, owner).select(owner, "term", "tf", "posts", "df", F.log(1 + F.greatest("n", F.lit(1)) / F.col("df")).alias("idf"), "n")


def keywords(weights: DataFrame, owner: str, most: int = 8, digits: int = 9) -> DataFrame:
    """owner, term, rank, score: the highest sums of tf * idf; terms of one segment don't count from 10 segments on."""
    total = weights.where((F.col("n") < 10) | (F.col("df") >= 2)).select(owner, "term", (F.col("tf") * F.col("idf")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.round("score", digits).desc(), "term"))
    return total.select(owner, "term", "score", rank.alias("rank")).where(F.col("rank") <= most)


def segment_scores(segments: DataFrame, weights: DataFrame, owner: str, seg: str, text: str = "text") -> DataFrame:
    """owner, seg, score: tf * idf over the root of distinct terms; 0 below 6 words."""
    rows = weights.select(owner, "idf", F.explode("posts").alias("p")).select(owner, F.col("p.seg").alias(seg), (F.col("p.tf") * F.col("idf")).alias("x"))
    mass = rows.groupBy(owner, seg).agg((F.sum("x") / F.sqrt(F.count(F.lit(1)))).alias("mass"))
    # Words are counted behind the join, where texts are dealt to more tasks than read them.
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = segments.select(owner, seg, text).join(mass, [owner, seg], "left")
    return rows.select(owner, seg, F.when(words < 6, 0.0).otherwise(F.coalesce("mass", F.lit(0.0))).alias("score"))


def ranked_segments(scores: DataFrame, owner: str, seg: str, digits: int = 9) -> DataFrame:
    """Segments with a score, ranked by falling score, then order."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.round("score", digits).desc(), seg))
    return scores.where("score > 0").withColumn("rank", rank)


def gap_similarity(posts: DataFrame, docs: DataFrame, owner: str, seg: str, window: int = 3) -> DataFrame:
    """owner, gap, sim: cosine of the term counts of the w segments before and from each gap on.

    docs: owner, n; segments are numbered 0 to n - 1; w = window, at most n // 3 and at least 1.
    Both sides are sums of segments, so their products are sums of those of near segments: terms are summed
    once a pair of segments, and only these sums are spread over the gaps.
    """
    w = F.greatest(F.least(F.lit(window), F.floor(F.col("n") / 3)), F.lit(1))
    sized = docs.withColumn("w", w).where(F.col("n") >= 2 * w + 1)
    ahead = lambda p, i: F.filter(F.slice("posts", i + 1, F.lit(2 * window)), lambda q: q["seg"] - p["seg"] < 2 * window)
    pair = lambda p, q: F.struct(p["seg"].alias("s"), (q["seg"] - p["seg"]).alias("d"), (p["tf"] * q["tf"]).alias("v"))
    pairs = F.flatten(F.transform("posts", lambda p, i: F.transform(ahead(p, i), lambda q: pair(p, q))))
    # Most terms have one segment, which needs no search.
    only = F.get("posts", F.lit(0))
    pairs = F.when(F.size("posts") == 1, F.array(pair(only, only))).otherwise(pairs)
    near = posts.select(owner, F.explode(pairs).alias("p")).select(owner, "p.*").groupBy(owner, "s", "d").agg(F.sum("v").alias("v"))
    # Segments s and s + d lie in the frame of the gaps s+d-w+1..s+w, on one side or on both.
    rows = near.join(sized, owner).where(F.col("d") < 2 * F.col("w"))
    spread = rows.withColumn("gap", F.explode(F.sequence(F.col("s") + F.col("d") - F.col("w") + 1, F.col("s") + F.col("w"))))
    spread = spread.where((F.col("gap") >= F.col("w")) & (F.col("gap") <= F.col("n") - F.col("w")))
    before, after = F.col("s") + F.col("d") < F.col("gap"), F.col("s") >= F.col("gap")
    twice = F.when(F.col("d") == 0, F.col("v")).otherwise(2 * F.col("v"))
    part = lambda where, v: F.coalesce(F.sum(F.when(where, v)), F.lit(0))
    sides = spread.groupBy(owner, "gap").agg(part(before, twice).alias("aa"), part(after, twice).alias("bb"), part(~before & ~after, F.col("v")).alias("ab"))
    norm = F.sqrt(F.col("aa") * F.col("bb"))
    sims = sides.select(owner, "gap", F.when(norm > 0, F.col("ab") / norm).otherwise(0.0).alias("sim"))
    every = sized.select(owner, F.explode(F.sequence(F.col("w"), F.col("n") - F.col("w"))).alias("gap"))
    return every.join(sims, [owner, "gap"], "left").select(owner, "gap", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def depths(sims: DataFrame, owner: str, digits: int = 9) -> DataFrame:
    """owner, gap, sim, depth: at local minima the rise to the peaks on either side, else 0.

    A peak is the last value of a climb that never falls; climbs end where the curve turns.
    """
    w = Window.partitionBy(owner).orderBy("gap")
    rows = sims.withColumn("sim", F.round("sim", digits)).withColumns({"l": F.lag("sim").over(w), "r": F.lead("sim").over(w)})
    minimum = (F.col("l").isNull() | (F.col("l") >= F.col("sim"))) & (F.col("r").isNull() | (F.col("r") >= F.col("sim")))
    # Going left the climb stops before a value that is lower than its right neighbour, and so on.
    left_stop = F.when(F.col("l") < F.col("sim"), F.col("gap"))
    right_stop = F.when(F.col("r") < F.col("sim"), F.col("gap"))
    first = F.first("sim").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.last("sim").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({
        "ls": F.last(F.when(left_stop.isNotNull(), F.col("sim")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "rs": F.first(F.when(right_stop.isNotNull(), F.col("sim")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "lo": first, "hi": end, "min": minimum})
    depth = F.coalesce("ls", "lo") - F.col("sim") + F.coalesce("rs", "hi") - F.col("sim")
    return rows.select(owner, "gap", "sim", F.when(F.col("min"), depth).otherwise(0.0).alias("depth"))


def depth_cutoff(rows: DataFrame, owner: str) -> DataFrame:
    """owner, cutoff: mean less half the population deviation of positive depths; infinite without any."""
    d = F.when(F.col("depth") > 0, F.col("depth"))
    return rows.groupBy(owner).agg(F.coalesce(F.avg(d) - F.stddev_pop(d) / 2, F.lit(float("inf"))).alias("cutoff"))


def clip(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space, marks trimmed, with an ellipsis."""
    t = F.trim(text)
    head = F.substring(t, 1, most)
    cut = F.regexp_replace(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1), "[,;:]+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(F.instr(head, " ") > 0, cut).otherwise(head), F.lit("…")))


def title_case(term: Column) -> Column:
    return F.concat(F.upper(F.substring(term, 1, 1)), term.substr(F.lit(2), F.length(term)))


def join_terms(terms: Column) -> Column:
    """'A', 'A & B', 'A, B & C'."""
    n = F.size(terms)
    return F.when(n == 0, "").when(n == 1, F.get(terms, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(terms, F.lit(1), n - 1), ", "), F.lit(" & "), F.element_at(terms, -1)))


def clean_list(items: Column) -> Column:
    """Trimmed items without list marks or empties; adjacent repeats once."""
    t = F.transform(items, lambda s: F.trim(F.regexp_replace(F.trim(s), "^[-*•]+", "")))
    t = F.filter(t, lambda s: s != "")
    return F.filter(t, lambda s, i: (i == 0) | (s != F.get(t, i - 1)))


def clean_keywords(items: Column) -> Column:
    """clean_list() in lower case without hash marks; adjacent repeats once."""
    t = F.filter(F.transform(clean_list(items), lambda s: F.lower(F.trim(F.regexp_replace(s, "^#+", "")))), lambda s: s != "")
    return F.filter(t, lambda s, i: (i == 0) | (s != F.get(t, i - 1)))


def clean_title(title: Column) -> Column:
    """Without quotes, marks and a leading 'Chapter 3:'."""
    t = F.trim(F.regexp_replace(F.trim(title), r'^["*#-]+|["*#-]+$', ""))
    for word in ("Chapter", "Section", "Part"):
        t = F.regexp_replace(t, rf"^{word} \s*[0-9]*\s*:\s*(?=\S)", "")
    return t


def first_json(text: Column) -> Column:
    """The first balanced JSON object in a text, strings honoured; null if there is none."""
    def scan(value: str | None) -> str | None:
        at = (value or "").find("{")
        if at < 0:
            return None
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(value)):
            c = value[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), quoted and (escaped or c != '"')
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return value[at : i + 1]
        return None

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        return values.map(scan, na_action="ignore")

    return find(text)
