"""Show notes: summary, bullets, chapters, titles and keywords of transcripts, extractive or by a completer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_clock, timecode
from ..sources.storage import settled
from . import text
from .folds import thin
from .grouped import grouped_map, numbers
from .intervals import nearest
from .master import completed

WINDOW, LEAST_DEPTH, LEAST_SECONDS, MOST_CHAPTERS = 3, 0.18, 60.0, 10
BULLETS, SUMMARY, KEYWORDS = 5, 3, 8
CHAPTERS = "array<struct<start:double,title:string>>"


def boundaries(segments: DataFrame, posts: DataFrame, key: str, seg: str = "seg", least_seconds: float = LEAST_SECONDS, most: int = MOST_CHAPTERS) -> DataFrame:
    """key, seg where a chapter begins, the first segment not among them.

    Deepest gaps first, of those that reach the cutoff; each at least least_seconds from the ends and
    from those taken, and most - 1 at most.
    """
    sizes = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    deep = settled(text.depths(text.gap_similarity(posts, sizes, key, seg, WINDOW), key), "depths")
    cutoff = text.depth_cutoff(deep, key)
    span = segments.groupBy(key).agg(F.min_by("s_start", seg).alias("first"), F.max_by("s_end", seg).alias("last"))
    starts = segments.select(key, F.col(seg).alias("gap"), "s_start")
    rows = deep.join(cutoff, key).where(F.col("depth") >= F.greatest("cutoff", F.lit(LEAST_DEPTH))).join(starts, [key, "gap"]).join(span, key)
    rows = rows.where((F.col("s_start") - F.col("first") >= least_seconds) & (F.col("last") - F.col("s_start") >= least_seconds)).withColumn("rank", -F.round("depth", 9))

    def take(group):
        taken, at = [], []
        for gap, t in zip(group["gap"].to_pylist(), numbers(group, "s_start").tolist(), strict=True):
            if len(taken) + 1 >= most:
                break
            if all(abs(t - a) >= least_seconds for a in at):
                taken.append(gap)
                at.append(t)
        return {seg: taken}

    return grouped_map(rows, [key], ["rank", "gap"], ["s_start"], take, f"`{seg}` {dict(segments.dtypes)[seg]}")


def chapters(segments: DataFrame, posts: DataFrame, key: str, seg: str = "seg") -> DataFrame:
    """key, chapter (from 0), start, title of segments (key, seg, s_start, s_end, text) and their text.postings, which are read twice.

    A title is made of the three terms that tell a chapter from the others; one that was used before
    is marked as continued, and a chapter without terms has its number.
    """
    first = segments.groupBy(key).agg(F.min(seg).alias(seg))
    starts = first.unionByName(boundaries(segments, posts, key, seg)).withColumn("opens", F.lit(1))
    order = Window.partitionBy(key).orderBy(seg)
    placed = segments.select(key, seg, "s_start").join(starts, [key, seg], "left").withColumn("chapter", F.sum(F.coalesce("opens", F.lit(0))).over(order) - 1)
    begin = settled(placed.groupBy(key, "chapter").agg(F.min_by("s_start", seg).alias("start"), F.min(seg).alias("from"), F.max(seg).alias("to")), "chapters")
    bounds = begin.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chapter", "from", "to"))).alias("c"))
    within = lambda c: F.aggregate(F.filter("posts", lambda p: p["seg"].between(c["from"], c["to"])), F.lit(0).cast("long"), lambda s, p: s + p["tf"])
    told = F.filter(F.transform("c", lambda c: F.struct(c["chapter"].alias("chapter"), within(c).alias("tf"))), lambda x: x["tf"] > 0)
    # A term of one segment in a transcript of one chapter, the most frequent case, needs no search.
    post, only = F.get("posts", F.lit(0)), F.get("c", F.lit(0))
    alone = F.when(post["seg"].between(only["from"], only["to"]), F.array(F.struct(only["chapter"].alias("chapter"), post["tf"].alias("tf"))))
    told = F.when((F.size("posts") == 1) & (F.size("c") == 1), alone).otherwise(told)
    tf = posts.join(bounds, key).select(key, "term", F.size("c").alias("n"), told.alias("told")).withColumn("idf", F.log(1 + F.col("n") / F.size("told")))
    tf = tf.select(key, "term", "idf", F.inline("told"))
    score = F.round(F.col("tf") * F.col("idf"), 9)
    ranked = tf.withColumn("r", F.row_number().over(Window.partitionBy(key, "chapter").orderBy(score.desc(), "term"))).where("r <= 3")
    best = ranked.groupBy(key, "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: text.title_case(x["term"])).alias("t"))
    rows = begin.join(best, [key, "chapter"], "left")
    title = F.when(F.coalesce(F.size("t"), F.lit(0)) > 0, text.join_terms(F.col("t"))).otherwise(F.concat(F.lit("Chapter "), (F.col("chapter") + 1).cast("string")))
    rows = rows.withColumn("title", title)
    again = F.row_number().over(Window.partitionBy(key, "title").orderBy("chapter")) > 1
    return rows.select(key, "chapter", "start", F.when(again, F.concat("title", F.lit(" (cont.)"))).otherwise(F.col("title")).alias("title"))


def titles(keywords: Column) -> Column:
    """Up to three titles of the first four keywords; adjacent repeats once."""
    t = F.transform(F.slice(keywords, 1, 4), text.title_case)
    n = F.size(t)
    a, b, c = (F.get(t, F.lit(k)) for k in range(3))
    made = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(a)).otherwise(
        F.filter(F.array(text.join_terms(F.slice(t, F.lit(1), F.least(n, F.lit(3)))), F.concat(a, F.lit(" and "), b), F.when(n > 2, F.concat(a, F.lit(", "), b, F.lit(", "), c))), lambda x: x.isNotNull()))
    return F.filter(made, lambda x, i: (i == 0) | (x != F.get(made, i - 1)))


def show_notes(segments: DataFrame, key: str, seg: str = "seg") -> DataFrame:
    """key, summary, bullets, chapters, titles, keywords of segments (key, seg from 0, s_start, s_end, text)."""
    sizes = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    weights = settled(text.idf(text.postings(text.term_counts(segments, [key, seg]), key, seg), sizes, key), "weights")
    listed = lambda item, order, name: F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("x")))), lambda s: s["x"]).alias(name)
    words = text.keywords(weights, key, KEYWORDS).groupBy(key).agg(listed(F.col("term"), "rank", "keywords"))
    ranked = text.ranked_segments(text.segment_scores(segments, weights, key, seg), key, seg).where(F.col("rank") <= BULLETS).join(segments.select(key, seg, "text"), [key, seg])
    short = F.collect_list(F.when(F.col("rank") <= SUMMARY, F.struct(seg, F.trim("text").alias("t"))))
    points = ranked.withColumn("b", text.clip(F.col("text"), 240)).groupBy(key).agg(listed(F.col("b"), seg, "bullets"), F.transform(F.array_sort(short), lambda s: s["t"]).alias("s"))
    parts = chapters(segments, weights, key, seg).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "title"))).alias("chapters"))
    rows = sizes.select(key).join(points, key, "left").join(words, key, "left").join(parts, key, "left")
    none = F.array().cast("array<string>")
    keys = F.coalesce("keywords", none)
    return rows.select(key, text.clip(F.coalesce(F.array_join("s", " "), F.lit("")), 700).alias("summary"), F.coalesce("bullets", none).alias("bullets"), F.coalesce("chapters", F.array().cast(CHAPTERS)).alias("chapters"), titles(keys).alias("titles"), keys.alias("keywords"))


def sanitised_chapters(raw: DataFrame, marks: DataFrame, durations: DataFrame, key: str, least_gap: float = 45.0, most: int = 8) -> DataFrame:
    """key, start, title of raw chapters (key, title, start as seconds or a clock string).

    Titles are cleaned; chapters without one, or beyond 0 to duration, go. Starts snap to the nearest
    mark (key, t), those within least_gap of the last kept one go, the first moves to the first
    mark, and `most` stay. durations: key, duration.
    """
    rows = raw.select(key, text.clean_title(F.col("title")).alias("title"), parse_clock(F.col("start").cast("string")).alias("at")).join(durations, key)
    rows = rows.where((F.col("title") != "") & F.col("at").between(0.0, F.col("duration"))).select(key, "title", "at")
    near = nearest(rows, marks, key, "at", "t").select(key, F.coalesce("nearest", "at").alias("start"), "at", "title")
    kept = thin(near.withColumn("o", F.struct("at", "title")), key, "start", least_gap, ["o", "title"])
    first = marks.groupBy(key).agg(F.min("t").alias("t0"))
    order = Window.partitionBy(key).orderBy("start", "o")
    kept = kept.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(most, 1)).join(first, key, "left")
    return kept.select(key, F.when(F.col("k") == 1, F.coalesce("t0", "start")).otherwise(F.col("start")).alias("start"), "title")


def map_prompt(index: Column, total: Column, start: Column, end: Column, body: Column) -> Column:
    """What asks a model for the digest of one chunk (index from 0)."""
    head = F.concat(F.lit("Part "), (index + 1).cast("string"), F.lit(" of "), total.cast("string"), F.lit(" of a transcript, from "), timecode(start), F.lit(" to "), timecode(end))
    ask = 'Digest this part alone. Answer with one JSON object {"summary": text, "bullets": [2 to 5 sentences], "topics": [2 to 5 labels]} and nothing else; tell only what was said.'
    return F.concat(head, F.lit(".\n\n"), F.trim(body), F.lit(f"\n\n{ask}"))


def candidates(segments: DataFrame, key: str, seg: str = "seg", most: int = 80) -> DataFrame:
    """key, candidates: 'start | first words' lines of every ceil(n / most)-th segment."""
    from .transcript import stride_sample

    lead = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 12), " ")
    rows = stride_sample(segments, key, seg, most).withColumn("line", F.concat(F.format_string("%.1f | ", "s_start"), lead)).where(lead != "")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seg, "line"))), lambda x: x["line"]), "\n").alias("candidates"))


def reduce_prompt(digests: Column, language: Column, duration: Column, first: Column, lines: Column, most: int = 8) -> Column:
    """What asks a model for show notes from digests, with the chapter starts that it may use."""
    tongue = F.when(F.trim(F.coalesce(language, F.lit(""))) == "", "the language of the transcript").otherwise(F.trim(language))
    ask = f'Write show notes. Answer with one JSON object {{"summary": text, "bullets": [3 to 7 sentences], "chapters": [{{"title": text, "start": seconds}}], "titles": [3 to 5], "keywords": [5 to 10]}} and nothing else. At most {most} chapters, in time order, with starts from the list alone.'
    return F.concat(F.lit("Language: "), tongue, F.lit(". Duration: "), timecode(duration), F.lit(". First chapter at "), F.format_string("%.1f", first), F.lit(".\n\nMATERIAL\n"), F.trim(digests), F.lit("\n\nCHAPTER STARTS\n"), F.trim(lines), F.lit(f"\n\n{ask}"))


def generated(chunks: DataFrame, complete: Callable[[str], str], key: str) -> DataFrame:
    """key, answer, failed of chunks (key, chunk, prompt): digests by a completer, then one answer from them.

    A failed chunk is left out; where all fail, or the last call does, the answer is null.
    """
    told = completed(chunks, complete, key, "chunk", "prompt")
    asked = told.where(F.size("digests") > 0).select(key, F.lit(0).alias("chunk"), F.array_join("digests", "\n").alias("prompt"))
    answers = completed(asked, complete, key, "chunk", "prompt").select(key, F.get("digests", F.lit(0)).alias("answer"))
    return told.select(key, "failed").join(answers, key, "left").select(key, "answer", "failed")


def suggested(generated_notes: DataFrame, extractive: DataFrame, key: str) -> DataFrame:
    """Notes by a model where it gave a usable JSON object (column notes, a struct), else the extractive ones."""
    names = [c for c in extractive.columns if c != key]
    rows = extractive.join(generated_notes.select(key, "notes"), key, "left")
    return rows.select(key, *[F.coalesce(F.col(f"notes.{c}"), F.col(c)).alias(c) for c in names], F.col("notes").isNotNull().alias("by_model"))
