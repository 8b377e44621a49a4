"""Queries over transcripts, intervals and cut lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cuts, folds, intervals, notes, text, transcript
from ..sources import readers
from ..sources.storage import settled
from ..sources.tables import segments, table, turns, words
from . import sql

OWNER, SEG = "conv_id", "seg"


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _sizes(spark, d):
    return segments(spark, d).groupBy(OWNER).agg(F.count(F.lit(1)).alias("n"))


def _terms(spark, d):
    return text.term_counts(segments(spark, d), [OWNER, SEG])


def _posts(spark, d):
    return text.postings(_terms(spark, d), OWNER, SEG)


def _weights(spark, d):
    return text.idf(_posts(spark, d), _sizes(spark, d), OWNER)


def term_counts(spark, d):
    return text.term_counts(table(spark, d, "documents"), ["doc_id"])


def idf_smoothed(spark, d):
    return _r(_weights(spark, d).select(OWNER, "term", "df", "idf"), "idf")


def keywords_topk(spark, d):
    return _r(text.keywords(_weights(spark, d), OWNER).select(OWNER, "rank", "term", "score"), "score")


def episode_titles(spark, d):
    """Title candidates from a conversation's first keywords."""
    kw = text.keywords(_weights(spark, d), OWNER, 3)
    rows = kw.groupBy(OWNER).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: text.title_case(x["term"])).alias("t"))
    return rows.select(OWNER, text.join_terms(F.col("t")).alias("title"))


def _scores(spark, d):
    return text.segment_scores(segments(spark, d), _weights(spark, d), OWNER, SEG)


def segment_rank(spark, d):
    return _r(text.ranked_segments(_scores(spark, d), OWNER, SEG), "score")


def extractive_summary(spark, d):
    """The three best segments in time order, clipped."""
    best = text.ranked_segments(_scores(spark, d), OWNER, SEG).where("rank <= 3").join(segments(spark, d), [OWNER, SEG])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(SEG, "text"))), lambda x: F.trim(x["text"])), " ")
    return best.groupBy(OWNER).agg(joined.alias("s")).select(OWNER, text.clip(F.col("s"), 240).alias("summary"))


def _sims(spark, d):
    return text.gap_similarity(_posts(spark, d), _sizes(spark, d), OWNER, SEG, 2)


def texttiling_similarity(spark, d):
    return _r(_sims(spark, d), "sim")


def texttiling_depth(spark, d):
    return _r(text.depths(_sims(spark, d), OWNER).select(OWNER, "gap", "depth"), "depth")


def depth_cutoff(spark, d):
    return _r(text.depth_cutoff(text.depths(_sims(spark, d), OWNER), OWNER).where("cutoff < 1e300"), "cutoff")


def chapters_greedy(spark, d):
    """Chapter starts: deepest gaps first, each two minutes from those taken."""
    deep = text.depths(_sims(spark, d), OWNER).where("depth > 0").select(OWNER, F.round("depth", 6).alias("depth"), (F.col("gap") * 60.0).alias("start"))
    return folds.greedy_far(deep, OWNER, "depth", "start", 120.0, 4)


def min_gap_thin(spark, d):
    rows = segments(spark, d).select(OWNER, "s_start")
    return folds.thin(rows, OWNER, "s_start", 150.0, [])


def words_to_speakers(spark, d):
    return intervals.word_speakers(words(spark, d), turns(spark, d), OWNER).select(OWNER, "word", "speaker")


def segment_dominant_speaker(spark, d):
    spoken = intervals.word_speakers(words(spark, d), turns(spark, d), OWNER)
    return intervals.dominant_speakers(segments(spark, d), spoken, OWNER)


def hop_owner(spark, d):
    hops = segments(spark, d).groupBy(OWNER).agg(F.max("s_end").alias("e")).select(OWNER, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("e") / 5))).alias("hop"))
    return intervals.hop_owners(hops, turns(spark, d), OWNER, 5.0)


def nearest_boundary(spark, d):
    points = turns(spark, d).select(OWNER, "ord", F.col("t_end").alias("at"))
    return intervals.nearest(points, segments(spark, d).select(OWNER, "s_start"), OWNER, "at", "s_start")


def talk_time(spark, d):
    return _r(intervals.talk_time(turns(spark, d), OWNER), "seconds")


def silence_outside_turns(spark, d):
    """Segments that no turn of speaker 1 overlaps."""
    other = turns(spark, d).where("speaker = 1")
    return intervals.drop_overlapping(segments(spark, d), other, OWNER, "s_start", "s_end", "t_start", "t_end", [OWNER, SEG]).select(OWNER, SEG)


def _gaps(spark, d):
    """Silences between segments: 20 s a turn; music over every fifth, a protected time in some."""
    s = segments(spark, d)
    silences = s.select(OWNER, F.col("s_end").alias("start"), (F.col("s_end") + 4.0 + F.col(SEG) * 2).alias("end"))
    music = s.where(f"{SEG} % 5 = 4").select(OWNER, F.col("s_end").alias("m_start"), (F.col("s_end") + 1).alias("m_end"))
    fixed = s.where(f"{SEG} % 3 = 2").select(OWNER, F.col("s_end").alias("t"))
    return silences, music, fixed


def silence_cut_plan(spark, d):
    silences, music, fixed = _gaps(spark, d)
    return _r(cuts.silence_cuts(silences, music, fixed, OWNER, 5.0, 0.6).drop("label"), "start", "end")


def _fillers(spark, d):
    """Words with every seventh a filler and 'you know' at some turns' beginnings."""
    pos, turn = F.col("word") % 100_000, F.floor(F.col("word") / 100_000)
    said = F.when((pos == 0) & (turn % 2 == 0), "You").when((pos == 1) & (turn % 2 == 0), "know,").when(pos % 7 == 3, "Um,").when(pos % 11 == 5, "like").otherwise(F.col("text"))
    _, music, _ = _gaps(spark, d)
    early = music.withColumns({"m_start": F.col("m_start") - 39, "m_end": F.col("m_end") - 39})
    return words(spark, d).withColumn("text", said), early


def filler_cut_plan(spark, d):
    said, music = _fillers(spark, d)
    return _r(cuts.filler_cuts(said, music, OWNER, aggressive=True, confidence=0.5), "start", "end")


def _plan(spark, d):
    silences, music, fixed = _gaps(spark, d)
    said, early = _fillers(spark, d)
    both = cuts.silence_cuts(silences, music, fixed, OWNER, 5.0, 0.6).unionByName(cuts.filler_cuts(said, early, OWNER, confidence=0.5))
    return cuts.merge_cuts(_r(both, "start", "end").withColumn("accepted", F.col("start") % 7 > 1), OWNER, 2.0)


def cut_merge(spark, d):
    return _r(_plan(spark, d).drop("label"), "start", "end")


def edl_complement(spark, d):
    durations = segments(spark, d).groupBy(OWNER).agg(F.max("s_end").alias("duration"))
    return _r(cuts.edit_list(_plan(spark, d), durations, OWNER), "start", "end")


def removed_seconds(spark, d):
    return _r(cuts.removed_seconds(_plan(spark, d), OWNER), "removed", digits=5)


def derive_segments(spark, d):
    return transcript.derive_segments(words(spark, d), OWNER)


def srt_export(spark, d):
    rows = segments(spark, d).select(OWNER, SEG, F.col("s_start").alias("start"), F.col("s_end").alias("end"), "text")
    return transcript.srt(rows, OWNER)


def vtt_export(spark, d):
    rows = segments(spark, d).select(OWNER, SEG, F.col("s_start").alias("start"), F.col("s_end").alias("end"), "text")
    return transcript.vtt(rows, OWNER)


def plain_export(spark, d):
    return transcript.plain(segments(spark, d), OWNER)


def caption_lines(spark, d):
    rows = words(spark, d).where("text <> ''")
    return folds.caption_lines(rows, OWNER).select(OWNER, "word", "line")


def caption_cues(spark, d):
    return _r(transcript.caption_cues(words(spark, d).where("text <> ''"), OWNER).select(OWNER, "word", "start", "end"), "start", "end")


def chunk_overlap(spark, d):
    rows = segments(spark, d).select(OWNER, SEG, F.octet_length("text").alias("size"))
    return folds.greedy_chunks(rows, OWNER, SEG, "size", 600, 0.25)


def stride_sample(spark, d):
    return transcript.stride_sample(segments(spark, d), OWNER, SEG, 3).select(OWNER, SEG)


def adjacent_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").withColumn("o", F.struct("ts", "event_id"))
    return transcript.drop_adjacent_repeats(rows, "user_id", "o", "event_type").select("user_id", "event_id", "event_type")


def dense_speaker_ids(spark, d):
    rows = table(spark, d, "conversations").select(OWNER, "turn", "role")
    return transcript.dense_ids(rows, OWNER, "role", ["turn"]).select(OWNER, "turn", "role", F.col("id").cast("long").alias("id"))


def parse_clock(spark, d):
    k = F.col("event_id")
    clock = F.when(k % 5 == 0, F.format_string("%d.5s", k % 900)).when(k % 5 == 1, F.format_string("%d:%02d", k % 60, k % 59)).when(k % 5 == 2, F.format_string("%d:%02d:%02d,25", k % 3, k % 60, k % 59)).when(k % 5 == 3, "1:2:3:4").otherwise("soon")
    return table(spark, d, "events").select("event_id", F.round(scalars.parse_clock(clock), 6).alias("seconds"))


def clock_formats(spark, d):
    s = F.col("value") * 37.77
    return table(spark, d, "events").select("event_id", scalars.srt_time(s).alias("srt"), scalars.ass_time(s).alias("ass"), scalars.timecode(s).alias("code"))


def text_escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", scalars.escape_html(t).alias("html"), scalars.file_stem(t).alias("stem"), scalars.estimated_tokens(t).alias("tokens"), scalars.canonical_id(F.col("source")).alias("source"))


def colours(spark, d):
    c = F.when(F.col("event_id") % 4 == 0, "red").otherwise(F.concat(F.lit("#"), F.lpad(F.hex((F.col("event_id") * 7919) % 16777216), 6, "0")))
    return table(spark, d, "events").select("event_id", scalars.ass_colour(c).alias("ass"), scalars.rgb(c).alias("rgb"))


def names_and_types(spark, d):
    path = F.concat(F.lit("/in/"), F.col("p_name"), F.element_at(F.array(*map(F.lit, (".WAV", ".png", ".m4b", ".txt"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", scalars.output_name(F.col("path"), F.lit("{name}_out"), "wav").alias("output"), scalars.mime(F.col("path")).alias("mime"), readers.output_format(F.col("path")).alias("format"))


def parse_diarization(spark, d):
    t = turns(spark, d)
    line = F.when(F.col("ord") == 5, "progress: 50%").otherwise(F.concat(F.format_string("%.2f -- %.2f speaker_%02d", F.col("t_start") + 20, F.col("t_end") + 20, (2 - F.col("speaker")) * 3)))
    got = readers.diarization_turns(t.select(OWNER, "ord", line.alias("value")), OWNER, order="ord")
    return got.select(OWNER, "start", "end", "label", F.col("speaker").cast("long").alias("speaker"))


def rttm_turns(spark, d):
    t = turns(spark, d)
    line = F.format_string("SPEAKER %d 1 %.2f %.2f <NA> <NA> s%d <NA> <NA>", OWNER, F.col("t_start") + 20, F.col("t_end") - F.col("t_start"), "speaker")
    return _r(readers.rttm_turns(t.select(line.alias("value"))), "start", "end", digits=4)


def asr_words(spark, d):
    """Words of recogniser JSON made from conversations and read again."""
    w = words(spark, d)
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    entry = F.struct(F.concat(F.lit(" "), F.col("text")).alias("text"), F.struct(ms("start").alias("from"), ms("end").alias("to")).alias("offsets"), F.array(F.struct(F.lit("[_TT_1]").alias("text"), F.lit(0.1).alias("p")), F.struct(F.col("text").alias("text"), F.col("confidence").alias("p"))).alias("tokens"))
    docs = w.groupBy(OWNER).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", entry.alias("e")))), lambda x: x["e"]).alias("transcription"))
    body = docs.select(OWNER, F.to_json(F.struct(F.struct(F.lit("en").alias("language")).alias("result"), "transcription")).alias("body"))
    return _r(readers.asr_words(body, OWNER, "body").withColumn("word", F.col("word").cast("long")), "confidence")


def chapter_text(spark, d):
    s = segments(spark, d)
    return readers.chapter_metadata(s.select(OWNER, F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.concat(F.lit("a=b; #"), SEG).alias("title")), OWNER)


def json_repair(spark, d):
    """The first JSON object in a noisy answer."""
    body = F.concat(F.lit('Sure: {"a": "}'), F.col("turn"), F.lit('", "b": {"c": 1}} and {}'))
    return table(spark, d, "conversations").select(OWNER, "turn", text.first_json(body).alias("json"))


def clean_titles(spark, d):
    t = F.concat(F.lit('  "Chapter '), F.col("turn"), F.lit(": "), F.col("role"), F.lit('" '))
    items = F.array(F.concat(F.lit("- "), F.col("role")), F.col("role"), F.lit(" "), F.concat(F.lit("* "), F.col("role"), F.lit("!")))
    return table(spark, d, "conversations").select(OWNER, "turn", text.clean_title(t).alias("title"), F.array_join(text.clean_list(items), "|").alias("items"))


def note_chapters(spark, d):
    """Chapters of conversations with titles."""
    return notes.chapters(segments(spark, d), settled(_posts(spark, d), "postings"), OWNER)


def show_notes(spark, d):
    """Show notes of conversations, lists joined by bars."""
    rows = notes.show_notes(segments(spark, d), OWNER)
    joined = {c: F.array_join(c, " | ") for c in ("bullets", "titles", "keywords")}
    return rows.select(OWNER, "summary", *[v.alias(c) for c, v in joined.items()], F.array_join(F.transform("chapters", lambda c: F.concat(F.format_string("%.1f ", c["start"]), c["title"])), " | ").alias("chapters"))


def sanitised_chapters(spark, d):
    """Raw chapters a turn, in seconds or as clocks, snapped to turns and thinned."""
    s = segments(spark, d)
    k = F.col(SEG)
    at = F.when(k % 3 == 0, F.format_string("%.1f", F.col("s_start") + 7)).when(k % 3 == 1, F.concat(F.floor(F.col("s_start") / 60).cast("string"), F.lit(":20"))).otherwise("later")
    raw = s.select(OWNER, F.when(k % 7 == 6, ' "" ').otherwise(F.concat(F.lit("Chapter "), k, F.lit(": part "), k)).alias("title"), at.alias("start"))
    marks, durations = s.select(OWNER, F.col("s_start").alias("t")), s.groupBy(OWNER).agg(F.max("s_end").alias("duration"))
    return notes.sanitised_chapters(raw, marks, durations, OWNER, 100.0, 3)


def clip_ranges(spark, d):
    """Clips around turns that hold a sample."""
    s = segments(spark, d)
    clips = s.select(OWNER, SEG, (F.col("s_start") - 5).alias("start"), F.when(F.col(SEG) % 3 == 0, F.col("s_start") - 9).otherwise(F.col("s_start") + 4).alias("end"))
    return cuts.valid_clips(clips, s.groupBy(OWNER).agg((F.max("s_end") - 60).alias("duration")), OWNER, 10.0).select(OWNER, SEG)


QUERIES = {f.__name__: f for f in (note_chapters, show_notes, sanitised_chapters, clip_ranges, term_counts, idf_smoothed, keywords_topk, episode_titles, segment_rank, extractive_summary, texttiling_similarity, texttiling_depth, depth_cutoff, chapters_greedy, min_gap_thin, words_to_speakers, segment_dominant_speaker, hop_owner, nearest_boundary, talk_time, silence_outside_turns, silence_cut_plan, filler_cut_plan, cut_merge, edl_complement, removed_seconds, derive_segments, srt_export, vtt_export, plain_export, caption_lines, caption_cues, chunk_overlap, stride_sample, adjacent_dedup, dense_speaker_ids, parse_clock, clock_formats, text_escapes, colours, names_and_types, parse_diarization, rttm_turns, asr_words, chapter_text, json_repair, clean_titles)}

_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"


def _terms_sql(keys: str, source: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN strlen(t) > 3 AND t LIKE '%s' AND NOT t LIKE '%ss' AND NOT t LIKE '%us' AND NOT t LIKE '%is' THEN t[:-2] ELSE t END AS term, count(*) AS tf
    FROM (SELECT {keys}, replace(unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}'']+')), '''', '') AS t FROM {source}) WHERE strlen(t) >= 3 AND NOT regexp_full_match(t, '\\p{{N}}+') AND t NOT IN {_STOP} GROUP BY ALL)"""


_TERMS = f"{sql.SEGMENTS}, terms AS {_terms_sql('conv_id, seg', 'segments')}, sizes AS (SELECT conv_id, count(*) AS n FROM segments GROUP BY 1), weights AS (SELECT conv_id, term, count(*) AS df, any_value(n) AS n, ln(1 + any_value(n) / count(*)) AS idf FROM terms JOIN sizes USING (conv_id) GROUP BY 1, 2)"
_KEYWORDS = _TERMS + ", kw AS (SELECT conv_id, term, score, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, term) AS rank FROM (SELECT conv_id, term, sum(tf * idf) AS score FROM terms JOIN weights USING (conv_id, term) WHERE n < 10 OR df >= 2 GROUP BY 1, 2))"
_RANKED = _TERMS + """, mass AS (SELECT conv_id, seg, sum(tf * idf) / sqrt(count(*)) AS mass FROM terms JOIN weights USING (conv_id, term) GROUP BY 1, 2),
scores AS (SELECT s.conv_id, s.seg, s.text, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 6 THEN 0 ELSE coalesce(mass, 0) END AS score FROM segments s LEFT JOIN mass USING (conv_id, seg)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, seg) AS rank FROM scores WHERE score > 0)"""
_SIMS = _TERMS + """, sized AS (SELECT conv_id, n, greatest(least(2, n // 3), 1) AS w FROM sizes WHERE n >= 2 * greatest(least(2, n // 3), 1) + 1), every AS (SELECT conv_id, w, unnest(range(w, n - w + 1)) AS gap FROM sized),
sides AS (SELECT e.conv_id, gap, term, coalesce(sum(tf) FILTER (seg < gap), 0) AS a, coalesce(sum(tf) FILTER (seg >= gap), 0) AS b FROM every e JOIN terms t ON t.conv_id = e.conv_id AND seg >= gap - w AND seg < gap + w GROUP BY 1, 2, 3),
sims AS (SELECT e.conv_id, e.gap, round(coalesce(s.sim, 0), 9) AS sim FROM every e LEFT JOIN (SELECT conv_id, gap, CASE WHEN sum(a * a) * sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS sim FROM sides GROUP BY 1, 2) s USING (conv_id, gap))"""
_DEPTHS = _SIMS + """, curve AS (SELECT conv_id, list(sim ORDER BY gap) AS v, list(gap ORDER BY gap) AS g FROM sims GROUP BY 1), flat AS (SELECT conv_id, v, unnest(g) AS gap, unnest(range(1, len(g) + 1)) AS i FROM curve),
climb AS (SELECT conv_id, gap, v, i, coalesce(list_max(list_filter(range(2, i + 1), lambda j: v[j - 1] < v[j])), 1) AS l, coalesce(list_min(list_filter(range(i, len(v)), lambda j: v[j + 1] < v[j])), len(v)) AS r FROM flat),
depths AS (SELECT conv_id, gap, CASE WHEN (i = 1 OR v[i - 1] >= v[i]) AND (i = len(v) OR v[i + 1] >= v[i]) THEN v[l] - v[i] + v[r] - v[i] ELSE 0 END AS depth FROM climb)"""
_SPOKEN = sql.WORDS + ", " + sql.TURNS + """, near AS (SELECT w.conv_id, w.word, t.speaker, t.ord, greatest(least(w."end", t_end) - greatest(w."start", t_start), 0) AS o, greatest(t_start - w."end", w."start" - t_end, 0) AS g FROM words w JOIN turns t ON t.conv_id = w.conv_id AND t_start <= w."end" + 2.0::DOUBLE AND t_end >= w."start" - 2.0::DOUBLE),
picked AS (SELECT conv_id, word, speaker, row_number() OVER (PARTITION BY conv_id, word ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE g END, ord) AS r FROM near),
spoken AS (SELECT w.*, p.speaker FROM words w LEFT JOIN picked p ON p.conv_id = w.conv_id AND p.word = w.word AND r = 1)"""
_SILENCE = sql.SEGMENTS + """, scuts AS (SELECT conv_id, s_end + 0.3::DOUBLE AS "start", s_end + 4 + seg * 2 - 0.3::DOUBLE AS "end", 'silence' AS kind, true AS accepted FROM segments WHERE 4 + seg * 2 >= 5 AND seg % 5 <> 4 AND seg % 3 <> 2)"""
_SAID = sql.WORDS + """, said AS (SELECT conv_id, word, "start", "end", confidence, lower(regexp_replace(trim(CASE WHEN word % 100000 = 0 AND word // 100000 % 2 = 0 THEN 'You' WHEN word % 100000 = 1 AND word // 100000 % 2 = 0 THEN 'know,' WHEN word % 100000 % 7 = 3 THEN 'Um,' WHEN word % 100000 % 11 = 5 THEN 'like' ELSE text END), '^[^\\p{L}\\p{N}'']+|[^\\p{L}\\p{N}'']+$', '', 'g')) AS t FROM words),
nexts AS (SELECT *, lead(t) OVER w AS nt, lead("end") OVER w AS ne, lead(confidence) OVER w AS nc FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY word)), """ + sql.SEGMENTS


def _fillers_sql(aggressive: bool) -> str:
    two = "(t = 'you' AND coalesce(nt, '') = 'know')" if aggressive else "false"
    one = "t IN ('um', 'uh', 'erm', 'hmm', 'uhm', 'mm'" + (", 'like')" if aggressive else ")")
    return f"""fcuts AS (SELECT * FROM (SELECT conv_id, greatest("start" - 0.04::DOUBLE, 0) AS "start", CASE WHEN {two} THEN ne ELSE "end" END + 0.04::DOUBLE AS "end", 'filler' AS kind, CASE WHEN {two} THEN 'you know' ELSE t END AS label, true AS accepted FROM nexts
    WHERE ({two} OR {one}) AND CASE WHEN {two} THEN least(confidence, nc) ELSE confidence END >= 0.5) c WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.conv_id = c.conv_id AND seg % 5 = 4 AND c."start" < s_end - 38 AND s_end - 39 < c."end"))"""


_PLAN = f"""{_SAID}, {_fillers_sql(False)}, {_SILENCE[len(sql.SEGMENTS) + 2:]}, every AS (SELECT conv_id, round("start", 6) AS "start", round("end", 6) AS "end", kind, round("start", 6) % 7 > 1 AS accepted FROM (SELECT conv_id, "start", "end", kind FROM scuts UNION ALL SELECT conv_id, "start", "end", kind FROM fcuts)),
far AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM every), grp AS (SELECT *, sum(CASE WHEN f IS NULL OR "start" > f + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM far),
plan AS (SELECT conv_id, min("start") AS "start", max("end") AS "end", bool_and(accepted) AS accepted, CASE WHEN bool_or(kind = 'silence') THEN 'silence' ELSE 'filler' END AS kind FROM grp GROUP BY conv_id, g)"""
_CLOCK = "lpad(CAST({h} AS VARCHAR), {w}, '0')"


def _hms(ms: str, mark: str) -> str:
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '{mark}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


_MS = lambda c: f"CAST(floor({c} * 1000 + 0.5) AS BIGINT)"

ORACLES = {
    "clip_ranges": f"""WITH {sql.SEGMENTS}, c AS (SELECT conv_id, seg, s_start - 5 AS s, CASE WHEN seg % 3 = 0 THEN s_start - 9 ELSE s_start + 4 END AS e, max(s_end) OVER (PARTITION BY conv_id) - 60 AS d FROM segments)
        SELECT conv_id, seg FROM c WHERE e > s AND floor(least(greatest(e, 0), d) * 10 + 0.5) > floor(least(greatest(s, 0), d) * 10 + 0.5)""",
    "sanitised_chapters": f"""WITH RECURSIVE {sql.SEGMENTS}, r AS (SELECT conv_id, seg, CASE seg % 3 WHEN 0 THEN s_start + 7 WHEN 1 THEN CAST(floor(s_start / 60) * 60 + 20 AS DOUBLE) END AS "at", CASE WHEN seg % 7 <> 6 THEN 'part ' || seg END AS title, max(s_end) OVER (PARTITION BY conv_id) AS d, min(s_start) OVER (PARTITION BY conv_id) AS t0 FROM segments),
        n AS (SELECT r.conv_id, title, "at", t0, arg_min(s.s_start, (abs(s.s_start - "at"), s.s_start)) AS "start" FROM r JOIN segments s USING (conv_id) WHERE title IS NOT NULL AND "at" BETWEEN 0 AND d GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY "start", "at", title) AS k FROM n),
        f AS (SELECT conv_id, k, "start" AS last, true AS keep, "start", title, t0 FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, CASE WHEN o."start" - f.last >= 100 THEN o."start" ELSE f.last END, o."start" - f.last >= 100, o."start", o.title, o.t0 FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1),
        g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS i FROM f WHERE keep) SELECT conv_id, CASE WHEN i = 1 THEN t0 ELSE "start" END AS "start", title FROM g WHERE i <= 3""",
    "chunk_overlap": f"""WITH RECURSIVE {sql.SEGMENTS}, c AS (SELECT conv_id, list_concat([0], list(t ORDER BY seg)) AS p, count(*) AS n FROM (SELECT conv_id, seg, CAST(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY seg) AS BIGINT) AS t FROM segments) GROUP BY 1),
        f AS (SELECT conv_id, p, n, 0 AS chunk, CAST(0 AS BIGINT) AS s, greatest(list_max(list_concat([0], list_filter(range(1, n + 1), lambda e: p[e + 1] <= 600))), 1) AS e FROM c
        UNION ALL SELECT conv_id, p, n, chunk + 1, a, greatest(list_max(list_concat([0], list_filter(range(a + 1, n + 1), lambda x: p[x + 1] - p[a + 1] <= 600))), a + 1) FROM (SELECT *, list_min(list_filter(range(s + 1, e + 1), lambda j: p[e + 1] - p[j + 1] <= 150)) AS a FROM f WHERE e < n))
        SELECT conv_id, chunk, CAST(s AS INT) AS first, CAST(e - 1 AS INT) AS last FROM f""",
    "caption_cues": rf"""WITH RECURSIVE {sql.WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY "start", word) AS k FROM (SELECT conv_id, word, "start", "end", array_to_string(list_filter(regexp_split_to_array(translate(text, '{{}}\', '()/'), '\s+'), lambda w: w <> ''), ' ') AS text FROM words WHERE text <> '')),
        fold AS (SELECT conv_id, word, k, 0 AS line, 1 AS n, length(text) AS chars, "start", "end" FROM o WHERE k = 1
        UNION ALL SELECT o.conv_id, o.word, o.k, line + CAST(n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - f."end" > 0.7 AS INT), CASE WHEN n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - f."end" > 0.7 THEN 1 ELSE n + 1 END, CASE WHEN n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - f."end" > 0.7 THEN length(text) ELSE chars + 1 + length(text) END, o."start", o."end" FROM fold f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1),
        l AS (SELECT *, lead("start") OVER w AS nx, lead(line) OVER w AS nl FROM fold WINDOW w AS (PARTITION BY conv_id ORDER BY k))
        SELECT conv_id, word, round("start", 6) AS "start", round(greatest(CASE WHEN nl IS NULL OR nl <> line THEN greatest(least("end" + 0.15::DOUBLE, coalesce(nx, 1e9)), "end") ELSE nx END, "start" + 0.02::DOUBLE), 6) AS "end" FROM l""",
    "term_counts": f"SELECT * FROM {_terms_sql('doc_id', 'documents')}",
    "idf_smoothed": f"WITH {_TERMS} SELECT conv_id, term, df, round(idf, 6) AS idf FROM weights",
    "keywords_topk": f"WITH {_KEYWORDS} SELECT conv_id, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM kw WHERE rank <= 8",
    "episode_titles": f"WITH {_KEYWORDS}, t AS (SELECT conv_id, list(upper(term[1]) || term[2:] ORDER BY rank) AS t FROM kw WHERE rank <= 3 GROUP BY 1) SELECT conv_id, CASE len(t) WHEN 1 THEN t[1] WHEN 2 THEN t[1] || ' & ' || t[2] ELSE t[1] || ', ' || t[2] || ' & ' || t[3] END AS title FROM t",
    "segment_rank": f"WITH {_RANKED} SELECT conv_id, seg, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked",
    "extractive_summary": f"WITH {_RANKED}, s AS (SELECT conv_id, trim(string_agg(trim(text), ' ' ORDER BY seg)) AS s FROM ranked WHERE rank <= 3 GROUP BY 1) SELECT conv_id, CASE WHEN length(s) <= 240 THEN s WHEN contains(s[:240], ' ') THEN regexp_replace(regexp_extract(s[:240], '(?s)^(.*) [^ ]*$', 1), '[,;:]+$', '') || '…' ELSE s[:240] || '…' END AS summary FROM s",
    "texttiling_similarity": f"WITH {_SIMS} SELECT conv_id, gap, round(sim, 6) AS sim FROM sims",
    "texttiling_depth": f"WITH {_DEPTHS} SELECT conv_id, gap, round(depth, 6) AS depth FROM depths",
    "depth_cutoff": f"WITH {_DEPTHS} SELECT conv_id, round(avg(depth) - stddev_pop(depth) / 2, 6) AS cutoff FROM depths WHERE depth > 0 GROUP BY 1",
    "chapters_greedy": f"""WITH RECURSIVE {_DEPTHS}, cand AS (SELECT conv_id, gap * 60.0::DOUBLE AS t, row_number() OVER (PARTITION BY conv_id ORDER BY round(depth, 6) DESC, gap) AS k FROM depths WHERE depth > 0),
        fold AS (SELECT conv_id, 1 AS k, [t] AS kept FROM cand WHERE k = 1 UNION ALL SELECT f.conv_id, f.k + 1, CASE WHEN len(kept) < 4 AND len(list_filter(kept, lambda x: abs(x - c.t) < 120)) = 0 THEN list_append(kept, c.t) ELSE kept END FROM fold f JOIN cand c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
        SELECT conv_id, unnest(arg_max(kept, k)) AS "start" FROM fold GROUP BY conv_id""",
    "min_gap_thin": f"""WITH RECURSIVE {sql.SEGMENTS}, o AS (SELECT conv_id, s_start, row_number() OVER (PARTITION BY conv_id ORDER BY s_start) AS k FROM segments), fold AS (SELECT conv_id, k, s_start AS last, true AS keep, s_start FROM o WHERE k = 1
        UNION ALL SELECT f.conv_id, o.k, CASE WHEN o.s_start - f.last >= 150 THEN o.s_start ELSE f.last END, o.s_start - f.last >= 150, o.s_start FROM fold f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1) SELECT conv_id, s_start FROM fold WHERE keep""",
    "words_to_speakers": f"WITH {_SPOKEN} SELECT conv_id, word, speaker FROM spoken",
    "segment_dominant_speaker": f"""WITH {_SPOKEN}, {sql.SEGMENTS}, votes AS (SELECT s.conv_id, seg, speaker, sum(greatest(least("end", s_end) - greatest("start", s_start), 1e-3)) AS w FROM segments s JOIN spoken p ON p.conv_id = s.conv_id AND "start" <= s_end AND "end" >= s_start WHERE speaker IS NOT NULL GROUP BY 1, 2, 3),
        best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY round(w, 9) DESC, speaker) AS r FROM votes) SELECT s.conv_id, s.seg, speaker FROM segments s LEFT JOIN best b ON b.conv_id = s.conv_id AND b.seg = s.seg AND r = 1""",
    "hop_owner": f"WITH {sql.SEGMENTS}, {sql.TURNS}, hops AS (SELECT conv_id, unnest(range(0, CAST(floor(max(s_end) / 5) AS BIGINT) + 1)) AS hop FROM segments GROUP BY 1) SELECT h.conv_id, hop, arg_max(speaker, ord) AS speaker FROM hops h LEFT JOIN turns t ON t.conv_id = h.conv_id AND (hop + 0.5::DOUBLE) * 5 >= t_start AND (hop + 0.5::DOUBLE) * 5 < t_end GROUP BY 1, 2",
    "nearest_boundary": f"WITH {sql.SEGMENTS}, {sql.TURNS}, p AS (SELECT t.conv_id, ord, t_end AS \"at\", s_start AS nearest, row_number() OVER (PARTITION BY t.conv_id, ord ORDER BY abs(s_start - t_end), s_start) AS r FROM turns t JOIN segments s ON s.conv_id = t.conv_id) SELECT conv_id, ord, \"at\", nearest FROM p WHERE r = 1",
    "talk_time": f"WITH {sql.TURNS} SELECT conv_id, speaker, round(sum(greatest(t_end - t_start, 0)), 6) AS seconds FROM turns GROUP BY 1, 2",
    "silence_outside_turns": f"WITH {sql.SEGMENTS}, {sql.TURNS} SELECT conv_id, seg FROM segments s WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = s.conv_id AND speaker = 1 AND t_start < s_end AND s_start < t_end)",
    "silence_cut_plan": f"WITH {_SILENCE} SELECT conv_id, round(\"start\", 6) AS \"start\", round(\"end\", 6) AS \"end\", kind, accepted FROM scuts",
    "filler_cut_plan": f"WITH {_SAID}, {_fillers_sql(True)} SELECT conv_id, round(\"start\", 6) AS \"start\", round(\"end\", 6) AS \"end\", kind, label, accepted FROM fcuts",
    "cut_merge": f"WITH {_PLAN} SELECT conv_id, \"start\", \"end\", accepted, kind FROM plan",
    "edl_complement": f"""WITH {_PLAN}, dur AS (SELECT conv_id, max(s_end) AS duration FROM segments GROUP BY 1), gone AS (SELECT p.conv_id, least(greatest("start", 0), duration) AS s, least(greatest("end", 0), duration) AS e FROM plan p JOIN dur USING (conv_id) WHERE accepted AND least(greatest("end", 0), duration) > least(greatest("start", 0), duration)),
        kept AS (SELECT conv_id, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY s), 0) AS s, s AS e FROM gone UNION ALL SELECT d.conv_id, coalesce(max(e), 0), any_value(duration) FROM dur d LEFT JOIN gone g ON g.conv_id = d.conv_id GROUP BY 1)
        SELECT conv_id, round(s, 6) AS "start", round(e, 6) AS "end", false AS kept FROM gone UNION ALL SELECT conv_id, round(s, 6), round(e, 6), true FROM kept WHERE e > s""",
    "removed_seconds": f"WITH {_PLAN} SELECT conv_id, round(coalesce(sum(\"end\" - \"start\") FILTER (accepted), 0), 5) AS removed FROM plan GROUP BY 1",
    "derive_segments": f"""WITH {sql.WORDS}, e AS (SELECT *, CAST(coalesce(regexp_matches(rtrim(text), '[.!?]$') OR lead("start") OVER (PARTITION BY conv_id ORDER BY word) - "end" > 0.8, false) AS INT) AS b FROM words),
        g AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY conv_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e) SELECT conv_id, CAST(seg AS BIGINT) AS seg, arg_min("start", word) AS "start", arg_max("end", word) AS "end", string_agg(text, ' ' ORDER BY word) AS text FROM g GROUP BY 1, 2""",
    "srt_export": f"WITH {sql.SEGMENTS}, i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seg) AS i FROM segments) SELECT conv_id, string_agg(i || chr(10) || {_hms(_MS('s_start'), ',')} || ' --> ' || {_hms(_MS('s_end'), ',')} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY i) AS body FROM i GROUP BY 1",
    "vtt_export": f"WITH {sql.SEGMENTS} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_hms(_MS('s_start'), '.')} || ' --> ' || {_hms(_MS('s_end'), '.')} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY seg) AS body FROM segments GROUP BY 1",
    "plain_export": f"WITH {sql.SEGMENTS} SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY seg) AS body FROM segments GROUP BY 1",
    "caption_lines": f"""WITH RECURSIVE {sql.WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY "start", word) AS k FROM words WHERE text <> ''), fold AS (SELECT conv_id, word, k, 0 AS line, 1 AS n, length(text) AS chars, "end" AS e FROM o WHERE k = 1
        UNION ALL SELECT o.conv_id, o.word, o.k, line + CAST(n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - e > 0.7 AS INT), CASE WHEN n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - e > 0.7 THEN 1 ELSE n + 1 END, CASE WHEN n >= 6 OR chars + 1 + length(text) > 32 OR o."start" - e > 0.7 THEN length(text) ELSE chars + 1 + length(text) END, o."end" FROM fold f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
        SELECT conv_id, word, line FROM fold""",
    "stride_sample": f"WITH {sql.SEGMENTS} SELECT conv_id, seg FROM (SELECT conv_id, seg, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM segments) WHERE i % ceil(n / 3) = 0",
    "adjacent_dedup": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE l IS NULL OR l <> event_type",
    "dense_speaker_ids": "WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS id FROM conversations GROUP BY 1, 2) SELECT conv_id, turn, role, id FROM conversations JOIN f USING (conv_id, role)",
    "parse_clock": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 900 + 0.5::DOUBLE WHEN 1 THEN event_id % 60 * 60.0::DOUBLE + event_id % 59 WHEN 2 THEN event_id % 3 * 3600.0::DOUBLE + event_id % 60 * 60 + event_id % 59 + 0.25::DOUBLE END AS seconds FROM events",
    "clock_formats": f"""WITH t AS (SELECT event_id, greatest(value * 37.77::DOUBLE, 0) AS s FROM events), u AS (SELECT event_id, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS ms, CAST(floor(s * 100 + 0.5) AS BIGINT) AS cs, CAST(floor(s + 0.5) AS BIGINT) AS w FROM t)
        SELECT event_id, {_hms('ms', ',')} AS srt, (cs // 360000) || ':' || lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS ass,
        CASE WHEN w >= 3600 THEN (w // 3600) || ':' || lpad(CAST(w // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(w // 60 AS VARCHAR) END || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') AS code FROM u""",
    "text_escapes": """WITH t AS (SELECT doc_id, source, text AS t FROM documents) SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, regexp_replace(t, '[\\\\/:*?"<>|]', '_', 'g') AS stem, CAST(ceil(length(t) / 3.5) AS BIGINT) AS tokens, replace(lower(source), '_', '-') AS source FROM t""",
    "colours": "WITH t AS (SELECT event_id, event_id % 4 = 0 AS bad, (event_id * 7919) % 16777216 AS v FROM events) SELECT event_id, CASE WHEN NOT bad THEN '&H00' || printf('%02X%02X%02X', v % 256, v // 256 % 256, v // 65536) END AS ass, CASE WHEN NOT bad THEN CAST(v AS INT) END AS rgb FROM t",
    "names_and_types": "SELECT p_partkey, regexp_replace(p_name, '\\.[^.]*$', '') || '_out.wav' AS output, CASE p_partkey % 4 WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CASE p_partkey % 4 WHEN 0 THEN 'wav' WHEN 2 THEN 'audiobook' END AS format FROM part",
    "parse_diarization": f"WITH {sql.TURNS}, l AS (SELECT conv_id, t_start + 20 AS s, t_end + 20 AS e, 'speaker_' || lpad(CAST((2 - speaker) * 3 AS VARCHAR), 2, '0') AS label FROM turns WHERE ord <> 5), f AS (SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY min((s, e)), label) - 1 AS speaker FROM l GROUP BY 1, 2) SELECT conv_id, s AS \"start\", e AS \"end\", label, speaker FROM l JOIN f USING (conv_id, label)",
    "rttm_turns": f"WITH {sql.TURNS} SELECT CAST(conv_id AS VARCHAR) AS file, 's' || speaker AS label, round(t_start + 20, 4) AS \"start\", round(t_end + 20, 4) AS \"end\" FROM turns",
    "asr_words": f"WITH {sql.WORDS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY word) - 1 AS word, trim(text) AS text, CAST(floor(\"start\" * 1000 + 0.5) AS BIGINT) / 1000 AS \"start\", CAST(floor(\"end\" * 1000 + 0.5) AS BIGINT) / 1000 AS \"end\", round(confidence, 6) AS confidence FROM words WHERE trim(text) <> ''",
    "chapter_text": rf"WITH {sql.SEGMENTS} SELECT conv_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(s_start * 1000 AS BIGINT) || chr(10) || 'END=' || CAST(s_end * 1000 AS BIGINT) || chr(10) || 'title=a\=b\; \#' || seg || chr(10), '' ORDER BY s_start) AS body FROM segments GROUP BY 1",
    "json_repair": "SELECT conv_id, turn, '{\"a\": \"}' || turn || '\", \"b\": {\"c\": 1}}' AS json FROM conversations",
    "clean_titles": "SELECT conv_id, turn, role AS title, role || '|' || role || '!' AS items FROM conversations",
}
