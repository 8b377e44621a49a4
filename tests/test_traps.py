"""Rules that are easy to get wrong: ties, ranks, roundings, bounds and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import scalars, stats
from signalframe.operators import cuts, hops, intervals, islands, segmentation, spectral, text
from signalframe.plans import jobs
from signalframe.sources import readers


def one(df, column=None):
    return df.select(column if column is not None else df.columns[0]).first()[0]


def test_words_snap_up_to_two_seconds(spark):
    words = spark.createDataFrame([(1, 0, 12.0, 12.3), (1, 1, 12.2, 12.5), (1, 2, 7.5, 7.9), (1, 3, 5.0, 5.0), (2, 0, 0.0, 1.0)], "k long, word long, start double, end double")
    turns = spark.createDataFrame([(1, 0, 0.0, 10.0, 7), (1, 1, 4.0, 10.0, 8)], "k long, ord long, t_start double, t_end double, speaker int")
    got = {(r["k"], r["word"]): r["speaker"] for r in intervals.word_speakers(words, turns, "k").collect()}
    assert got == {(1, 0): 7, (1, 1): None, (1, 2): 7, (1, 3): 7, (2, 0): None}


def test_turns_that_end_early_fail(spark):
    bad = spark.createDataFrame([(1, "1.0 -- 0.5 a")], "k long, value string")
    with pytest.raises(Exception, match="ends before it starts"):
        readers.diarization_turns(bad, "k").collect()


def test_turn_lines(spark):
    lines = ["0.5 -- 1.0 b", "Started", "0.5 -- 1.0 a", "-1 -- 0 c", "1 -- 2 x extra", "1e0 -- 2 b", "1.0d -- 2 z", "3--4 q"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k long, i long, value string")
    got = sorted((r["start"], r["end"], r["label"], r["speaker"]) for r in readers.diarization_turns(df, "k", order="i").collect())
    assert got == [(-1.0, 0.0, "c", 0), (0.5, 1.0, "a", 2), (0.5, 1.0, "b", 1), (1.0, 2.0, "b", 1)]


def test_files_that_a_scan_takes(spark):
    names = ["a.WAVE", "b.oga", "c.opus", "d.webm", ".signalframe-watch-log.json", "e", "x/f.mkv", "own.wav", "seen.mp3", "grown.mp3"]
    files = spark.createDataFrame([(n, 1, 2) for n in names], "path string, size long, mtime_ms long")
    assert [r["path"] for r in jobs.targets(files).collect()] == ["a.WAVE", "b.oga", "grown.mp3", "own.wav", "seen.mp3", "x/f.mkv"]
    assert [r["path"] for r in jobs.targets(files, extensions=["OPUS"]).collect()] == ["c.opus"]
    log = spark.createDataFrame([("seen.mp3", 1, 2), ("grown.mp3", 0, 2)], files.schema)
    own = spark.createDataFrame([("own.wav",)], "path string")
    assert {r["path"] for r in jobs.candidates(files, log, own).collect()} == {"a.WAVE", "b.oga", "x/f.mkv", "grown.mp3"}


def test_output_paths(spark):
    files = spark.createDataFrame([("/in/a/b/c.mp3",), ("/in/d.wav",), ("/else/e.wav",)], "path string")
    flat = [r["output"] for r in jobs.outputs(files, "/in", "/out").collect()]
    assert flat == ["/out/c_mastered.wav", "/out/d_mastered.wav", "/out/e_mastered.wav"]
    assert [r["output"] for r in jobs.outputs(files, "/in", "/out", mirror=True).collect()] == ["/out/a/b/c_mastered.wav", "/out/d_mastered.wav", "/out/e_mastered.wav"]


def test_four_rank_rules(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 13)], "k long, v double")
    rank = lambda place: one(stats.order_statistic(df, ["k"], "v", place, "x"), "x")
    assert rank(stats.nearest_rank(0.1)) == 2.0  # round(11 * 0.1) = 1
    assert rank(stats.floor_rank(0.1)) == 2.0  # 12 // 10 = 1
    assert rank(stats.upper_middle) == 7.0
    assert rank(stats.nearest_rank(0.5)) == 7.0  # 5.5 goes up
    assert one(df.agg(F.median("v").alias("m"))) == 6.5


def test_order_statistics_of_uneven_values(spark):
    import random

    draw = random.Random(4)
    groups = {
        "outlier": [draw.gauss(0, 1) for _ in range(500)] + [1e18, -1e12],
        "ties": [3.0] * 400 + [4.0] * 3,
        "near": [1000 + k * 1e-9 for k in range(300)],
        "odd": [0.0, -0.0, float("inf"), float("-inf"), 1e-310, -5e-324, 2.0**60, 2.0**60 - 512],
        "one": [7.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "k string, v double")
    got = {r["k"]: r for r in stats.order_statistics(df, ["k"], "v", {"p10": stats.nearest_rank(0.1), "mid": stats.upper_middle, "last": lambda n: n - 1}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert (got[g]["p10"], got[g]["mid"], got[g]["last"]) == (vs[int((len(vs) - 1) * 0.1 + 0.5)], vs[len(vs) // 2], vs[-1]), g
    odd = {r["k"]: r["m"] for r in stats.averaging_median(df, ["k"], "v", "m").collect()}
    assert odd["one"] == 7.0 and odd["ties"] == 3.0


def test_halves_round_away_from_zero(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-2.5,)], "v double")
    assert [r[0] for r in df.select(stats.round_half_up(F.col("v"))).collect()] == [1.0, 2.0, 3.0, -1.0, -3.0]


def test_floors_of_silence_differ(spark):
    df = spark.createDataFrame([(0.0,)], "v double")
    got = df.select(scalars.dbfs(F.col("v")), scalars.lufs(F.col("v")), scalars.level_db(F.col("v")), scalars.meter_db(F.col("v"))).first()
    assert [round(x, 9) for x in got] == [-120.0, -120.0, -120.0, -140.0]


def test_correlation_is_not_centred(spark):
    df = spark.createDataFrame([(1.0, 1.1), (1.0, 0.9)], "l double, r double")
    assert df.agg(*stats.stereo(F.col("l"), F.col("r"))).first()["correlation"] > 0.99


def tone(hops, hop=480, hz=1000.0, rate=48_000, level=0.5):
    return [(1, i, level * math.sin(2 * math.pi * hz * i / rate)) for i in range(int(hops * hop))]


def test_a_short_last_hop_counts_only_where_asked(spark):
    df = spark.createDataFrame(tone(2.5), "signal_id long, n long, x double")
    assert sorted(r["hop"] for r in hops.hop_features(df, 480).collect()) == [0, 1]
    got = {r["hop"]: r["size"] for r in hops.hop_features(df, 480, partial=True).collect()}
    assert got == {0: 480, 1: 480, 2: 240}


def test_spectra_begin_with_zeros_before_the_signal(spark):
    x = np.array([v for _, _, v in tone(6)])
    frames = spectral.ring_frames(x, 480, 2048)
    assert len(frames) == 6
    for k, frame in enumerate(frames):
        seen = min(2048, 480 * (k + 1))
        assert not frame[: 2048 - seen].any() and np.array_equal(frame[2048 - seen :], x[480 * (k + 1) - seen : 480 * (k + 1)])
    df = spark.createDataFrame(tone(6), "signal_id long, n long, x double")
    want = spectral.frame_features(frames, 48_000.0)
    got = spectral.hop_spectra(df, 480, 2048, 48_000.0, block=2).orderBy("hop").collect()
    assert [r["hop"] for r in got] == list(range(6))
    for name in spectral.FEATURES:
        assert np.allclose([r[name] for r in got], want[name], rtol=1e-9, atol=1e-12), name


def test_ratios_are_over_all_hops(spark):
    # 100 hops of steady hiss (musical), 100 of pauses and words, 100 of silence; only gated ones are told apart.
    rows = [(1, h, -20.0, 0.5, 0.1, True) for h in range(100)]
    rows += [(1, 100 + h, -20.0 if h % 2 else -60.0, 0.05, 0.2, h % 2 == 1) for h in range(100)]
    rows += [(1, 200 + h, -80.0, 0.5, 0.1, False) for h in range(100)]
    marked = spark.createDataFrame(rows, "signal_id long, hop long, energy_db double, flatness double, zcr double, speech boolean")
    got = segmentation.ratios(marked).first()
    assert (got["speech_ratio"], got["music_ratio"]) == (pytest.approx(50 / 300), pytest.approx(100 / 300))


def test_hum_is_of_all_hops_and_ties_go_to_50_hz(spark):
    rows = [("tie", h, 8.0, 8.0, h % 2 == 0) for h in range(30)]
    # Speech hops alone would say 60 Hz: the mask has no part in it.
    rows += [("all", h, 9.0 if h < 20 else 1.0, 1.0 if h < 20 else 9.0, h >= 20) for h in range(30)]
    rows += [("few", h, 9.0, 1.0, True) for h in range(19)]
    df = spark.createDataFrame(rows, "signal_id string, hop long, hum50 double, hum60 double, speech boolean")
    got = {r["signal_id"]: (r["fundamental_hz"], r["stable"]) for r in segmentation.hum(df).collect()}
    assert got == {"tie": (50.0, True), "all": (50.0, True)}


def test_terms_of_a_text(spark):
    line = "Don't the cats' glass é éa été 2024 buses status dogs oxen it's"
    df = spark.createDataFrame([(1, line)], "k long, text string")
    got = {r["term"]: r["tf"] for r in text.term_counts(df, ["k"]).collect()}
    # Contractions lose their mark, so "dont" is a term and "its" a stopword; lengths are bytes, so "éa" is long enough and "é" isn't.
    assert got == {"dont": 1, "cat": 1, "glass": 1, "éa": 1, "été": 1, "buse": 1, "status": 1, "dog": 1, "oxen": 1}


def test_clipped_texts(spark):
    cases = [("short", 10, "short"), ("  padded  ", 6, "padded"), ("one two, three", 10, "one two…"), ("ééééé ffff", 7, "ééééé…"), ("unbroken", 3, "unb…"), ("a b;: c", 6, "a b…")]
    for value, most, want in cases:
        df = spark.createDataFrame([(value,)], "t string")
        assert one(df, text.clip(F.col("t"), most)) == want, value


def test_bounds_of_intervals_differ(spark):
    a = spark.createDataFrame([(1, 0.0, 1.0)], "k long, s double, e double")
    b = spark.createDataFrame([(1, 1.0, 2.0)], "k long, s2 double, e2 double")
    met = lambda closed: intervals.overlap_join(a, b, "k", "s", "e", "s2", "e2", closed).count()
    assert (met(False), met(True)) == (0, 1)
    # A hop's middle at a turn's end is outside of it, at its start inside.
    marks = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "k long, hop long")
    turns = spark.createDataFrame([(1, 0, 1.5, 2.5, 7)], "k long, ord long, t_start double, t_end double, speaker int")
    assert {r["hop"]: r["speaker"] for r in intervals.hop_owners(marks, turns, "k", 1.0).collect()} == {0: None, 1: 7, 2: None}
    # A protected time at a silence's end keeps it whole; music that only touches doesn't.
    silences = spark.createDataFrame([(1, 0.0, 4.0), (1, 10.0, 14.0), (1, 20.0, 24.0)], "k long, start double, end double")
    music = spark.createDataFrame([(1, 4.0, 5.0)], "k long, m_start double, m_end double")
    kept = spark.createDataFrame([(1, 14.0)], "k long, t double")
    cut = cuts.silence_cuts(silences, music, kept, "k", 1.0, 1.0)
    assert sorted(r["start"] for r in cut.collect()) == [0.5, 20.5]
    # Cuts that are exactly the slack apart are one.
    near = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.25, 2.0), (1, 2.5, 3.0)], "k long, start double, end double")
    got = islands.merge_intervals(near, "k", slack=0.25).select("start", "end").orderBy("start").collect()
    assert [tuple(r) for r in got] == [(0.0, 2.0), (2.5, 3.0)]
    # Words that only touch a segment vote, with a millisecond.
    segments = spark.createDataFrame([(1, 0, 1.0, 2.0)], "k long, seg long, s_start double, s_end double")
    words = spark.createDataFrame([(1, 0.0, 1.0, 3)], "k long, start double, end double, speaker int")
    assert intervals.dominant_speakers(segments, words, "k").first()["speaker"] == 3


def test_who_wins_ties(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 2.0, 9), (1, 1, 0.0, 2.0, 4)], "k long, ord long, t_start double, t_end double, speaker int")
    words = spark.createDataFrame([(1, 0, 0.5, 1.0)], "k long, word long, start double, end double")
    assert intervals.word_speakers(words, turns, "k").first()["speaker"] == 9  # the first turn
    marks = spark.createDataFrame([(1, 0)], "k long, hop long")
    assert intervals.hop_owners(marks, turns, "k", 1.0).first()["speaker"] == 4  # the last turn
    segments = spark.createDataFrame([(1, 0, 0.0, 2.0)], "k long, seg long, s_start double, s_end double")
    votes = spark.createDataFrame([(1, 0.0, 1.0, 9), (1, 1.0, 2.0, 4)], "k long, start double, end double, speaker int")
    assert intervals.dominant_speakers(segments, votes, "k").first()["speaker"] == 4  # the lower id
    points = spark.createDataFrame([(1, 5.0)], "k long, at double")
    near = spark.createDataFrame([(1, 4.0), (1, 6.0)], "k long, t double")
    assert intervals.nearest(points, near, "k", "at", "t").first()["nearest"] == 4.0  # the earlier mark
