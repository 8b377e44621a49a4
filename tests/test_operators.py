"""Operators that no registered query shows whole: multitrack, notes, profiles, catalogue, queues and files."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import bleedgate, chain, cuts, grouped, master, notes, recursive, speakers, spectral, text
from signalframe.plans import catalog, decide, jobs
from signalframe.sources import readers

RATE = 8000.0


def voice(seconds, seed, rate=RATE):
    n = int(seconds * rate)
    on = (np.arange(n) // int(0.3 * rate)) % 3 != seed % 3
    return master.coloured_noise(n, seed, rate=rate) * 0.1 * np.where(on, 1.0, 1e-3)


def test_bleed_is_gated_and_own_speech_is_not():
    a = voice(6, 1)
    bleed = bleedgate.shifted(a, 80, len(a)) * 0.1 + 6e-5 * master.coloured_noise(len(a), 9, rate=RATE)
    gain, told = bleedgate.gate_track(bleed, [a], RATE)
    assert gain[8000:40_000].min() <= -14 and told["source"] == 0 and abs(told["lag_ms"][0] - 10) < 1 and told["veto_ratio"] == 0 and told["active_ratio"] > 0.3
    own = bleed.copy()
    own[24_000:32_000] += master.coloured_noise(8000, 11, rate=RATE) * 0.1
    gain, told = bleedgate.gate_track(own, [a], RATE)
    assert gain[24_000:32_000].min() > -1e-9 and told["veto_ratio"] > 0
    assert bleedgate.gate_track(np.zeros(0), [a], RATE)[1]["source"] is None


def test_crossgate_of_sessions(spark):
    a = voice(2, 1)
    b = bleedgate.shifted(a, 80, len(a)) * 0.1
    rows = [(7, t, n, float(v)) for t, x in ((1, a), (2, b)) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "session long, track long, n long, x double")
    got = {r["track"]: r for r in bleedgate.crossgate_report(df, "session", RATE).collect()}
    assert got[2]["source"] == 1 and got[2]["max_reduction_db"] < -5 and got[1]["max_reduction_db"] > -1
    assert bleedgate.crossgate(df, "session", RATE).count() == len(rows)


def test_duck_goes_down_ahead_of_speech_and_comes_back():
    speech = np.zeros(400, bool)
    speech[150:200] = True
    gain, told = bleedgate.duck_gain(speech, 200, 80_000, RATE)
    assert np.allclose(gain[149 * 200 : 200 * 200].max(), -12, atol=3) and gain[0] == 0 and gain[-1] == 0 and told["max_reduction_db"] == -12
    assert np.abs(np.diff(gain)).max() <= 12 / (0.2 * RATE) + 1e-9


def test_bus_meets_its_target():
    x = np.stack([voice(4, 2), voice(4, 3)])
    y = bleedgate.bus(x, RATE, -20.0, -1.0)
    assert abs(chain.loudness(y, RATE)["integrated_lufs"] + 20) <= 0.5


def test_tracks_are_aligned_and_drift_is_repaired(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=24_000)
    b = bleedgate.shifted(a, 321, len(a))
    df = spark.createDataFrame([(1, n, float(x), float(y)) for n, (x, y) in enumerate(zip(a, b, strict=True))], "track long, n long, a double, b double")
    got = spectral.align_tracks(df, RATE, most_seconds=0.5, window_seconds=1.0, residual_seconds=0.05).first()
    assert abs(got["offset_seconds"] * RATE - 321) < 1 and abs(got["drift_ppm"]) < 50 and got["confidence"] > 0.3
    t = np.arange(4000)
    fast = np.sin(2 * np.pi * 0.01 * t * (1 - 2000e-6))
    rows = spark.createDataFrame([(1, int(n), float(v)) for n, v in enumerate(fast)], "track long, n long, x double")
    fixed = np.array([r["x"] for r in spectral.repair_drift(rows, spark.createDataFrame([(1, 2000.0)], "track long, ppm double")).orderBy("n").collect()])
    assert np.abs(fixed[50:3900] - np.sin(2 * np.pi * 0.01 * t)[50:3900]).max() < 1e-3


def test_joins_that_overlap_multiply(spark):
    """Short ranges: what an early join mixes is faded out by a later one."""
    x = np.random.default_rng(5).normal(size=60)
    ranges = [(0, 10), (20, 23), (30, 34), (40, 55)]
    out, fade = list(x[0:10]), 4
    for lo, hi in ranges[1:]:
        k = min(fade, hi - lo, 10 if lo == 20 else {30: 3, 40: 4}[lo])
        angle = (np.arange(k) + 0.5) / k * np.pi / 2
        tail = np.array(out[len(out) - k :]) * np.cos(angle) + x[lo : lo + k] * np.sin(angle)
        out = out[: len(out) - k] + list(tail) + list(x[lo + k : hi])
    samples = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(x)], "k long, n long, x double")
    edits = spark.createDataFrame([(1, float(a), float(b), True) for a, b in ranges] + [(1, 58.0, 99.0, False)], "k long, start double, end double, kept boolean")
    got = [r["x"] for r in cuts.render(samples, edits, "k", 1.0, 4.0).orderBy("n").collect()]
    assert np.allclose(got, out)


def test_groups_come_whole_and_in_order(spark):
    df = spark.createDataFrame([(k, n, float(n)) for k in (1, 2, None) for n in range(500)] + [(9, 0, 1.0)], "k long, n long, x double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        got = grouped.grouped_map(df, ["k"], ["n"], ["x"], lambda g: {"sizes": [g.num_rows], "fine": [bool((np.diff(g["n"].to_numpy()) == 1).all())]}, "sizes long, fine boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r["k"], r["sizes"], r["fine"]) for r in got), key=repr) == sorted([(1, 500, True), (2, 500, True), (None, 500, True), (9, 1, True)], key=repr)
    assert grouped.grouped_map(df.where("false"), ["k"], ["n"], ["x"], lambda g: {"s": [1]}, "s int").count() == 0


def test_segments_of_a_long_signal_give_the_whole(spark):
    x = np.random.default_rng(6).normal(size=3000)
    df = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(x)], "signal_id long, n long, x double")
    c = recursive.biquad("highpass", RATE, 200, 0.7071)
    got = np.array([r["x"] for r in recursive.segmented(df, lambda v: recursive.run_filter(v, c), 1000, 400).orderBy("n").collect()])
    assert len(got) == 3000 and np.abs(got - recursive.run_filter(x, c)).max() < 0.3 and np.sqrt(np.mean((got - recursive.run_filter(x, c)) ** 2)) < 0.02


def test_mastering_through_tables(spark):
    x = master.coloured_noise(96_000, 7) * 0.02
    df = spark.createDataFrame([("a", 0, n, float(v)) for n, v in enumerate(x)], "signal_id string, ch int, n long, x double")
    report = chain.analyze(df, 48_000.0)
    configured = decide.stages(report.withColumns({"dc": F.lit(0.0), "diarized": F.lit(False), "target_lufs": F.lit(-16.0), "ceiling_dbtp": F.lit(-1.0)}))
    one = chain.master(df, configured, 48_000.0).orderBy("n").collect()
    y = np.array([r["x"] for r in one])
    told = chain.master_report(df, configured, 48_000.0).first()
    assert len(y) == len(x) and abs(chain.loudness(y[None], 48_000.0)["integrated_lufs"] - told["after_lufs"]) < 1e-6
    assert abs(told["after_lufs"] + 16) <= 0.5 and told["on_target"] and told["after_peak_dbtp"] <= -0.99
    assert decide.off_target(spark.createDataFrame([("a", -18.0, -16.0), ("b", -16.2, -16.0)], "k string, after_lufs double, target_lufs double"), ["k"]).count() == 1
    modules = decide.module_report(configured.withColumns({"before_lufs": F.lit(-30.0), "after_lufs": F.lit(-16.0)}), ["signal_id"], 16).collect()
    assert [m["module"] for m in modules] == list(decide.MODULES) and modules[11]["settings"] == {"before_lufs": -30.0, "after_lufs": -16.0, "target_lufs": -16.0} and modules[13]["applied"]
    assert all(m["reason"] == "set" if m["applied"] else m["reason"] in m["detail"] for m in modules) and modules[0]["detail"] == "cutoff_hz 80.00"


def test_profiles_of_speakers(spark):
    x = np.concatenate([master.coloured_noise(48_000, 1) * 0.1, master.coloured_noise(48_000, 2) * 0.01])
    samples = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(x)], "k long, n long, x double")
    ms = recursive.k_hops(x, 480)
    hops = spark.createDataFrame([(1, h, float(v), None if h == 150 else int(h >= 100)) for h, v in enumerate(ms)], "k long, hop long, ms double, speaker int")
    got = {r["speaker"]: r for r in speakers.profiles(samples, hops, "k", 480, 48_000.0).collect()}
    assert set(got) == {0, 1} and abs(got[0]["median_lufs"] - got[1]["median_lufs"] - 20) < 1 and got[1]["hops"] == 99
    assert got[0]["bands"] and all(abs(b["gain_db"]) <= 6 for b in got[0]["bands"])


def test_notes_by_a_completer_and_without(spark):
    text = "the quick brown fox jumps over lazy dogs near rivers"
    rows = [(1, s, s * 30.0, s * 30.0 + 29, f"{text} topic{s // 4} topic{s // 4} subject") for s in range(12)] + [(2, 0, 0.0, 5.0, "")]
    segments = spark.createDataFrame(rows, "k long, seg long, s_start double, s_end double, text string")
    plain = {r["k"]: r for r in notes.show_notes(segments, "k").collect()}
    assert len(plain[1]["bullets"]) == 5 and plain[1]["chapters"][0]["start"] == 0.0 and 1 <= len(plain[1]["titles"]) <= 3
    assert plain[2]["summary"] == "" and plain[2]["keywords"] == [] and plain[2]["chapters"][0]["title"] == "Chapter 1"
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad"), (3, 0, "bad")], "k long, chunk int, prompt string")
    answers = {r["k"]: (r["answer"], r["failed"]) for r in notes.generated(chunks, lambda t: 1 / 0 if t == "bad" else f"<{t}>", "k").collect()}
    assert answers == {1: ("<<a>>", 1), 3: (None, 1)}
    base = notes.show_notes(segments, "k")
    kind = base.select(F.struct(*[c for c in base.columns if c != "k"])).schema[0].dataType.simpleString()
    by_model = spark.createDataFrame([(1, ("made", ["b"], [], ["t"], ["w"]))], f"k long, notes {kind}")
    both = {r["k"]: r for r in notes.suggested(by_model, base, "k").collect()}
    assert both[1]["summary"] == "made" and both[1]["by_model"] and not both[2]["by_model"]
    lines = notes.candidates(segments, "k", most=4).where("k = 1").first()["candidates"].split("\n")
    assert len(lines) == 4 and lines[1].startswith("90.0 | the quick")
    asked = segments.select(notes.map_prompt(F.lit(1), F.lit(4), F.lit(60.0), F.lit(120.0), F.lit(" body ")).alias("m"), notes.reduce_prompt(F.lit("d"), F.lit(" "), F.lit(3600.0), F.lit(0.0), F.lit("l")).alias("r")).first()
    assert "Part 2 of 4" in asked["m"] and "1:00 to 2:00" in asked["m"] and "1:00:00" in asked["r"] and "the language of the transcript" in asked["r"]


def test_texts_are_split_once_in_dealt_rows(spark):
    rows = [(k, s, s * 60.0, s * 60.0 + 40, f"topic{k} river{s} boats carry stones along quiet water") for k in range(4) for s in range(5)]
    segments = spark.createDataFrame(rows, "k long, seg long, s_start double, s_end double, text string").coalesce(1)
    plan = text.term_counts(segments, ["k", "seg"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    # What follows reads the written weights; nothing else splits a text into terms.
    assert "IsAlphabetic" not in notes.show_notes(segments, "k")._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_of_gaps_by_brute_force(spark):
    rng = np.random.default_rng(4)
    said = {(k, s): " ".join(f"word{'abcdefgh'[w]}" for w in rng.integers(0, 8, rng.integers(0, 7))) for k, n in enumerate((2, 3, 4, 6, 8, 9, 25)) for s in range(n) if (n, s) != (9, 4)}
    segments = spark.createDataFrame([(k, s, t) for (k, s), t in said.items()], "k long, seg long, text string")
    sizes = segments.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    posts = text.postings(text.term_counts(segments, ["k", "seg"]), "k", "seg")
    for window in (1, 2, 3):
        got = {(r["k"], r["gap"]): r["sim"] for r in text.gap_similarity(posts, sizes, "k", "seg", window).collect()}
        want = {}
        for k, n in ((r["k"], r["n"]) for r in sizes.collect()):
            w = max(min(window, n // 3), 1)
            for gap in range(w, n - w + 1) if n >= 2 * w + 1 else ():
                a, b = (Counter(" ".join(said.get((k, s), "") for s in side).split()) for side in (range(gap - w, gap), range(gap, gap + w)))
                norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                want[k, gap] = sum(a[t] * b[t] for t in a) / norm if norm else 0.0
        assert got == pytest.approx(want, abs=1e-12)


def test_a_segment_told_twice_counts_once_in_titles(spark):
    rows = [(1, 0, 0.0, 40.0, "zebra zebra zebra zebra zebra zebra apple")] + 2 * [(1, 1, 60.0, 100.0, "apple apple boat")]
    segments = spark.createDataFrame(rows, "k long, seg long, s_start double, s_end double, text string")
    # Six zebras, five apples (one and twice two) and two boats; the terms of segment 1 told twice again would put apples first.
    assert [c["title"] for c in notes.show_notes(segments, "k").first()["chapters"]] == ["Zebra, Apple & Boat"]


def test_titles_and_keywords(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["x", "y", "z", "q"],)], "k array<string>")
    assert [r[0] for r in df.select(notes.titles(F.col("k"))).collect()] == [[], ["A"], ["A & B", "A and B"], ["X, Y & Z", "X and Y", "X, Y, Z"]]
    from signalframe.operators.text import clean_keywords

    assert spark.createDataFrame([(["- #One", "one", " ", "*#Two ", "one"],)], "k array<string>").select(clean_keywords(F.col("k"))).first()[0] == ["one", "two", "one"]


def test_bands_merge_by_place(spark):
    from signalframe.operators import folds

    band = lambda f, g: {"freq": f, "gain": g, "q": 1.0}
    rows = [("h", 1, "merge", -20.0, [band(100.0, 2.0)]), ("h", 2, "merge", -16.0, [band(100.0, 4.0), band(4000.0, 1.0)]), ("h", 3, "upsert", -10.0, [band(50.0, 1.0)]), ("h", 4, "merge", -14.0, []), ("g", 1, "merge", -20.0, [band(100.0, 2.0)]), ("g", 2, "merge", -16.0, [band(100.0, 4.0), band(4000.0, 1.0)])]
    df = spark.createDataFrame(rows, f"label string, at int, op string, median double, bands {folds.BANDS}")
    got = {r["label"]: r for r in folds.running_profiles(df, "label", "at", ["median"], "bands").collect()}
    assert got["h"]["median"] == -12.0 and [b["freq"] for b in got["h"]["bands"]] == [50.0]
    assert [(b["freq"], b["gain"]) for b in got["g"]["bands"]] == [(100.0, 3.0), (4000.0, 1.0)]


def test_catalogue_tags_and_outputs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    import hashlib

    models = catalog.known(spark, [("a", "asr", "a.bin", 3, hashlib.sha256(b"abc").hexdigest().upper()), ("b", "llm", "b.bin", 3, None), ("c", "asr", "a.bin", 3, "00")])
    got = {r["id"]: r["state"] for r in catalog.located(models, catalog.file_hashes(spark, str(tmp_path / "m"))).collect()}
    assert got == {"a": "ok", "b": "missing", "c": "wrong hash"}
    tags = lambda *rows: spark.createDataFrame(list(rows), "path string, tags map<string,string>")
    merged = {r["path"]: r["tags"] for r in catalog.merged_tags(tags(("p", {"title": "x", "artist": "y", "year": "1"})), tags(("p", {"title": "z", "year": ""}), ("q", {"a": "b"}))).collect()}
    assert merged == {"p": {"title": "z", "artist": "y"}, "q": {"a": "b"}}
    specs = spark.createDataFrame([(1, "mp3", 128, 2, None), (2, "wav", 128, 2, 16), (3, "tape", None, 9, 12)], "k int, format string, kbps int, channels int, bits int")
    assert {(r["k"], r["error"]) for r in catalog.output_errors(specs, "k").collect()} == {(2, "a lossless format has no bitrate"), (3, "unknown format"), (3, "one or two channels"), (3, "16, 24 or 32 bits")}
    cache, made = catalog.StageCache(), []
    one = lambda s: cache.get(specs, {"a": s}, lambda df: made.append(s) or df.where("k > 1"))
    assert one(1).count() == one(1).count() == 2 and one(2).count() == 2 and made == [1, 2]


def test_queue_and_progress(spark):
    rows = [("b", 1, "x", "submit", None), ("b", 2, "y", "submit", None), ("b", 3, "z", "submit", None), ("b", 4, "z", "move", 0), ("b", 5, "y", "remove", None), ("b", 6, "q", "remove", None)]
    df = spark.createDataFrame(rows, "batch string, at int, job string, action string, place int")
    assert [(r["job"], r["place"]) for r in jobs.queue_order(df, "batch").orderBy("place").collect()] == [("z", 0), ("x", 1)]
    none = spark.createDataFrame([], "state string, progress double")
    assert jobs.overall(none).first()[0] == 1.0
    with jobs.tagged(spark, "some-tag"):
        assert "some-tag" in spark.getTags()
    assert "some-tag" not in spark.getTags()


@pytest.mark.parametrize("width, step", [(1, 1 / 128), (2, 2.0**-15), (3, 2.0**-23), (4, 2.0**-31)])
def test_pcm_widths(width, step):
    values = np.array([0.0, 0.5, -0.5, -1.0])
    whole = np.round(values / step).astype(np.int64)
    raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in whole)
    assert np.allclose(readers.pcm(raw, width, 1)[0], values)


def test_resampling_keeps_the_band_and_nothing_above_it():
    t = np.arange(16_000) / 16_000
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 6000 * t)
    y = readers.resample(low + high, 16_000, 8_000)
    assert len(y) == 8000 and np.abs(y[200:-200] - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[200:-200]).max() < 0.02
    up = readers.resample(low, 16_000, 48_000)
    assert len(up) == 48_000 and np.abs(up[500:-500] - np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)[500:-500]).max() < 0.02
    assert readers.resample(low, 7, 7) is low


def test_command_line(spark, tmp_path, capsys):
    from signalframe import __main__ as cli

    x = master.coloured_noise(60_000, 3) * 0.02
    (tmp_path / "a.wav").write_bytes(readers.wav_bytes(x[None], 48_000))
    args = lambda *a: cli.argparse.Namespace(**dict(zip(("command", "path", "preset", "out"), a, strict=True)))
    assert cli.run(args("analyze", str(tmp_path), "acx", None), spark) == 0
    assert abs(json.loads(capsys.readouterr().out)["duration_secs"] - 1.25) < 1e-6
    assert cli.run(args("master", str(tmp_path), "Podcast_Stereo", str(tmp_path / "out")), spark) == 0
    assert json.loads(capsys.readouterr().out)["on_target"]
    assert spark.read.parquet(str(tmp_path / "out")).first()["name"] == "a_mastered.wav"
    assert cli.run(args("targets", str(tmp_path), "x", "/o"), spark) == 0
    assert json.loads(capsys.readouterr().out)["output"] == "/o/a_mastered.wav"
    probed = readers.probe(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))).first()
    assert (probed["rate"], probed["channels"], probed["format"]) == (48_000, 1, "pcm_s16")
