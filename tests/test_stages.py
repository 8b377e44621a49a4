"""Sample-level stages on signals with known answers."""

import numpy as np
import pytest

from signalframe.operators import loudness, recursive, spectral
from signalframe.sources import readers

RATE = 48_000.0
T = np.arange(72_000) / RATE


def tone(freq, level=0.2):
    return level * np.sin(2 * np.pi * freq * T)


def level(x):
    return 20 * np.log10(np.sqrt(np.mean(x[48_000:] ** 2)) + 1e-12)


def test_notch_takes_the_hum_and_leaves_the_voice():
    assert level(recursive.de_hum(tone(50), RATE, 50.0)) < level(tone(50)) - 12
    assert abs(level(recursive.de_hum(tone(475), RATE, 50.0)) - level(tone(475))) < 1.0


def test_dc_is_blocked():
    assert abs(recursive.dc_blocked(np.ones(len(T)))[-1]) < 1e-3


def test_limiter_keeps_the_ceiling_and_quiet_signals():
    y = recursive.limit(tone(997, 1.4), RATE, -1.0)
    assert recursive.true_peaks(y).max() <= 10 ** (-1 / 20) + 1e-9
    quiet = tone(997, 0.1)
    assert np.allclose(recursive.limit(quiet, RATE, -1.0), quiet)


def test_forward_min_is_a_sliding_minimum():
    x = np.random.default_rng(1).random(500)
    want = [x[i : i + 7].min() for i in range(len(x))]
    assert np.allclose(recursive.forward_min(x, 7), want)


def test_blocked_filter_is_the_recursion():
    x = np.random.default_rng(3).normal(size=1000)
    for c in (recursive.biquad("notch", RATE, 50, 30), recursive.K_WEIGHTING[0], recursive.K_WEIGHTING[1], (1.0, -1.0, 0.0, -0.9975, 0.0)):
        z1 = z2 = 0.0
        want = []
        for v in x:
            y = c[0] * v + z1
            z1, z2 = c[1] * v - c[3] * y + z2, c[2] * v - c[4] * y
            want.append(y)
        for n in (0, 1, 255, 256, 1000):
            assert np.allclose(recursive.run_filter(x[:n], c), want[:n], atol=1e-9)


def test_click_is_bridged():
    x = tone(200)
    y = x.copy()
    y[4000:4002] += 0.8
    assert np.abs(recursive.repair_clicks(y, RATE) - x).max() < 0.05
    assert np.array_equal(recursive.repair_clicks(x, RATE), x)
    assert np.abs(recursive.repair_crackle(y, RATE) - x).max() < 0.02


def regions_by_scan(x, d2, threshold, longest, gate):
    """The scan, sample by sample."""
    out, i = [], 2
    while i < len(x):
        if abs(d2[i]) > threshold[i]:
            end = i + 1
            while end < len(x) and abs(d2[end]) > threshold[end] and end - i < longest:
                end += 1
            near = x[max(0, i - 240) : min(len(x), end + 240)]
            if np.sqrt(np.mean(near**2)) >= gate:
                out.append((i, end))
            i = end + 1
        else:
            i += 1
    return out


def test_scan_skips_a_sample_behind_each_region():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x = rng.normal(size=600) * np.repeat([1e-4, 1.0, 1e-4], 200)
        d2, threshold = recursive.second_difference(x), rng.random(600)
        for longest in (1, 2, 5):
            want = regions_by_scan(x, d2, threshold, longest, 0.1)
            assert recursive.outlier_regions(x, d2, threshold, longest, 0.1) == want and want


def test_crackle_thresholds_are_local_means():
    d2 = np.random.default_rng(6).normal(size=5000)
    got = recursive.crackle_thresholds(d2, 6.0)
    for i in (2, 3, 40, 2047, 2048, 4999):
        wide, near = np.abs(d2[max(0, i - 32) : i + 33]), np.abs(d2[max(0, i - 4) : i + 5])
        base = (wide.sum() - near.sum()) / (len(wide) - len(near))
        w = i // 2048 * 2048
        part = np.sort(np.abs(d2[max(w, 2) : w + 2048]))
        assert np.isclose(got[i], max(6 * base, 4 * 1.4826 * part[len(part) // 2]))
    assert np.isinf(got[:2]).all()


def test_regions_merge_where_they_touch():
    assert recursive.dilated([(5, 6), (9, 10), (40, 41), (50, 80)], 2, 100, 20) == [(3, 12), (38, 43)]


def test_flat_tops_are_rebuilt():
    x = np.clip(tone(200, 1.3), -1, 1)
    y = recursive.hermite_bridge(x, 3, 480)
    assert np.abs(y).max() > 1.05
    assert np.allclose(y[np.abs(x) < 0.9], x[np.abs(x) < 0.9])
    z = recursive.de_clip(np.stack([x, 0.5 * x]), RATE)
    assert abs(np.abs(z).max() - 10 ** (-1 / 20)) < 1e-9
    assert np.array_equal(recursive.de_clip(x, RATE, music_ratio=0.7), x)
    assert recursive.flat_tops(np.array([0, 0, 1, 1, 1, 0, 0, -1, -1, 0.0, 1, 1]), 1.0, 2, 3) == [(2, 5, 1), (7, 9, -1)]


def test_limiter_links_channels_and_streams():
    x = np.stack([tone(997, 1.4), tone(997, 0.1)])
    y = recursive.limit(x, RATE, -1.0)
    assert np.allclose(y[0] / 14, y[1], atol=1e-12) and recursive.true_peaks(y).max() <= 10 ** (-1 / 20) + 1e-9
    mono = tone(997, 1.4)[:9000] * np.repeat([0.2, 1.0, 0.4], 3000)
    whole = recursive.Limiter(RATE).push(mono, last=True)
    for size in (1, 333, 4800):
        stream, parts = recursive.Limiter(RATE), []
        for lo in range(0, len(mono), size if size > 1 else 517):
            step = size if size > 1 else 517
            parts.append(stream.push(mono[lo : lo + step]))
            stream = recursive.Limiter(RATE, state=stream.state())
        parts.append(stream.push(np.zeros(0), last=True))
        assert np.allclose(np.concatenate(parts), whole, atol=1e-12)


def test_breaths_are_turned_down():
    rng = np.random.default_rng(7)
    voice = 0.3 * np.sin(2 * np.pi * 200 * np.arange(48_000) / RATE)
    breath = 0.02 * (2 * rng.random(48_000) - 1)
    x = np.concatenate([voice, breath, voice])
    y = recursive.control_breath(x, RATE)
    inside = slice(48_000 + 4800, 96_000 - 4800)
    assert abs(20 * np.log10(np.std(y[inside]) / np.std(x[inside])) + 6) < 0.5
    assert np.allclose(y[:40_000], x[:40_000])
    heard = np.abs(x) > 1e-3
    assert np.abs(np.diff(y[heard] / x[heard])).max() < 0.01


def test_leveler_brings_speech_to_its_target():
    x = np.concatenate([tone(300, 0.06)] * 8)
    y = recursive.level(x, RATE, target=-18.0, preserve=0.0, gate=-60.0)
    from signalframe.operators import chain

    tail = lambda v: chain.loudness(v[None, -96_000:], RATE)["integrated_lufs"]
    assert abs(tail(y) + 18) < 1.0 and tail(x) < -25
    assert np.allclose(recursive.level(x, RATE, preserve=1.0), x)
    gain = recursive.level_gain(np.full(400, 1e-3), 0.01, warm_start=0.0)
    assert np.abs(np.diff(gain)).max() <= 0.02 + 1e-12


def test_leveler_holds_between_words_and_eases_off_in_music():
    ms = np.concatenate([np.full(300, 1e-4), np.zeros(300)])
    held, eased = recursive.level_gain(ms, 0.01), recursive.level_gain(ms, 0.01, music=True)
    assert np.allclose(held[300:], held[299]) and abs(eased[-1]) < abs(eased[299])


def test_equaliser_respects_bandwidth_and_empty_bands():
    rng = np.random.default_rng(8)
    from signalframe.operators import master

    x = master.band_limited(rng.normal(size=48_000) * 0.1, 3000)
    fit = recursive.eq_fit(x, RATE, "presence", 1.0, bandwidth_hz=3000)
    assert fit and all(g <= 0 for c, g, _ in fit if c >= 3000) and all(abs(g) <= 6 and q <= 2 for _, g, q in fit)
    assert recursive.eq_fit(x[:2000], RATE) == [] and recursive.eq_fit(x, RATE, amount=0.0) == []
    bell = recursive.equalise(tone(1000), RATE, [(1000.0, 6.0, 1.0)])
    assert abs(level(bell) - level(tone(1000)) - 6) < 0.1


def test_speakers_meet_their_gains_without_steps():
    x = np.concatenate([tone(220, 0.25)] * 4)
    owner = np.repeat([0, 1], len(x) // 960)
    y = recursive.level_speakers(x, RATE, owner, {0: 0.0, 1: 6.0})
    assert abs(level(y[160_000:]) - level(x[160_000:]) - 6) < 0.1 and np.allclose(y[: len(x) // 3], x[: len(x) // 3])
    assert np.abs(np.diff(y)).max() <= np.abs(np.diff(x)).max() * 2 * 1.02


def test_deesser_ducks_only_sibilance():
    assert level(recursive.de_ess(tone(6700), RATE)) < level(tone(6700)) - 3
    assert abs(level(recursive.de_ess(tone(300), RATE)) - level(tone(300))) < 0.2


def test_dither_is_deterministic_and_small():
    x = tone(440)
    assert np.array_equal(recursive.dither(x, 16, 7), recursive.dither(x, 16, 7))
    assert np.abs(recursive.dither(x, 16, 7) - x).max() <= 2 * 2.0**-15


def test_delay_is_found():
    x = np.random.default_rng(2).normal(size=4000)
    lag, sure = spectral.gcc_phat(x, np.concatenate([np.zeros(25), x])[:4000], 100)
    assert abs(lag - 25) < 0.1 and sure > 0.5


def test_prediction_continues_a_tone():
    x = tone(300)
    y = x.copy()
    y[5000:5040] = 0
    y[5000:5040] = recursive.bridge(y, 5000, 5040)
    assert np.abs(y - x).max() < 0.01


@pytest.mark.parametrize("target", [-16.0, -23.0])
def test_drive_gain_converges(target):
    gain, probes = loudness.drive_gain(lambda g: min(-30 + g, -14.0), target)
    assert abs(min(-30 + gain, -14.0) - target) <= 0.3 and probes <= 8


def test_wav_round_trip(spark, tmp_path):
    x = np.array([tone(440), tone(220)])
    (tmp_path / "a.wav").write_bytes(readers.wav_bytes(x, 48_000))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "b.txt").write_text("no")
    samples = readers.long_samples(readers.read_wav(spark, str(tmp_path)))
    got = samples.where("ch = 1").orderBy("n").toPandas()["x"].to_numpy()
    assert len(got) == len(T) and np.abs(got - x[1]).max() < 1e-4
    assert [r["path"].rsplit("/", 1)[1] for r in readers.scan_folder(spark, str(tmp_path), ["wav"]).orderBy("path").collect()] == ["a.wav", "bad.wav"]


def test_missing_documents_are_empty_and_newer_ones_refused(spark, tmp_path):
    schema = "schema_version int, name string"
    assert readers.json_documents(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "p.json").write_text('{"schema_version": 9, "name": "x"}')
    with pytest.raises(Exception, match="newer"):
        readers.json_documents(spark, str(tmp_path / "p.json"), schema).collect()


def test_blocks_do_not_change_frames(spark):
    from pyspark.sql import functions as F

    from signalframe.operators import islands

    rows = spark.createDataFrame([(s, n, float((n * 7 + s) % 11)) for s in range(2) for n in range(50)], "signal_id long, n long, x double")
    run = lambda block: sorted(map(tuple, islands.framed(rows, "signal_id", "n", 4, 3, lambda w: {"m": F.max("x").over(w(-4, 3))}, block).select("signal_id", "n", "m").collect()))
    assert run(7) == run(10_000)
    flags = lambda block: sorted(map(tuple, islands.runs(rows, "signal_id", "n", F.col("x") > 3, block).collect()))
    assert flags(5) == flags(10_000)


def test_generators():
    from signalframe.operators import master

    x = master.tone(RATE, 1.0, 997, 0.05, 3, 0.001)
    noisy = master.at_snr(x, 2 * recursive.splitmix(1, len(x)) - 1, 20.0)
    assert abs(10 * np.log10(np.mean(x**2) / np.mean((noisy - x) ** 2)) - 20) < 0.1
    pink = master.coloured_noise(1 << 16, 4)
    power = np.abs(np.fft.rfft(pink)) ** 2
    octave = lambda f: 10 * np.log10(power[int(f * 65536 / RATE) : int(2 * f * 65536 / RATE)].mean())
    assert abs(octave(1000) - octave(2000) - 3) < 0.5 and np.array_equal(pink, master.coloured_noise(1 << 16, 4))
    assert np.abs(np.fft.rfft(master.band_limited(pink, 4000)))[int(4100 * 65536 / RATE) :].max() < 1e-6
    assert np.abs(master.clipped(x, 40)).max() == 1.0 and len(master.looped(x, 7)) == 7
    assert np.std(master.with_hum(np.zeros(48_000), 50, 0.1)) > 0.05 and len(master.room(x, 0.4, 5)) == len(x)


def test_master_meets_target_and_ceiling():
    from signalframe.operators import chain, master

    speech = master.coloured_noise(4 * 48_000, 9) * 0.02 * (0.55 + 0.45 * np.sign(np.sin(2 * np.pi * 3 * np.arange(4 * 48_000) / RATE)))
    x = np.stack([master.with_hum(speech, 50, 0.002), speech])
    config = {"cutoff_hz": 80.0, "dehum_hz": 50.0, "declip": True, "declick_gate": -54.0, "decrackle_ratio": 6.0, "breath": True, "noise_floor_dbfs": -60.0, "deess_threshold": 0.3, "autoeq": True, "noise_gate_lufs": -52.0, "target_lufs": -16.0, "ceiling_dbtp": -1.0}
    y, gain, probes = chain.render(x, RATE, config)
    assert abs(chain.loudness(y, RATE)["integrated_lufs"] + 16) <= 0.5 and recursive.true_peaks(y).max() <= 10 ** (-1 / 20) + 1e-9 and probes <= 8
    again, _, _ = chain.render(x, RATE, config)
    assert np.array_equal(y, again) and recursive.content_hash(y, 48_000) == recursive.content_hash(again, 48_000)
    seen = []
    chain.front(x, RATE, {"denoise_strength": 0.5}, denoise=lambda v, rate, s: seen.append(s) or v)
    assert seen == [0.5]
    broken = chain.front(x, RATE, {"denoise_strength": 0.5}, denoise=lambda v, rate, s: 1 / 0)
    assert np.array_equal(broken, chain.front(x, RATE, {}))


def test_reports_of_known_signals():
    from signalframe.operators import chain, master

    one = tone(1000, 0.1)
    got = chain.measure(np.stack([one, one]), RATE)
    assert got["dual_mono"] and abs(got["correlation"] - 1) < 1e-9 and abs(got["integrated_lufs"] + 20) < 0.2 and abs(got["true_peak_dbtp"] + 20) < 0.1
    assert abs(chain.measure(one[None], RATE)["integrated_lufs"] - got["integrated_lufs"] + 10 * np.log10(2)) < 1e-6
    hum = chain.measure(master.with_hum(master.coloured_noise(96_000, 2) * 1e-4, 60, 0.05)[None], RATE)
    assert hum["hum_hz"] == 60.0 and hum["hum_stable"]
    talk = np.concatenate([master.coloured_noise(48_000, 3) * 0.1, 1e-5 * master.coloured_noise(48_000, 4), master.coloured_noise(48_000, 5) * 0.1])
    found = chain.measure(talk[None], RATE)
    assert len(found["silence_runs"]) == 1 and abs(found["silence_runs"][0][0] - 1.0) < 0.06 and found["snr_db"] > 40
    for n in (0, 1, 479, 481):
        assert chain.measure(np.zeros((1, n)), RATE)["integrated_lufs"] == -120.0
    clipped = chain.measure(np.clip(tone(200, 1.5), -1, 1)[None], RATE)
    assert clipped["clipping_regions"] == 600 and clipped["worst_clip_secs"] > 1e-3


def test_decay_of_offsets():
    from signalframe.operators import reverb

    one = np.concatenate([np.full(30, -10.0), -10 - np.arange(1, 31) * 1.5])
    energy, speech = np.tile(one, 5), np.tile(np.arange(60) < 30, 5)
    assert abs(reverb.decay_seconds(energy, speech, 0.01) - 60 / 150) < 0.02


def test_completer_failures_are_counted(spark):
    from signalframe.operators import master

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad"), (1, 2, "c")], "k long, o long, t string")
    got = master.completed(rows, lambda t: t.upper() if t != "bad" else 1 / 0, "k", "o", "t").collect()[0]
    assert (got["digests"], got["failed"]) == (["A", "C"], 1)
