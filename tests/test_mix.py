"""A whole mix of sessions with known lags and bleed."""

import numpy as np
import pytest

from signalframe.operators import chain, mix

RATE = 8000.0


def speaker(rng, n, turns):
    """Noise in syllables while the speaker talks, a faint floor else."""
    t = np.arange(n) / RATE
    on = np.zeros(n)
    for a, b in turns:
        on[(t >= a) & (t < b)] = 1
    return (on * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t)) * 0.2 + 0.0005) * rng.standard_normal(n)


@pytest.fixture(scope="module")
def session(spark):
    rng, n, lag = np.random.default_rng(4), int(12 * RATE), 200
    a = speaker(rng, n, [(0.5, 4.0), (8.0, 11.0)])
    own = speaker(rng, n, [(4.5, 7.5)])
    # The second recorder started late, and hears the first speaker.
    b = np.zeros(n)
    b[lag:] = (own + 0.2 * a)[: n - lag]
    music = 0.1 * np.sin(2 * np.pi * 330 * np.arange(n) / RATE)
    unlike = 0.1 * rng.standard_normal(n)
    rows = [("s", k, i, float(v)) for k, x in ((0, a), (1, b), (2, music), (3, unlike)) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "session string, track int, n long, x double")
    tracks = spark.createDataFrame([("s", 0, "speech", 0.0, False, False), ("s", 1, "speech", 0.0, False, False), ("s", 2, "music", -3.0, False, False), ("s", 3, "speech", 0.0, True, False), ("t", 0, "speech", 0.0, True, False)], "session string, track int, kind string, gain_db double, mute boolean, solo boolean")
    return samples, tracks, lag, music


def test_mix_of_a_session(spark, session):
    samples, tracks, lag, music = session
    got = mix.mix_sessions(samples, tracks, RATE, per_track_chain=False, most_seconds=1.0, window_seconds=4.0, residual_seconds=0.1)
    decided = {(r["session"], r["track"]): r for r in got.tracks.collect()}
    assert abs(decided["s", 1]["shift"] - lag) <= 4 and decided["s", 1]["trusted"]
    assert not decided["s", 3]["trusted"] and decided["s", 3]["shift"] == 0 and not decided["s", 3]["audible"]
    told = {(r["title"], r["track"]): r for r in got.findings.collect()}
    assert (mix.TITLES["moved"], 1) in told and (mix.TITLES["unsure"], 3) in told and (mix.TITLES["bleed"], 1) in told
    assert told[mix.TITLES["duck"], 2]["settings"]["most_db"] == -12.0
    assert told[mix.TITLES["bleed"], 1]["settings"]["source"] == 0
    audio = got.audio.orderBy("n").toPandas()
    assert set(audio["session"]) == {"s"}
    x = audio["x"].to_numpy()[None]
    level = told[mix.TITLES["normal"], None]["settings"]
    assert abs(chain.loudness(x, RATE)["integrated_lufs"] - level["after"]) < 1e-6 and abs(level["after"] + 16) <= 0.5
    # Under speech the bed is down by 12 dB against where nobody speaks.
    tone = lambda a, b: abs(np.mean(x[0, int(a * RATE) : int(b * RATE)] * np.exp(-2j * np.pi * 330 * np.arange(int(a * RATE), int(b * RATE)) / RATE)))
    assert tone(2.0, 3.5) < 0.35 * tone(11.9, 12.0) or tone(2.0, 3.5) < 0.35 * tone(0.0, 0.2)


def test_mix_with_chains_and_solo(spark, session):
    """At a rate that the chain's filters fit; the soloed track alone is heard."""
    _, tracks, _, _ = session
    rate, rng = 24_000.0, np.random.default_rng(6)
    n = int(4 * rate)
    talk = np.where(np.sin(2 * np.pi * 3 * np.arange(n) / rate) > 0, 0.1, 0.0005) * rng.standard_normal(n)
    rows = [("s", k, i, float(v)) for k, x in ((0, talk), (2, 0.05 * np.sin(0.1 * np.arange(n)))) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "session string, track int, n long, x double")
    alone = tracks.withColumn("solo", tracks["track"] == 0)
    got = mix.mix_sessions(samples, alone, rate, align=False)
    audio = got.audio.orderBy("n").toPandas()["x"].to_numpy()[None]
    assert audio.shape[1] == n and abs(chain.loudness(audio, rate)["integrated_lufs"] + 16) <= 0.6
    assert {r["track"] for r in got.tracks.where("audible").collect()} == {0}
    assert mix.mix_sessions(samples.where("false"), tracks, rate, per_track_chain=False, align=False).audio.count() == 0
