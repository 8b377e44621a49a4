"""Spectral features and delays between tracks, by NumPy transforms over ordered groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import weighted_line
from .grouped import grouped_map, numbers
from .recursive import eq_fit


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tone_ratio(power: np.ndarray, at: int, near: int = 6) -> np.ndarray:
    """Of each spectrum (row): the peak of the bins at-1..at+1 over the mean of those within `near` beside them; 0 at the edges."""
    bins = power.shape[1]
    if at < 2 or at + 2 >= bins:
        return np.zeros(len(power))
    beside = [k for k in range(max(at - near, 1), min(at + near, bins - 1) + 1) if abs(k - at) > 1]
    mean = power[:, beside].mean(axis=1)
    return power[:, at - 1 : at + 2].max(axis=1) / np.maximum(mean, 1e-12)


FEATURES = ("flatness", "rolloff_hz", "sibilance", "hum50", "hum60")


def frame_features(frames: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """FEATURES of each frame (row): flatness without the constant, 95 % roll-off, share of power at 5 to 9 kHz, hum ratios."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames * hann(n), axis=1)) ** 2
    freq = np.arange(power.shape[1]) * rate / n
    total = power.sum(axis=1)
    live = total > 1e-12
    whole = np.maximum(total, 1e-300)
    above = np.cumsum(power, axis=1) >= 0.95 * total[:, None]
    sib = power[:, (freq >= 5000) & (freq <= 9000)].sum(axis=1) / whole
    rest = power[:, 1:] + 1e-12
    flat = np.clip(np.exp(np.log(rest).mean(axis=1)) / rest.mean(axis=1), 0, 1) if rest.shape[1] else np.zeros(len(frames))
    hums = {f"hum{f}": tone_ratio(power, int(f * n / rate + 0.5)) for f in (50, 60)}
    return {"flatness": np.where(live, flat, 0.0), "rolloff_hz": np.where(live, freq[above.argmax(axis=1)], 0.0), "sibilance": np.where(live, sib, 0.0), **hums}


def ring_frames(x: np.ndarray, hop: int, ring: int, before: int = 0) -> np.ndarray:
    """The last `ring` samples up to the end of each complete hop; x begins with `before` samples of history, and zeros come before those."""
    padded = np.concatenate([np.zeros(max(0, ring - before)), x[max(0, before - ring) :]])
    n = (len(x) - before) // hop
    return np.lib.stride_tricks.sliding_window_view(padded, ring)[hop : hop * n + 1 : hop] if n else np.zeros((0, ring))


def hop_spectra(samples: DataFrame, hop: int, ring: int, rate: float, block: int = 256) -> DataFrame:
    """signal_id, hop and FEATURES of each complete hop.

    A frame is the last `ring` samples up to the hop's end; before the signal it is zero. Blocks of
    hops are groups with their own copy of the samples before them, so one long signal uses many
    tasks and all frames of a block are transformed at once.
    """
    size = hop * block
    first, last = F.floor(F.col("n") / size), F.floor((F.col("n") + ring) / size)
    rows = samples.select("signal_id", "n", "x", F.explode(F.sequence(first, last)).alias("block"))

    def run(group):
        b, n, x = int(group["block"][0].as_py()), group["n"].to_numpy(), numbers(group, "x")
        before = int((n < b * size).sum())
        frames = ring_frames(x, hop, ring, before)
        out = {k: np.zeros(0) for k in FEATURES}
        for lo in range(0, len(frames), 64):
            part = frame_features(frames[lo : lo + 64], rate)
            out = {k: np.concatenate([out[k], part[k]]) for k in FEATURES}
        return {"hop": b * block + np.arange(len(frames)), **out}

    return grouped_map(rows, ["signal_id", "block"], ["n"], ["x"], run, "hop long, " + ", ".join(f"{k} double" for k in FEATURES)).drop("block")


def gcc_phat(a: np.ndarray, b: np.ndarray, most: int, guard: int = 48) -> tuple[float, float]:
    """(lag of b behind a in samples, confidence) by phase-only correlation within +-most."""
    n = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0, 0.0
    most = min(max(1, most), max(n - 1, 1))
    size = 1 << int(n + most).bit_length()
    cross = np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size))
    level = np.abs(cross)
    r = np.abs(np.fft.irfft(np.where(level > 1e-9, cross / np.maximum(level, 1e-300), 0), size))
    k = np.arange(-most, most + 1)
    v = r[k]
    at = int(v.argmax())
    rest = v[np.abs(k - k[at]) > guard]
    confidence = float(np.clip(1 - rest.max(initial=0.0) / v[at], 0, 1)) if v[at] > 0 else 0.0
    y0, y1, y2 = r[k[at] - 1], v[at], r[(k[at] + 1) % size]
    bend = y0 - 2 * y1 + y2
    shift = float(np.clip(0.5 * (y0 - y2) / bend, -0.5, 0.5)) if abs(bend) > 1e-12 else 0.0
    return -(k[at] + shift), confidence


def window_lags(pairs: DataFrame, window: int, most: int) -> DataFrame:
    """track, win, at, lag, confidence of samples (track, n, a, b), a row a window of samples."""

    def one(group):
        lag, sure = gcc_phat(numbers(group, "a"), numbers(group, "b"), most)
        return {"at": [float(group["n"].to_numpy().mean())], "lag": [lag], "confidence": [sure]}

    return grouped_map(pairs.withColumn("win", F.floor(F.col("n") / window)), ["track", "win"], ["n"], ["a", "b"], one, "at double, lag double, confidence double")


def drift(lags: DataFrame) -> DataFrame:
    """track, offset, slope: weighted line through the windows' lags (slope * 1e6 is ppm)."""
    return lags.groupBy("track").agg(*weighted_line(F.col("at"), F.col("lag"), F.col("confidence")))


def eq_bands(samples: DataFrame, rate: float, **settings) -> DataFrame:
    """signal_id, centre_hz, gain_db, q: the bells that move a signal's gated mean spectrum towards a shape (recursive.eq_fit)."""

    def run(group):
        fits = eq_fit(numbers(group, "x"), rate, **settings)
        return {name: [f[k] for f in fits] for k, name in enumerate(("centre_hz", "gain_db", "q"))}

    return grouped_map(samples, ["signal_id"], ["n"], ["x"], run, "centre_hz double, gain_db double, q double")


def align_tracks(tracks: DataFrame, rate: float, most_seconds: float = 30.0, window_seconds: float = 60.0, residual_seconds: float = 0.5, most_ppm: float = 200.0) -> DataFrame:
    """track, offset_seconds, drift_ppm, confidence of samples (track, n, a, b): how b lies against the reference a.

    A coarse delay of the whole comes first; then each window's rest, and a weighted line through
    them. Drift beyond four times most_ppm keeps a quarter of its confidence.
    """
    whole = grouped_map(tracks, ["track"], ["n"], ["a", "b"], lambda g: dict(zip(("coarse", "sure"), ([round(v)] if k == 0 else [v] for k, v in enumerate(gcc_phat(numbers(g, "a"), numbers(g, "b"), int(most_seconds * rate)))), strict=True)), "coarse long, sure double")
    win = int(window_seconds * rate)
    a = tracks.select("track", "n", "a").join(whole, "track")
    b = tracks.select("track", F.col("n").alias("m"), "b")
    pairs = a.join(b.withColumnRenamed("track", "t"), (F.col("track") == F.col("t")) & (F.col("m") == F.col("n") + F.col("coarse")), "left")
    pairs = pairs.select("track", "n", "a", F.coalesce("b", F.lit(0.0)).alias("b"), "coarse", "sure").withColumn("win", F.floor(F.col("n") / win))

    def rest(group):
        lag, sure = gcc_phat(numbers(group, "a"), numbers(group, "b"), int(residual_seconds * rate))
        coarse = int(group["coarse"][0].as_py())
        return {"at": [float(group["n"][0].as_py()) + coarse + group.num_rows / 2], "lag": [coarse + lag], "confidence": [sure], "sure": [group["sure"][0].as_py()]}

    lags = grouped_map(pairs, ["track", "win"], ["n"], ["a", "b", "coarse", "sure"], rest, "at double, lag double, confidence double, sure double")
    used = F.col("confidence") > 0
    line = lags.where(used).groupBy("track").agg(*weighted_line(F.col("at"), F.col("lag"), F.col("confidence")), F.count(F.lit(1)).alias("usable"))
    every = lags.groupBy("track").agg(F.avg("confidence").alias("mean"), F.min_by("lag", "at").alias("first"), F.first("sure").alias("sure"))
    rows = every.join(line, "track", "left")
    fitted = F.coalesce((F.col("usable") >= 2) & F.col("slope").isNotNull(), F.lit(False))
    ppm = F.when(fitted, F.col("slope") * 1e6).otherwise(0.0)
    confidence = F.when(fitted, F.when(F.abs(ppm) > 4 * most_ppm, F.col("mean") * 0.25).otherwise(F.col("mean"))).otherwise(F.greatest("mean", F.col("sure") * 0.5))
    return rows.select("track", (F.when(fitted, F.col("offset")).otherwise(F.col("first")) / rate).alias("offset_seconds"), ppm.alias("drift_ppm"), confidence.alias("confidence"))


def lanczos_at(x: np.ndarray, at: np.ndarray, a: int = 8) -> np.ndarray:
    """Values of x at fractional places by a windowed sinc of 2 a taps; zero beyond its ends."""
    base = np.floor(at).astype(np.int64)
    out = np.zeros(len(at))
    for k in range(1 - a, a + 1):
        t = at - base - k
        weight = np.where(np.abs(t) < a, np.sinc(t) * np.sinc(t / a), 0.0)
        place = base + k
        inside = (place >= 0) & (place < len(x))
        out[inside] += x[place[inside]] * weight[inside]
    return out


def repair_drift(samples: DataFrame, drift: DataFrame, key: str = "track") -> DataFrame:
    """samples (key, n, x) read at the speed that undoes drift (key, ppm); without drift they stay."""

    def run(group):
        x, ppm = numbers(group, "x"), float(group["ppm"][0].as_py() or 0.0)
        e = ppm * 1e-6
        if not np.isfinite(e) or e == 0 or abs(1 - e) < 1e-6 or not len(x):
            return {"n": np.arange(len(x)), "x": x}
        step = 1 / (1 - e)
        at = np.arange(int((len(x) - 1) / step) + 1) * step
        return {"n": np.arange(len(at)), "x": lanczos_at(x, at)}

    return grouped_map(samples.join(drift.select(key, "ppm"), key), [key], ["n"], ["x", "ppm"], run, "n long, x double")
