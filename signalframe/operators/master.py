"""Digests of renders, the injected completer, and generators of test signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recursive


def digest(samples: DataFrame, key: str = "signal_id") -> DataFrame:
    """key, digest: a hash of all samples, equal for equal renders in any partitioning."""
    return samples.groupBy(key).agg(F.sum(F.xxhash64("n", F.round("x", 9)).cast("decimal(38,0)")).cast("string").alias("digest"))


def completed(chunks: DataFrame, complete: Callable[[str], str], key: str, order: str, text: str) -> DataFrame:
    """key, digests, failed: an injected completer over chunks; failed chunks are counted and left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch[text]:
                try:
                    out.append(complete(t))
                except Exception:  # noqa: BLE001  a chunk's failure is data
                    out.append(None)
            yield batch[[key, order]].assign(answer=out)

    kinds = dict(chunks.dtypes)
    rows = chunks.select(key, order, text).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, answer string")
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct(order, "answer")))), lambda x: x["answer"])
    return rows.groupBy(key).agg(answers.alias("digests"), F.count_if(F.col("answer").isNull()).alias("failed"))


def tone(rate: float, seconds: float, freq: float, level: float, seed: int, noise: float = 0.0) -> np.ndarray:
    """A sine with seeded uniform noise."""
    n = int(rate * seconds)
    return level * np.sin(2 * np.pi * freq * np.arange(n) / rate) + noise * (2 * recursive.splitmix(seed, n) - 1)


def coloured_noise(n: int, seed: int, slope_db: float = -3.0, rate: float = 48_000.0) -> np.ndarray:
    """Seeded noise whose power falls by slope_db an octave; root mean square 1."""
    spectrum = np.fft.rfft(2 * recursive.splitmix(seed, n) - 1)
    freq = np.maximum(np.arange(len(spectrum)) * rate / n, 20.0)
    x = np.fft.irfft(spectrum * (freq / 1000) ** (slope_db / 6.0206), n)
    return x / max(float(np.sqrt(np.mean(x * x))), 1e-12)


def room(x: np.ndarray, rt60: float, seed: int, rate: float = 48_000.0, wet: float = 0.3) -> np.ndarray:
    """x with a seeded room: noise that decays by 60 dB in rt60 seconds, after the direct sound."""
    n = max(1, int(rt60 * rate))
    tail = (2 * recursive.splitmix(seed, n) - 1) * 10 ** (-3 * np.arange(n) / n)
    tail *= wet / max(float(np.sqrt((tail * tail).sum())), 1e-12)
    size = 1 << (len(x) + n).bit_length()
    return x + np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(tail, size), size)[: len(x)]


def with_hum(x: np.ndarray, fundamental: float, level: float, harmonics: int = 4, rate: float = 48_000.0) -> np.ndarray:
    t = np.arange(len(x)) / rate
    return x + level * sum(np.sin(2 * np.pi * k * fundamental * t) / k for k in range(1, harmonics + 1))


def band_limited(x: np.ndarray, top_hz: float, rate: float = 48_000.0) -> np.ndarray:
    spectrum = np.fft.rfft(x)
    spectrum[np.arange(len(spectrum)) * rate / max(len(x), 1) > top_hz] = 0
    return np.fft.irfft(spectrum, len(x))


def clipped(x: np.ndarray, drive_db: float) -> np.ndarray:
    return np.clip(x * 10 ** (drive_db / 20), -1.0, 1.0)


def looped(x: np.ndarray, n: int) -> np.ndarray:
    """x repeated or cut to n samples."""
    return np.resize(x, n) if len(x) else np.zeros(n)


def at_snr(signal: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    power = lambda v: float(np.mean(v * v)) + 1e-20
    return signal + noise * np.sqrt(power(signal) / power(noise) / 10 ** (snr_db / 10))
