"""Gates against bleed: a track is turned down where another one explains what it hears.

A session's tracks are one ordered group, since every frame of a track is held against all others;
sessions are dealt over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import recursive
from .grouped import grouped_map, numbers
from .recursive import nearest_rank
from .spectral import gcc_phat

EPSILON = 1e-12


@dataclass(frozen=True)
class Gate:
    """Settings: decibels, seconds and shares."""

    most_db: float = -15.0
    window: float = 0.100
    hop: float = 0.025
    coherence: float = 0.6
    dominance_db: float = 6.0
    veto_db: float = 18.0
    veto_share_db: float = -6.0
    veto_floor_db: float = 6.0
    veto_hold: float = 0.250
    lookahead: float = 0.150
    attack: float = 0.030
    release: float = 0.120
    speech_db: float = 12.0
    most_lag: float = 0.250
    lag_window: float = 60.0
    least_confidence: float = 0.2


def frames_of(seconds: float, hop: int, rate: float) -> int:
    return int(seconds * rate / hop + 0.5)


def frame_sums(x: np.ndarray, win: int, hop: int) -> np.ndarray:
    """Sums of x over frames of win from each hop on; zeros lie beyond the end."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    start = np.arange(-(-len(x) // hop)) * hop
    return sums[np.minimum(start + win, len(x))] - sums[start]


def frame_levels(x: np.ndarray, win: int, hop: int) -> np.ndarray:
    return 10 * np.log10(np.maximum(frame_sums(x * x, win, hop), 0.0) / win + EPSILON)


def spread(mask: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Whether a frame, or one of the `back` before or the `ahead` after it, is set."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    at = np.arange(len(mask))
    return sums[np.minimum(at + ahead + 1, len(mask))] > sums[np.maximum(at - back, 0)]


def shifted(x: np.ndarray, lag: int, n: int) -> np.ndarray:
    """n samples of x, the first of them x[-lag]; zero beyond its ends."""
    out = np.zeros(n)
    lo, hi = max(0, lag), min(n, len(x) + lag)
    if lo < hi:
        out[lo:hi] = x[lo - lag : hi - lag]
    return out


def slewed(wanted: np.ndarray, hop: int, n: int, depth: float, attack: float, release: float, rate: float) -> np.ndarray:
    """n samples of gain in dB that follow wanted (by frame), down by the attack and up by the release."""
    down = depth / (attack * rate) if attack > 0 else depth
    up = depth / (release * rate) if release > 0 else depth
    out, cur = np.zeros(n), 0.0
    for f in range(len(wanted)):
        lo, hi = f * hop, n if f == len(wanted) - 1 else min(n, (f + 1) * hop)
        want = float(wanted[f])
        # Within a frame the target stands, so the gain is a line up to it.
        step = np.arange(1, hi - lo + 1)
        line = np.maximum(cur - down * step, want) if want < cur else np.minimum(cur + up * step, want)
        out[lo:hi] = line
        cur = float(line[-1]) if hi > lo else cur
    return out


def gate_track(b: np.ndarray, sources: list[np.ndarray], rate: float, gate: Gate = Gate()) -> tuple[np.ndarray, dict]:
    """(gain in dB by sample, report) of a track against others on the same timeline.

    A frame is turned down where a speaking source is coherent with it and louder by the dominance,
    unless what the source leaves unexplained is speech of the track's own.
    """
    n = len(b)
    none = {"source": None, "active_ratio": 0.0, "veto_ratio": 0.0, "max_reduction_db": 0.0, "mean_reduction_db": 0.0, "lag_ms": []}
    win, hop = (int(v * rate + 0.5) for v in (gate.window, gate.hop))
    if not n or not sources or gate.most_db >= 0 or not win or not hop:
        return np.zeros(n), none
    levels = frame_levels(b, win, hop)
    count = len(levels)
    size = np.minimum(win, n - np.arange(count) * hop)
    eb = np.maximum(frame_sums(b * b, win, hop), 0.0)
    rhos, active, heard, lags = [], [], [], []
    for a in sources:
        own = shifted(a, 0, n)
        level = frame_levels(own, win, hop)
        speaks = level > nearest_rank(level, 0.10) + gate.speech_db
        head = max(1, min(int(gate.lag_window * rate), n))
        lag, sure = gcc_phat(own[:head], b[:head], max(1, int(gate.most_lag * rate)))
        lag = int(np.floor(abs(lag) + 0.5) * np.sign(lag))
        best = np.zeros(count)
        for step in (-round(0.001 * rate), 0, round(0.001 * rate)):
            late = shifted(a, lag + step, n)
            ea = np.maximum(frame_sums(late * late, win, hop), 0.0)
            fine = (ea > 1e-12) & (eb > 1e-12)
            rho = np.minimum(np.abs(frame_sums(late * b, win, hop)) / np.sqrt(np.where(fine, ea * eb, 1.0)), 1.0)
            best = np.maximum(best, np.where(fine, rho, 0.0))
        rhos.append(np.where(speaks & (sure >= gate.least_confidence), best, 0.0))
        active.append(speaks)
        heard.append(level)
        lags.append(lag * 1000.0 / rate)
    others = np.any(active, axis=0)
    quiet = levels[~others]
    floor = nearest_rank(levels if len(quiet) * 10 < count else quiet, 0.10)
    source = np.argmax(rhos, axis=0)
    rho = np.max(rhos, axis=0)
    judged = (rho > 0) & (size * 4 >= win)
    residual = eb * (1 - rho * rho)
    residual_db, share_db = 10 * np.log10(residual / size + EPSILON), 10 * np.log10(residual / np.maximum(eb, 1e-300) + EPSILON)
    own_speech = (residual_db > floor + gate.veto_db) | ((residual_db > floor + gate.veto_floor_db) & (share_db > gate.veto_share_db))
    veto = judged & own_speech
    dominant = np.choose(source, heard) - levels >= gate.dominance_db if len(heard) <= 32 else np.array(heard)[source, np.arange(count)] - levels >= gate.dominance_db
    hit = judged & ~veto & dominant & (rho >= gate.coherence)
    wanted = np.where(hit, gate.most_db * np.clip((rho - gate.coherence) / (1 - gate.coherence), 0, 1), 0.0)
    look = frames_of(gate.lookahead, hop, rate)
    hits = np.bincount(source[hit], minlength=len(sources))
    wanted[spread(spread(veto, frames_of(gate.veto_hold, hop, rate), 0), 0, look)] = 0.0
    # A frame ducks only as far as every frame within the lookahead does.
    smooth = -recursive.forward_min(-wanted, look + 1)
    gain = slewed(smooth, hop, n, -gate.most_db, gate.attack, gate.release, rate)
    ducked = smooth < 0
    return gain, {
        "source": int(len(hits) - 1 - np.argmax(hits[::-1])) if hits.any() else None,  # the last of equal ones
        "active_ratio": float(ducked.mean()), "veto_ratio": float(veto.mean()), "max_reduction_db": float(gain.min(initial=0.0)),
        "mean_reduction_db": float(smooth[ducked].mean()) if ducked.any() else 0.0, "lag_ms": lags,
    }


def _tracks(group) -> tuple[np.ndarray, np.ndarray]:
    """(names, signals of one length) of a group of (track, n, x) sorted by track and n; n counts from 0, missing samples are 0."""
    names, at = np.unique(group["track"].to_numpy(), return_inverse=True)
    n = group["n"].to_numpy()
    x = np.zeros((len(names), int(n.max(initial=-1)) + 1))
    x[at, n] = numbers(group, "x")
    return names, x


REPORT = "track long, source long, active_ratio double, veto_ratio double, max_reduction_db double, mean_reduction_db double"


def crossgate(samples: DataFrame, session: str, rate: float, gate: Gate = Gate()) -> DataFrame:
    """session, track, n, gain_db of samples (session, track, n, x): each track against all others of its session."""

    def run(group):
        names, x = _tracks(group)
        gains = [gate_track(x[k], [x[j] for j in range(len(names)) if j != k], rate, gate)[0] for k in range(len(names))]
        return {"track": np.repeat(names, x.shape[1]), "n": np.tile(np.arange(x.shape[1]), len(names)), "gain_db": np.concatenate(gains)}

    return grouped_map(samples, [session], ["track", "n"], ["x"], run, "track long, n long, gain_db double")


def crossgate_report(samples: DataFrame, session: str, rate: float, gate: Gate = Gate()) -> DataFrame:
    """session and REPORT: by track, which other one bled into it most, and how much was gated."""

    def run(group):
        names, x = _tracks(group)
        out = []
        for k in range(len(names)):
            rest = [j for j in range(len(names)) if j != k]
            told = gate_track(x[k], [x[j] for j in rest], rate, gate)[1]
            out.append([names[k], None if told["source"] is None else names[rest[told["source"]]], *(told[c] for c in ("active_ratio", "veto_ratio", "max_reduction_db", "mean_reduction_db"))])
        return {c.split()[0]: [r[i] for r in out] for i, c in enumerate(REPORT.split(", "))}

    return grouped_map(samples, [session], ["track", "n"], ["x"], run, REPORT)


def duck_gain(speech: np.ndarray, hop: int, n: int, rate: float, depth_db: float = -12.0, hangover: float = 0.100, hold: float = 0.300, lookahead: float = 0.200, fade_up: float = 0.800) -> tuple[np.ndarray, dict]:
    """(gain in dB by sample, report) of a bed under speech frames: down ahead of them, held behind them, and up again."""
    depth = min(depth_db, 0.0)
    if not n or not len(speech) or not hop or depth >= 0:
        return np.zeros(n), {"duck_db": depth, "active_ratio": 0.0, "max_reduction_db": 0.0}
    back = frames_of(hangover, hop, rate) + frames_of(hold, hop, rate)
    mask = spread(spread(speech, back, 0), 0, frames_of(lookahead, hop, rate))
    gain = slewed(np.where(mask, depth, 0.0), hop, n, -depth, lookahead, fade_up, rate)
    return gain, {"duck_db": depth, "active_ratio": float((gain <= -1.0).mean()), "max_reduction_db": float(gain.min(initial=0.0))}


def bus(x: np.ndarray, rate: float, target: float = -16.0, ceiling: float = -1.0, tolerance: float = 0.5) -> np.ndarray:
    """A mix through the limiter, with one correction where it misses the target by more than the tolerance."""
    from .chain import loudness

    level = loudness(x, rate)["integrated_lufs"]
    gain = target - level if level > -70 else 0.0
    out = recursive.limit(x * 10 ** (gain / 20), rate, ceiling)
    off = target - loudness(out, rate)["integrated_lufs"]
    return recursive.limit(x * 10 ** ((gain + off) / 20), rate, ceiling) if abs(off) > tolerance and level > -70 else out
