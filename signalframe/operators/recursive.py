"""Sample-level recursions over whole signals, many signals a task.

A filter's state runs through all samples of a channel, so each channel is one ordered group of
stage(); segmented() cuts long channels into overlapping segments first, so that one signal uses
many tasks, and fades them into each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import grouped_map, numbers


def biquad(kind: str, rate: float, freq: float, q: float, db: float = 0.0) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2 of the audio cookbook's highpass, peaking, notch and bandpass filters."""
    w = 2 * math.pi * freq / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    a = 10 ** (db / 40)
    b, d = {
        "highpass": (((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, 1 - alpha)),
        "peaking": ((1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, 1 - alpha / a)),
        "notch": ((1.0, -2 * c, 1.0), (1 + alpha, 1 - alpha)),
        "bandpass": ((alpha, 0.0, -alpha), (1 + alpha, 1 - alpha)),
    }[kind]
    return (*(x / d[0] for x in b), -2 * c / d[0], d[1] / d[0])


# The K-weighting filters of BS.1770-4 at 48 kHz.
K_WEIGHTING = ((1.5351249, -2.6916962, 1.1983928, -1.6906593, 0.7324808), (1.0, -2.0, 1.0, -1.9900475, 0.9900723))
BLOCK = 256


@lru_cache(maxsize=256)
def _block_matrices(coefficients: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a biquad in state-space form, over BLOCK samples: outputs of inputs, outputs of the state, state of inputs, state of the state."""
    b0, b1, b2, a1, a2 = coefficients
    a = np.array([[-a1, 1.0], [-a2, 0.0]])
    b = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(a @ powers[-1])
    impulse = np.array([b0, *(p[0] @ b for p in powers[: BLOCK - 1])])
    lag = np.arange(BLOCK)[None, :] - np.arange(BLOCK)[:, None]
    outputs = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    return outputs, np.array([p[0] for p in powers[:BLOCK]]), np.array([powers[BLOCK - 1 - i] @ b for i in range(BLOCK)]), powers[BLOCK]


def run_filter(x: np.ndarray, coefficients: tuple[float, ...], state: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """A biquad from a state (rest by default)."""
    return run_filter_on(x, coefficients, state)[0]


def run_filter_on(x: np.ndarray, coefficients: tuple[float, ...], state: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """(output, state after it) of a biquad, in blocks: within one a product, between them a recursion of two numbers.

    The state is that after the last whole block, with zeros for input up to there.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0), state
    outputs, of_state, to_state, carry = _block_matrices(tuple(map(float, coefficients)))
    blocks = np.zeros((-(-n // BLOCK), BLOCK))
    blocks.reshape(-1)[:n] = x
    gains = (blocks @ to_state).tolist()
    (c00, c01), (c10, c11) = carry.tolist()
    s0, s1 = state
    states = np.empty((len(blocks), 2))
    for k, (g0, g1) in enumerate(gains):
        states[k] = s0, s1
        s0, s1 = c00 * s0 + c01 * s1 + g0, c10 * s0 + c11 * s1 + g1
    return (blocks @ outputs + states @ of_state.T).reshape(-1)[:n], (s0, s1)


def run_filters(x: np.ndarray, chain) -> np.ndarray:
    for c in chain:
        x = run_filter(x, c)
    return x


def dc_blocked(x: np.ndarray, pole: float = 0.9975) -> np.ndarray:
    return run_filter(x, (1.0, -1.0, 0.0, -pole, 0.0))


def envelope(x: np.ndarray, attack: float, release: float, start: float = 0.0) -> np.ndarray:
    """One-pole follower with coefficients for rising and falling input."""
    out, e = np.empty(len(x)), start
    for i, v in enumerate(x.tolist()):
        e = v + (e - v) * (attack if v > e else release)
        out[i] = e
    return out


def pole(seconds: float, rate: float) -> float:
    return math.exp(-1 / (seconds * rate))


def forward_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each place on, by doubling spans."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step or None] = np.minimum(out[:-step or None], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def de_hum(x: np.ndarray, rate: float, fundamental: float, top: float = 1000.0, q: float = 30.0, dry: float = 0.01) -> np.ndarray:
    """Notches at the harmonics up to 1 kHz, with a share of the dry signal as floor."""
    wet = run_filters(x, [biquad("notch", rate, k * fundamental, q) for k in range(1, int(top // fundamental) + 1)])
    return wet * (1 - dry) + x * dry


def de_ess(x: np.ndarray, rate: float, threshold: float = 0.3, ratio: float = 3.0, gate_db: float = -50.0, centre: float = 6708.0, width: float = 4000.0, lookahead: float = 0.005) -> np.ndarray:
    """Ducks the sibilant band where its share of the level is above the threshold."""
    band = run_filter(x, biquad("bandpass", rate, centre, centre / width))
    up, down = pole(0.001, rate), pole(0.060, rate)
    broad, key = envelope(x * x, up, down), envelope(band * band, up, down)
    share = np.sqrt(key / np.maximum(broad, 1e-12))
    over = (np.sqrt(broad) > 10 ** (gate_db / 20)) & (share > threshold)
    g = np.where(over, 10 ** (-np.log10(np.maximum(share / threshold, 1.0)) * (1 - 1 / ratio)), 1.0)
    return x - (1 - forward_min(g, max(1, round(lookahead * rate)) + 1)) * band


def phase_kernels(half: int = 16, factor: int = 4) -> list[np.ndarray]:
    """Blackman-windowed sinc kernels at the places between samples."""
    k = np.arange(2 * half)
    t = k / (2 * half - 1)
    window = 0.42 - 0.5 * np.cos(2 * np.pi * t) + 0.08 * np.cos(4 * np.pi * t)
    return [np.sinc(k - (half - 1) - p / factor) * window for p in range(1, factor)]


def true_peaks(x: np.ndarray, half: int = 16) -> np.ndarray:
    """Greatest magnitude at and right after each sample, four times oversampled; over all channels of a (channel, sample) array."""
    if x.ndim == 2:
        return np.max([true_peaks(c, half) for c in x], axis=0) if len(x) else np.zeros(x.shape[1])
    if not len(x):
        return np.zeros(0)
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(half)])
    return np.max([np.abs(x), *(np.abs(np.convolve(padded, k[::-1], "valid")) for k in phase_kernels(half))], axis=0)


def limit(x: np.ndarray, rate: float, ceiling_db: float = -1.0, lookahead: float = 0.005, release: float = 0.080) -> np.ndarray:
    """pulled_down(), trimmed so that no true peak passes the ceiling."""
    if not x.shape[-1]:
        return x
    y, ceiling = pulled_down(x, rate, ceiling_db, lookahead, release), 10 ** (ceiling_db / 20)
    top = true_peaks(y).max()
    return y * (ceiling / top) if top > ceiling else y


def pulled_down(x: np.ndarray, rate: float, ceiling_db: float = -1.0, lookahead: float = 0.005, release: float = 0.080) -> np.ndarray:
    """Gain pulled down ahead of peaks and smoothed; channels of a (channel, sample) array share one gain, so that the image doesn't move."""
    ceiling = 10 ** (ceiling_db / 20)
    peak = true_peaks(x)
    need = np.where(peak > ceiling, ceiling / np.maximum(peak, 1e-12), 1.0)
    ahead = max(1, round(lookahead * rate))
    wanted = forward_min(need, ahead + 1)
    down, up = math.exp(-1 / max(1.0, ahead / 3)), math.exp(-1 / max(1.0, release * rate))
    g = -envelope(-wanted, down, up, -wanted[0])  # falling gain is rising reduction
    return x * g


class Limiter:
    """limit() over a stream of blocks, but for the final trim: what is emitted doesn't depend on how samples are cut.

    state() can be stored and given back, so a stream survives its worker.
    """

    def __init__(self, rate: float, ceiling_db: float = -1.0, lookahead: float = 0.005, release: float = 0.080, half: int = 16, state: tuple | None = None):
        self.ceiling, self.half = 10 ** (ceiling_db / 20), half
        self.ahead = max(1, round(lookahead * rate))
        self.down, self.up = math.exp(-1 / max(1.0, self.ahead / 3)), math.exp(-1 / max(1.0, release * rate))
        # Samples still needed, how many of them are emitted already, and the last gain.
        held, self.done, self.gain = state or ([], 0, None)
        self.held = np.array(held, float)

    def state(self) -> tuple[list[float], int, float | None]:
        return self.held.tolist(), self.done, self.gain

    def push(self, x: np.ndarray, last: bool = False) -> np.ndarray:
        """Samples that are settled now; all that are left if these are the last."""
        self.held = np.concatenate([self.held, np.asarray(x, float)])
        n = len(self.held)
        until = n if last else n - self.ahead - self.half
        if until <= self.done:
            return np.zeros(0)
        peak = true_peaks(self.held, self.half)
        wanted = forward_min(np.where(peak > self.ceiling, self.ceiling / np.maximum(peak, 1e-12), 1.0), self.ahead + 1)[self.done : until]
        start = wanted[0] if self.gain is None else self.gain
        g = -envelope(-wanted, self.down, self.up, -start)
        self.gain = float(g[-1])
        out = self.held[self.done : until] * g
        # Earlier samples stay as far as kernels reach back.
        drop = max(0, until - (self.half - 1))
        self.held, self.done = self.held[drop:], until - drop
        return out


def flat_tops(x: np.ndarray, level: float, least: int, most: int) -> list[tuple[int, int, int]]:
    """(start, end, sign) of runs at or beyond the level, least to most long, with two samples before and after them."""
    sign = np.where(x >= level, 1, np.where(x <= -level, -1, 0))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], sign, [0]])))
    return [(int(lo), int(hi), int(sign[lo])) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if sign[lo] and least <= hi - lo <= most and lo >= 2 and hi + 1 < len(x)]


def hermite_bridge(x: np.ndarray, least: int, most: int, margin: float = 0.05, overshoot_db: float = 6.0, top: float | None = None) -> np.ndarray:
    """Flat tops at the ceiling (that of x, or a given one) rebuilt by cubics between their neighbours."""
    top = float(np.abs(x).max(initial=0.0)) if top is None else top
    if top < 0.98:
        return x
    level = top * 10 ** (-margin / 20)
    out = x.copy()
    for lo, hi, sign in flat_tops(x, level, least, most):
        n = hi - lo + 1
        # Runs to the left are rebuilt already, as a neighbour may be one of them.
        m0, m1 = (out[lo - 1] - out[lo - 2]) * n, (out[hi + 1] - out[hi]) * n
        t = np.arange(1, n) / n
        y = (2 * t**3 - 3 * t**2 + 1) * out[lo - 1] + (t**3 - 2 * t**2 + t) * m0 + (3 * t**2 - 2 * t**3) * out[hi] + (t**3 - t**2) * m1
        out[lo:hi] = np.where(np.sign(y) == sign, np.clip(np.abs(y), level, level * 10 ** (overshoot_db / 20)), level) * sign
    return out


def de_clip(x: np.ndarray, rate: float, music_ratio: float = 0.0, least: int = 3, longest: float = 0.010, target_db: float = -1.0) -> np.ndarray:
    """hermite_bridge() and a trim to the target peak; music and signals far from full scale stay as they are.

    The ceiling is that of all channels of a (channel, sample) array.
    """
    top = float(np.abs(x).max(initial=0.0))
    if music_ratio > 0.6 or top < 0.98 or x.shape[-1] < 8:
        return x
    most = max(least, round(longest * rate))
    rows = np.atleast_2d(x)
    # A channel below the ceiling of all isn't clipped, whatever its own peak is.
    out = np.stack([hermite_bridge(c, least, most) if np.abs(c).max() >= top * 10 ** (-0.05 / 20) else c for c in rows]).reshape(x.shape)
    if np.array_equal(out, x) and top <= 1.0:
        return x
    after, target = float(np.abs(out).max()), 10 ** (target_db / 20)
    return out * (target / after) if after > target else out


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients a of x[n] ~ -sum(a[k] x[n - k]), by Burg's recursion; of each row of a two-dimensional array."""
    rows = np.atleast_2d(x)
    if len(rows) == 1:
        return _burg_of_one(rows[0], order).reshape(*x.shape[:-1], -1)
    f, b, a = rows[:, 1:].astype(float), rows[:, :-1].astype(float), np.zeros((len(rows), 0))
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    den = dot(f, f) + dot(b, b)
    for _ in range(order):
        k = np.where(den > 1e-20, -2 * dot(f, b) / np.maximum(den, 1e-300), 0.0)[:, None]
        a = np.concatenate([a + k * a[:, ::-1], k], axis=1)
        f, b = f + k * b, b + k * f
        # What the next step sums, less the two samples that leave.
        den = dot(f[:, 1:], f[:, 1:]) + dot(b[:, :-1], b[:, :-1])
        f, b = f[:, 1:], b[:, :-1]
    return a.reshape(*x.shape[:-1], -1)


def _burg_of_one(x: np.ndarray, order: int) -> np.ndarray:
    f, b, a = x[1:].astype(float), x[:-1].astype(float), np.zeros(order)
    for m in range(order):
        den = f.dot(f) + b.dot(b)
        k = -2 * f.dot(b) / den if den > 1e-20 else 0.0
        if m:
            a[:m] += k * a[:m][::-1]
        a[m] = k
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def predicted(past: np.ndarray, n: int, order: int) -> np.ndarray:
    """The n values that each row of past leads to, by its own prediction."""
    a = burg(past, order)[:, ::-1]
    known = np.concatenate([past[:, -order:], np.zeros((len(past), n))], axis=1)
    if len(past) == 1:
        a, known = a[0], known[0]
        for i in range(n):
            known[order + i] = -a.dot(known[i : order + i])
        return known[None, order:]
    for i in range(n):
        known[:, order + i] = -np.einsum("ij,ij->i", a, known[:, i : order + i])
    return known[:, order:]


def faded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    fade = np.arange(1, left.shape[-1] + 1) / (left.shape[-1] + 1)
    return left * (1 - fade) + right * fade


def bridge(x: np.ndarray, lo: int, hi: int, order: int = 24, context: int = 512, from_right: np.ndarray | None = None) -> np.ndarray:
    """Values for places lo..hi-1: predictions from both sides, cross-faded; a line without context.

    from_right: the prediction from that side, if it is known.
    """
    left, right = x[max(0, lo - context) : lo], x[hi : hi + context]
    n = hi - lo
    if min(len(left), len(right)) <= 2 * order:
        a, b = (x[lo - 1] if lo else 0.0), (x[hi] if hi < len(x) else 0.0)
        return a + (b - a) * np.arange(1, n + 1) / (n + 1)
    if from_right is None and len(left) == len(right):
        both = predicted(np.stack([left, right[::-1]]), n, order)
        return faded(both[0], both[1][::-1])
    if from_right is None:
        from_right = predicted(right[None, ::-1], n, order)[0, ::-1]
    return faded(predicted(left[None], n, order)[0], from_right)


def from_the_right(x: np.ndarray, regions: list[tuple[int, int]], order: int, context: int, at_once: int = 256) -> dict[int, np.ndarray]:
    """By number, the predictions of regions from the samples after them, for those with whole contexts; many together."""
    whole = [k for k, (_, hi) in enumerate(regions) if hi + context <= len(x)]
    longest, out = max((hi - lo for lo, hi in regions), default=0), {}
    for at in range(0, len(whole), at_once):
        part = whole[at : at + at_once]
        past = np.stack([x[regions[k][1] : regions[k][1] + context][::-1] for k in part])
        for k, made in zip(part, predicted(past, longest, order), strict=True):
            out[k] = made[: regions[k][1] - regions[k][0]][::-1]
    return out


def second_difference(x: np.ndarray) -> np.ndarray:
    d2 = np.zeros(len(x))
    d2[2:] = np.diff(x, 2)
    return d2


def robust_sigma(values: np.ndarray) -> float:
    """1.4826 times the upper median of magnitudes, at least 1e-6."""
    size = np.abs(values)
    return max(1.4826 * float(np.partition(size, len(size) // 2)[len(size) // 2]), 1e-6) if len(size) else 1e-6


def outlier_regions(x: np.ndarray, d2: np.ndarray, threshold: np.ndarray, longest: int, gate: float, near: int = 240) -> list[tuple[int, int]]:
    """Runs of |d2| above the threshold, cut at `longest`, where the signal around them is as loud as the gate.

    A scan goes on one sample behind each run, so the sample right after a cut run opens none.
    """
    hot = np.abs(d2) > threshold
    hot[:2] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hot.astype(np.int8), [0]]))).tolist()
    power = np.concatenate([[0.0], np.cumsum(x * x)])
    out, i = [], 0
    for first, last in zip(edge[::2], edge[1::2], strict=True):
        i = max(i, first)
        while i < last:
            end = min(last, i + longest)
            lo, hi = max(0, i - near), min(len(x), end + near)
            if math.sqrt(max(power[hi] - power[lo], 0.0) / (hi - lo)) >= gate:
                out.append((i, end))
            i = end + 1
    return out


def dilated(regions: list[tuple[int, int]], pad: int, n: int, longest: int) -> list[tuple[int, int]]:
    """Regions with pad samples more on each side, merged where they touch, without those that are too long."""
    out: list[list[int]] = []
    for lo, hi in regions:
        lo, hi = max(0, lo - pad), min(n, hi + pad)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out if a < b <= a + longest]


def line_between(x: np.ndarray, left: int, right: int) -> None:
    """Samples between two places, exclusive, on the line from one to the other."""
    if right > left + 1:
        t = np.arange(1, right - left) / (right - left)
        x[left + 1 : right] = x[left] + (x[right] - x[left]) * t


def gap_samples(seconds: float, rate: float) -> int:
    return max(1, math.floor(seconds * rate + 0.5))


def click_regions(mono: np.ndarray, rate: float, sigmas: float = 8.0, longest: float = 0.002, gate_db: float = -60.0, sigma: float | None = None) -> list[tuple[int, int]]:
    """sigma: that of the whole signal, if mono is a part of it."""
    if len(mono) < 4:
        return []
    d2 = second_difference(mono)
    sigma = robust_sigma(d2[2:]) if sigma is None else sigma
    return outlier_regions(mono, d2, np.full(len(mono), sigmas * sigma), gap_samples(longest, rate), 10 ** (gate_db / 20))


def repair_clicks(x: np.ndarray, rate: float, sigmas: float = 8.0, longest: float = 0.002, gate_db: float = -60.0, sigma: float | None = None) -> np.ndarray:
    """Mouth clicks: outliers by a robust sigma of all second differences of the mean channel, bridged by lines."""
    rows = np.atleast_2d(x).astype(float).copy()
    for lo, hi in click_regions(rows.mean(axis=0), rate, sigmas, longest, gate_db, sigma):
        for c in rows:
            line_between(c, max(lo - 1, 0), min(hi, rows.shape[1] - 1))
    return rows.reshape(x.shape)


def crackle_thresholds(d2: np.ndarray, ratio: float, window: int = 2048, wide: int = 32, near: int = 4, sigmas: float = 4.0) -> np.ndarray:
    """For each sample the larger of `ratio` times the mean |d2| beside it and `sigmas` robust sigmas of its window."""
    n = len(d2)
    sums = np.concatenate([[0.0], np.cumsum(np.abs(d2))])
    at = np.arange(n)
    lo, hi, a, b = np.maximum(at - wide, 0), np.minimum(at + wide + 1, n), np.maximum(at - near, 0), np.minimum(at + near + 1, n)
    count = (hi - lo) - (b - a)
    base = np.where(count > 0, (sums[hi] - sums[lo] - sums[b] + sums[a]) / np.maximum(count, 1), 0.0)
    floor = np.full(n, np.inf)
    for w in range(0, n, window):
        first, last = max(w, 2), min(w + window, n)
        if first < last:
            floor[w:last] = sigmas * robust_sigma(d2[first:last])
    out = np.maximum(ratio * base, floor)
    out[:2] = np.inf
    return out


def repair_crackle(x: np.ndarray, rate: float, ratio: float = 6.0, longest: float = 0.001, gate_db: float = -60.0, pad: int = 2, order: int = 24, context: int = 512) -> np.ndarray:
    """Crackle: outliers against what lies beside them, padded, merged and bridged by prediction from both sides."""
    rows = np.atleast_2d(x).astype(float).copy()
    mono = rows.mean(axis=0)
    if len(mono) < 4:
        return rows.reshape(x.shape)
    d2, most = second_difference(mono), gap_samples(longest, rate)
    found = outlier_regions(mono, d2, crackle_thresholds(d2, ratio), most, 10 ** (gate_db / 20))
    regions = dilated(found, pad, len(mono), most + 2 * pad)
    for c in rows:
        # A repair changes what lies left of later regions, never what lies right of them.
        known = from_the_right(c, regions, order, context)
        for k, (lo, hi) in enumerate(regions):
            c[lo:hi] = bridge(c, lo, hi, order, context, known.get(k))
    return rows.reshape(x.shape)


def hop_levels(mono: np.ndarray, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """(dBFS, crossings over length) of hops, the short last one included."""
    n = -(-len(mono) // hop)
    size = np.minimum(hop, len(mono) - np.arange(n) * hop)
    at = np.arange(len(mono)) // hop
    rms = np.sqrt(np.bincount(at, weights=mono * mono, minlength=n) / size)
    flip = np.zeros(len(mono))
    flip[1:] = ((mono[1:] >= 0) != (mono[:-1] >= 0)) & (at[1:] == at[:-1])
    return np.where(rms > 1e-9, 20 * np.log10(np.maximum(rms, 1e-12)), -120.0), np.bincount(at, weights=flip, minlength=n) / size


def nearest_rank(values: np.ndarray, p: float) -> float:
    """The value at place round((n - 1) p), halves up."""
    at = int((len(values) - 1) * p + 0.5)
    return float(np.partition(values, at)[at])


def is_breath(energy_db: np.ndarray, zcr: np.ndarray, floor_db: float, loud_db: float | None = None) -> np.ndarray:
    """Hops 6 dB above the floor and 12 dB below the loud tenth (of these hops, or as given), that cross zero in a tenth of their samples."""
    if not len(energy_db):
        return np.zeros(0, bool)
    loud_db = nearest_rank(energy_db, 0.9) if loud_db is None else loud_db
    return (energy_db > floor_db + 6) & (energy_db < loud_db - 12) & (zcr >= 0.10)


def slope_limited(gain: np.ndarray, step: float) -> np.ndarray:
    """Gain whose rise, then whose fall, is at most step a sample: forwards, then backwards."""
    for order in (slice(None), slice(None, None, -1)):
        v = gain[order]
        out, g = np.empty(len(v)), float(v[0]) if len(v) else 0.0
        for i, want in enumerate(v.tolist()):
            d = want - g
            g += step if d > step else -step if d < -step else d
            out[i] = g
        gain = out[order]
    return gain


def control_breath(x: np.ndarray, rate: float, floor_db: float = -60.0, reduction_db: float = 6.0, ramp: float = 0.030, hop: int = 480, loud_db: float | None = None) -> np.ndarray:
    """Breaths turned down, with linear ramps before and after them."""
    if not x.shape[-1] or reduction_db <= 0:
        return x
    mono = np.atleast_2d(x).mean(axis=0)
    flagged = is_breath(*hop_levels(mono, hop), floor_db, loud_db)
    if not flagged.any():
        return x
    gain = np.repeat(np.where(flagged, 10 ** (-min(reduction_db, 18.0) / 20), 1.0), hop)[: len(mono)]
    return x * slope_limited(gain, 1 / max(1, round(ramp * rate)))


def k_hops(mono: np.ndarray, hop: int) -> np.ndarray:
    """K-weighted mean square of hops, the short last one included."""
    k = run_filters(mono, K_WEIGHTING)
    n = -(-len(mono) // hop)
    return np.bincount(np.arange(len(k)) // hop, weights=k * k, minlength=n) / np.minimum(hop, len(mono) - np.arange(n) * hop)


def to_lufs(ms: np.ndarray) -> np.ndarray:
    return np.where(ms > 1e-12, -0.691 + 10 * np.log10(np.maximum(ms, 1e-300)), -120.0)


def ramped(gain_db: np.ndarray, hop: int, n: int) -> np.ndarray:
    """n samples of gain that moves linearly from the last hop's to its own hop's; the first hop holds its own."""
    g = 10 ** (np.asarray(gain_db) / 20)
    before = np.concatenate([g[:1], g[:-1]])
    at = np.arange(n)
    h = at // hop
    span = np.minimum(hop, n - h * hop)
    return before[h] + (g[h] - before[h]) * ((at - h * hop) / span)


def level_gain(hop_ms: np.ndarray, hop_seconds: float, target: float = -18.0, most: float = 12.0, preserve: float = 0.35, gate: float = -50.0, warm_start: float = 0.0, music: bool = False, window: int = 300) -> np.ndarray:
    """Gain in dB by hop towards the target of the last `window` speech hops, at most 2 dB a second.

    Hops that aren't speech hold the gain, or with music let it go back to 0.
    """
    scale = 1 - min(max(preserve, 0.0), 1.0)
    speech = to_lufs(hop_ms) > gate
    sums = np.concatenate([[0.0], np.cumsum(hop_ms[speech])])
    k = np.cumsum(speech)
    first = np.maximum(k - window, 0)
    mean = (sums[k] - sums[first]) / np.maximum(k - first, 1)
    wanted = np.clip(target - to_lufs(mean), -most, most) * scale
    step = 2.0 * hop_seconds
    g, out = min(max(warm_start * scale, -most), most), np.empty(len(hop_ms))
    for h, (spoken, want) in enumerate(zip(speech.tolist(), wanted.tolist(), strict=True)):
        d = (want if spoken else 0.0 if music else g) - g
        g += min(max(d, -step), step)
        out[h] = g
    return out


def level(x: np.ndarray, rate: float, hop: int = 480, target: float = -18.0, preserve: float = 0.35, **settings) -> np.ndarray:
    """The leveler: slow gain by hops, then the fast tamer; channels move together."""
    n = x.shape[-1]
    if not n:
        return x
    mono = np.atleast_2d(x).mean(axis=0)
    y = x * ramped(level_gain(k_hops(mono, hop), hop / rate, target=target, preserve=preserve, **settings), hop, n)
    return tame(y, rate, target, preserve)


# Centres of the equaliser's bands in Hz, and the shapes that it can aim at.
EQ_CENTRES = (125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 6000.0, 8000.0)
EQ_SHAPES = {
    "neutral": (-1.5, -0.5, 0.0, 0.0, 0.5, 1.0, 0.5, -0.5),
    "warm": (2.0, 2.0, 1.0, 0.0, -0.5, -1.0, -1.5, -2.0),
    "presence": (-2.0, -1.5, -0.5, 0.0, 1.5, 2.5, 2.0, 1.0),
}
EQ_FRAME = 2048


def eq_edges() -> np.ndarray:
    """Band edges: geometric means of neighbouring centres, mirrored at the ends."""
    c = np.array(EQ_CENTRES)
    mid = np.sqrt(c[1:] * c[:-1])
    return np.concatenate([[c[0] / np.sqrt(c[1] / c[0])], mid, [c[-1] * np.sqrt(c[-1] / c[-2])]])


def gated_spectrum(mono: np.ndarray, hop: int = 480) -> np.ndarray:
    """Mean power spectrum of windowed frames that are 10 dB above the quiet tenth, or of all."""
    frames, db = eq_frames(mono, hop)
    loud = np.flatnonzero(db >= nearest_rank(db, 0.10) + 10)
    loud = loud if len(loud) else np.arange(len(frames))
    return power_sum(frames, loud) / len(loud)


def eq_frames(mono: np.ndarray, hop: int = 480) -> tuple[np.ndarray, np.ndarray]:
    """(frames, level of each in dB), a whole frame a hop."""
    frames = np.lib.stride_tricks.sliding_window_view(mono, EQ_FRAME)[::hop] if len(mono) >= EQ_FRAME else np.zeros((0, EQ_FRAME))
    ms = np.einsum("ij,ij->i", frames, frames) / EQ_FRAME
    return frames, np.where(ms > 1e-12, 10 * np.log10(np.maximum(ms, 1e-300)), -120.0)


def power_sum(frames: np.ndarray, loud: np.ndarray) -> np.ndarray:
    """Sum of the windowed frames' power spectra, of those numbered in loud."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(EQ_FRAME) / EQ_FRAME)
    total = np.zeros(EQ_FRAME // 2 + 1)
    for lo in range(0, len(loud), 256):
        total += (np.abs(np.fft.rfft(frames[loud[lo : lo + 256]] * window)) ** 2).sum(axis=0)
    return total


def eq_fit(x: np.ndarray, rate: float, shape: str = "neutral", amount: float = 0.5, bandwidth_hz: float = 0.0, q: float = 1.0, hop: int = 480) -> list[tuple[float, float, float]]:
    """(centre, gain in dB, q) of the bands that move the mean spectrum towards a shape.

    Gains are relative to the 1 kHz band and within 6 dB. Bands beyond the bandwidth, and those 40
    dB under the loudest, are never raised; signals shorter than a frame have none.
    """
    mono = np.atleast_2d(x).mean(axis=0)
    return eq_bands(gated_spectrum(mono, hop), rate, shape, amount, bandwidth_hz, q) if len(mono) >= EQ_FRAME else []


def eq_bands(power: np.ndarray, rate: float, shape: str = "neutral", amount: float = 0.5, bandwidth_hz: float = 0.0, q: float = 1.0) -> list[tuple[float, float, float]]:
    """eq_fit() of a mean power spectrum."""
    amount = min(max(amount, 0.0), 1.0)
    if amount <= 0:
        return []
    freq = np.arange(len(power)) * rate / EQ_FRAME
    edges = eq_edges()
    db = np.array([10 * np.log10(power[(freq >= lo) & (freq < hi)].sum() + 1e-12) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    gains = np.clip(np.array(EQ_SHAPES[shape]) - (db - db[EQ_CENTRES.index(1000.0)]), -6.0, 6.0) * amount
    never = (db < db.max() - 40) | ((np.array(EQ_CENTRES) >= bandwidth_hz) if bandwidth_hz > 0 else False)
    gains = np.where(never, np.minimum(gains, 0.0), gains)
    return [(c, float(g), min(q, 2.0)) for c, g in zip(EQ_CENTRES, gains, strict=True) if abs(g) > 0.01]


def equalise(x: np.ndarray, rate: float, bands: list[tuple[float, float, float]]) -> np.ndarray:
    """A bell for each of the bands (centre, gain in dB, q)."""
    filters = [biquad("peaking", rate, c, q, g) for c, g, q in bands]
    return np.stack([run_filters(row, filters) for row in np.atleast_2d(x)]).reshape(x.shape)


def smoothed(values: np.ndarray, width: int) -> np.ndarray:
    """Centred mean over an odd width; ends are repeated."""
    half = width // 2
    padded = np.concatenate([np.full(half, values[0]), values, np.full(half, values[-1])])
    sums = np.concatenate([[0.0], np.cumsum(padded)])
    return (sums[width:] - sums[:-width]) / width


def level_speakers(x: np.ndarray, rate: float, owner: np.ndarray, gains: dict[int, float], bands: dict[int, list] | None = None, crossfade: float = 0.120, hop: int = 480) -> np.ndarray:
    """Each hop at its speaker's gain (owner by hop, -1: nobody), and through its speaker's bands, cross-faded between hops.

    Hops that owner doesn't reach are nobody's; owners beyond the last hop are left out.
    """
    n = x.shape[-1]
    need = -(-n // hop)
    owner = np.concatenate([np.asarray(owner)[:need], np.full(max(0, need - len(owner)), -1)])
    width = max(1, math.floor(crossfade * rate / hop + 0.5))
    width += 1 - width % 2
    for speaker, own in (bands or {}).items():
        hit = (owner == speaker).astype(float)
        if own and hit.any():
            weight = smoothed(hit, width)
            before = np.concatenate([weight[:1], weight[:-1]])
            at = np.arange(n)
            h = at // hop
            w = before[h] + (weight[h] - before[h]) * ((at - h * hop) / np.minimum(hop, n - h * hop))
            x = x + (equalise(x, rate, own) - x) * np.clip(w, 0, 1)
    wanted = np.array([gains.get(int(o), 0.0) for o in owner])
    return x * ramped(smoothed(wanted, width), hop, n)


def tame(x: np.ndarray, rate: float, target_db: float, preserve: float = 0.35) -> np.ndarray:
    """2:1 above target + 6 dB, 6 dB at most, softened by how much dynamics to preserve; channels move together."""
    e = envelope(np.abs(np.atleast_2d(x).mean(axis=0)), pole(0.005, rate), pole(0.150, rate))
    over = 20 * np.log10(np.maximum(e / 10 ** ((target_db + 6) / 20), 1.0))
    return x * 10 ** (-np.minimum(over / 2, 6.0) * (1 - preserve) / 20)


def splitmix(seed: int, n: int) -> np.ndarray:
    """n uniform numbers in 0..1 of the splitmix64 sequence."""
    z = np.uint64(seed % 2**64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def fnv1a(data: bytes, start: int = 0xCBF29CE484222325) -> int:
    for b in data:
        start = ((start ^ b) * 0x100000001B3) & (2**64 - 1)
    return start


def content_hash(channels: np.ndarray, rate: int) -> int:
    """Of the rate, the number of channels, and the bits of all samples as 32-bit floats."""
    rows = np.atleast_2d(channels)
    return fnv1a(np.ascontiguousarray(rows, "<f4").tobytes(), fnv1a(int(len(rows)).to_bytes(8, "little"), fnv1a(int(rate).to_bytes(4, "little"))))


def dither(x: np.ndarray, bits: int, seed: int, first: int = 0) -> np.ndarray:
    """Triangular noise of one step, then quantisation; the seed is a content hash, first the place of x in its signal."""
    lsb, u = 2.0 ** (1 - bits), splitmix(seed + 2 * first * 0x9E3779B97F4A7C15, 2 * len(x))
    v = (x + (u[::2] - u[1::2]) * lsb) / lsb
    return np.sign(v) * np.floor(np.abs(v) + 0.5) * lsb


def stage(samples: DataFrame, run: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Apply run to each group's samples in order of n; columns keys, n, x."""

    def apply(group):
        return {"n": group["n"].to_numpy(), "x": run(numbers(group, "x"))}

    return grouped_map(samples, list(keys), ["n"], ["x"], apply, f"n {dict(samples.dtypes)['n']}, x double")


def linked_stage(samples: DataFrame, run: Callable[[np.ndarray], np.ndarray], key: str = "signal_id") -> DataFrame:
    """Apply run to each signal's (channel, sample) array; columns key, ch, n, x.

    samples: key, ch, n, x; all channels of a signal have the same samples.
    """

    def apply(group):
        ch, n = group["ch"].to_numpy(), group["n"].to_numpy()
        rows = len(np.unique(ch))
        return {"ch": ch, "n": n, "x": run(numbers(group, "x").reshape(rows, -1)).reshape(-1)}

    kinds = dict(samples.dtypes)
    return grouped_map(samples, [key], ["ch", "n"], ["x"], apply, f"ch {kinds['ch']}, n {kinds['n']}, x double")


def segmented(samples: DataFrame, run: Callable[[np.ndarray], np.ndarray], length: int, overlap: int, key: str = "signal_id") -> DataFrame:
    """stage() over overlapping segments that are faded into each other: one signal uses many tasks.

    Right for stages that forget within the overlap; a shorter signal is one segment.
    """
    from .multitrack import joined_segments, segment_crossfade

    rows = segment_crossfade(samples.select(key, "n", "x"), length, overlap, key)
    done = stage(rows, run, (key, "segment"))
    return joined_segments(done.join(rows.select(key, "segment", "n", F.col("weight")), [key, "segment", "n"]), key)
