"""Whole signals: measured in one pass, and mastered by the stages that a configuration engages.

A signal's channels come as one ordered group, so each is read once; what a report needs of hops,
spectra and blocks is computed from arrays. The parts exist as DataFrame operators too (hops,
segmentation, loudness, spectral), for signals that should use many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recursive
from .grouped import grouped_map, numbers
from .loudness import drive_gain
from .reverb import decay_seconds
from .spectral import frame_features, ring_frames

HOP, RING = 480, 2048
VERSION = 5
SILENCE = -120.0


def block_powers(channels: np.ndarray, rate: float) -> np.ndarray:
    """K-weighted power, channels added, of each complete tenth of a second."""
    step = int(rate) // 10
    n = channels.shape[1] // step
    total = np.zeros(n)
    for c in channels:
        k = recursive.run_filters(c, recursive.K_WEIGHTING)[: n * step].reshape(n, step)
        total += np.einsum("ij,ij->i", k, k) / step
    return total


def sliding_mean(values: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[width:] - sums[:-width]) / width if len(values) >= width else np.zeros(0)


def gated_loudness(blocks: np.ndarray) -> float:
    """Loudness of blocks above -70 LUFS and above 10 LU under their mean; -120 without any."""
    loud = blocks[recursive.to_lufs(blocks) > -70]
    if not len(loud):
        return SILENCE
    kept = loud[recursive.to_lufs(loud) > recursive.to_lufs(loud.mean()) - 10]
    return float(recursive.to_lufs(kept.mean()))


def loudness(channels: np.ndarray, rate: float) -> dict[str, float]:
    """Integrated, range, and the loudest 400 ms and 3 s."""
    return loudness_of(block_powers(channels, rate))


def loudness_of(tenth: np.ndarray) -> dict[str, float]:
    """loudness() from the powers of tenths of a second."""
    momentary, short = sliding_mean(tenth, 4), sliding_mean(tenth, 30)
    top = lambda v: float(recursive.to_lufs(v.max())) if len(v) else SILENCE
    heard = short[recursive.to_lufs(short) > -70]
    spread = recursive.to_lufs(heard[recursive.to_lufs(heard) > recursive.to_lufs(heard.mean()) - 20]) if len(heard) else np.zeros(0)
    lra = recursive.nearest_rank(spread, 0.95) - recursive.nearest_rank(spread, 0.10) if len(spread) else 0.0
    return {"integrated_lufs": gated_loudness(momentary), "loudness_range_lu": lra, "momentary_max_lufs": top(momentary), "short_term_max_lufs": top(short)}


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(start, end) of runs of true, ends exclusive."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)


def hop_table(mono: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """energy_db, zcr and the spectral features of complete hops."""
    n = len(mono) // HOP
    energy, zcr = recursive.hop_levels(mono[: n * HOP], HOP) if n else (np.zeros(0), np.zeros(0))
    frames = ring_frames(mono, HOP, RING)
    parts = [frame_features(frames[lo : lo + 256], rate) for lo in range(0, len(frames), 256)] or [frame_features(frames, rate)]
    return {"energy_db": energy, "zcr": zcr, **{k: np.concatenate([p[k] for p in parts]) for k in parts[0]}}


def gate(hops: dict, floor: float) -> np.ndarray:
    return (hops["energy_db"] > floor + 10) & ((hops["flatness"] < 0.6) | (hops["energy_db"] > floor + 25))


def segments(hops: dict) -> dict:
    """Floor, signal-to-noise ratio, speech and music shares, bandwidth, sibilance and silences of a signal's hops."""
    e = hops["energy_db"]
    if not len(e):
        return {"noise_floor_dbfs": SILENCE, "snr_db": 0.0, "speech_ratio": 0.0, "music_ratio": 0.0, "bandwidth_hz": 0.0, "sibilance_ratio": 0.0, "silence_runs": [], "speech": np.zeros(0, bool)}
    floor = recursive.nearest_rank(e, 0.10)
    speech = gate(hops, floor)
    if not speech.all():
        floor = recursive.nearest_rank(e[~speech], 0.10)
        speech = gate(hops, floor)
    snr = max(float(e[speech].mean()) - floor, 0.0) if speech.any() else 0.0
    win = np.arange(len(e)) // 100
    size = np.bincount(win)
    mean = lambda v: np.bincount(win, weights=v) / size
    variance = mean((e - mean(e)[win]) ** 2)
    musical = ((mean(speech) > 0.85) & (variance < 25) & ((mean(hops["flatness"]) > 0.10) | (mean(hops["zcr"]) < 0.15)))[win]
    spoken = speech & ~musical
    silences = [(lo * 0.01, hi * 0.01) for lo, hi in runs_of(~speech).tolist() if hi - lo >= 30]
    return {
        "noise_floor_dbfs": floor, "snr_db": snr, "speech_ratio": float(spoken.mean()), "music_ratio": float((speech & musical).mean()),
        "bandwidth_hz": recursive.nearest_rank(hops["rolloff_hz"][speech], 0.5) if speech.any() else 0.0,
        "sibilance_ratio": float(hops["sibilance"][spoken].mean()) if spoken.any() else 0.0, "silence_runs": silences, "speech": speech,
    }


def hum_of(hops: dict, threshold: float = 6.0) -> tuple[float | None, bool | None]:
    """(fundamental, stable) where a median ratio reaches the threshold; a tie goes to 50 Hz."""
    if len(hops["hum50"]) < 20:
        return None, None
    m50, m60 = (recursive.nearest_rank(hops[k], 0.5) for k in ("hum50", "hum60"))
    if max(m50, m60) < threshold:
        return None, None
    name = "hum50" if m50 >= m60 else "hum60"
    return float(name[3:]), bool((hops[name] >= threshold).mean() > 0.6)


def measure(channels: np.ndarray, rate: float) -> dict:
    """A signal's report (REPORT): levels, loudness, gates, hum, decay, clipping and stereo facts."""
    count, n = channels.shape
    mono = channels.mean(axis=0) if n else np.zeros(0)
    hops = hop_table(mono, rate)
    found = segments(hops)
    speech = found.pop("speech")
    hum, stable = hum_of(hops)
    clipped = runs_of((np.abs(channels) >= 0.9999).any(axis=0)) if n else np.zeros((0, 2), int)
    sizes = np.diff(clipped, axis=1).ravel()
    sizes = sizes[sizes >= 3]
    rt60 = decay_seconds(hops["energy_db"], speech, HOP / rate)
    out = {"duration_secs": n / rate, "sample_rate": int(rate), "channels": count, "true_peak_dbtp": 20 * np.log10(max(float(recursive.true_peaks(channels).max(initial=0.0)), 1e-6)), **loudness(channels, rate), **found}
    out |= {"clipping_regions": len(sizes), "worst_clip_secs": float(sizes.max(initial=0) / rate), "dc_offset": channels.mean(axis=1).tolist() if n else [0.0] * count, "hum_hz": hum, "hum_stable": stable, "rt60_secs": rt60}
    out["reverb_bucket"] = "ok" if rt60 is None else "dry" if rt60 < 0.3 else "ok" if rt60 < 0.5 else "noticeable" if rt60 < 0.8 else "bad"
    out |= {"correlation": None, "lr_imbalance_db": None, "dual_mono": None}
    if count == 2 and n:
        ll, rr, lr = (float(a @ b) for a, b in ((channels[0], channels[0]), (channels[1], channels[1]), (channels[0], channels[1])))
        r = lr / np.sqrt(ll * rr) if ll * rr > 1e-24 else 0.0
        imbalance = 10 * np.log10(ll / rr) if min(ll, rr) > 1e-12 else 0.0
        same = bool(np.abs(channels[0] - channels[1]).max() <= 1e-6)
        out |= {"correlation": float(np.clip(r, -1, 1)), "lr_imbalance_db": float(imbalance), "dual_mono": same or bool(r > 0.9999 and abs(imbalance) < 0.1)}
    return out | {"chain_version": VERSION}


REPORT = (
    "duration_secs double, sample_rate int, channels int, true_peak_dbtp double, integrated_lufs double, loudness_range_lu double, momentary_max_lufs double, short_term_max_lufs double, "
    "noise_floor_dbfs double, snr_db double, speech_ratio double, music_ratio double, bandwidth_hz double, sibilance_ratio double, silence_runs array<struct<start:double,end:double>>, "
    "clipping_regions int, worst_clip_secs double, dc_offset array<double>, hum_hz double, hum_stable boolean, rt60_secs double, reverb_bucket string, "
    "correlation double, lr_imbalance_db double, dual_mono boolean, chain_version int"
)
_NAMES = [c.split()[0] for c in REPORT.split(", ")]


def _matrix(group) -> np.ndarray:
    rows = len(np.unique(group["ch"].to_numpy()))
    return numbers(group, "x").reshape(rows, -1)


def _report_row(found: dict) -> dict:
    return {k: [[{"start": a, "end": b} for a, b in found[k]] if k == "silence_runs" else found[k]] for k in _NAMES}


def analyze(samples: DataFrame, rate: float, key: str = "signal_id") -> DataFrame:
    """key and REPORT of samples (key, ch, n, x), one row a signal."""
    return grouped_map(samples, [key], ["ch", "n"], ["x"], lambda group: _report_row(measure(_matrix(group), rate)), REPORT)


def speakers_of(config: dict) -> tuple[np.ndarray, dict, dict] | None:
    """(owner by hop, gains, bands) of a configuration with the columns of speakers.with_speakers(); None if the stage is bypassed."""
    if not config.get("speaker_leveling") or config.get("owner") is None or not config.get("speaker_gains"):
        return None
    gains = {k: g or 0.0 for k, g in enumerate(config["speaker_gains"])}
    bands = {k: [(b["centre_hz"], b["gain_db"], b["q"]) for b in own or []] for k, own in enumerate(config.get("speaker_bands") or [])}
    return np.array([-1 if o is None else o for o in config["owner"]], int), gains, bands


class Stage(NamedTuple):
    """A stage of the front: run(y, rate, config) gives the (channel, sample) array after it, where on(config) engages it."""

    name: str
    on: Callable[[dict], bool]
    run: Callable[[np.ndarray, float, dict], np.ndarray]


def _given(name: str) -> Callable[[dict], bool]:
    return lambda config: config.get(name) is not None


def _set(name: str) -> Callable[[dict], bool]:
    return lambda config: bool(config.get(name))


def _each(run: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda y: np.stack([run(c) for c in y])


def _or(value, other):
    return other if value is None else value


def _high_pass(y: np.ndarray, rate: float, config: dict) -> np.ndarray:
    pass_ = recursive.biquad("highpass", rate, config.get("cutoff_hz") or 80.0, 0.7071)
    return _each(lambda c: recursive.run_filter(recursive.dc_blocked(c), pass_))(y)


def _level(y: np.ndarray, rate: float, config: dict) -> np.ndarray:
    return recursive.level(y, rate, target=_or(config.get("target_lufs"), -16.0), gate=_or(config.get("noise_gate_lufs"), -50.0), warm_start=config.get("warm_start_db") or 0.0, music=bool(config.get("music_mode")))


#: The stages before loudness, in order. Settings are the columns of decide.stages(); a null one bypasses its stage.
FRONT = (
    Stage("downmix", _set("downmix"), lambda y, rate, c: y.mean(axis=0, keepdims=True) if len(y) > 1 else y),
    Stage("dc_hpf", lambda c: True, _high_pass),
    Stage("dehum", _set("dehum_hz"), lambda y, rate, c: _each(lambda x: recursive.de_hum(x, rate, c["dehum_hz"]))(y)),
    Stage("declip", _set("declip"), lambda y, rate, c: recursive.de_clip(y, rate, c.get("music_ratio") or 0.0)),
    Stage("declick", _given("declick_gate"), lambda y, rate, c: recursive.repair_clicks(y, rate, gate_db=c["declick_gate"])),
    Stage("decrackle", _given("decrackle_ratio"), lambda y, rate, c: recursive.repair_crackle(y, rate, c["decrackle_ratio"], gate_db=_or(c.get("declick_gate"), -60.0))),
    Stage("breath", _set("breath"), lambda y, rate, c: recursive.control_breath(y, rate, _or(c.get("noise_floor_dbfs"), -60.0))),
    Stage("deess", _given("deess_threshold"), lambda y, rate, c: _each(lambda x: recursive.de_ess(x, rate, c["deess_threshold"]))(y)),
    Stage("autoeq", _set("autoeq"), lambda y, rate, c: recursive.equalise(y, rate, recursive.eq_fit(y, rate, bandwidth_hz=c.get("bandwidth_hz") or 0.0))),
    Stage("speaker", lambda c: speakers_of(c) is not None, lambda y, rate, c: recursive.level_speakers(y, rate, *speakers_of(c))),
    Stage("leveler", lambda c: True, _level),
)


def with_stage(stage: Stage, after: str | None = None, stages: tuple[Stage, ...] = FRONT) -> tuple[Stage, ...]:
    """stages with another one right behind the stage named after (first without one); a stage of its name is replaced where it stands."""
    names = [s.name for s in stages]
    if stage.name in names and after is None:
        return tuple(stage if s.name == stage.name else s for s in stages)
    at = names.index(after) + 1 if after is not None else 0
    return (*stages[:at], stage, *stages[at:])


def front(x: np.ndarray, rate: float, config: dict, denoise: Callable | None = None, failed: list[str] | None = None, stages: tuple[Stage, ...] = FRONT) -> np.ndarray:
    """The stages before loudness, in order, for a (channel, sample) array.

    config has the columns of decide.stages(), and for the per-speaker stage those of
    speakers.with_speakers(). denoise(x, rate, strength) is a hook behind decrackle: no model ships
    with this library, so that stage is bypassed without it. A failing hook leaves the signal as it
    is; what it raised is added to failed. stages: FRONT, or what with_stage() makes of it.
    """
    hook = Stage("denoise", _given("denoise_strength"), lambda y, rate, c: denoise(y, rate, c["denoise_strength"]))
    behind = "decrackle" if any(s.name == "decrackle" for s in stages) else None
    for stage in with_stage(hook, behind, stages) if denoise is not None else stages:
        if not stage.on(config):
            continue
        if stage is not hook:
            x = stage.run(x, rate, config)
            continue
        try:
            x = stage.run(x, rate, config)
        except Exception as e:  # noqa: BLE001  a hook that fails is bypassed and told
            if failed is not None:
                failed.append(f"denoise: {type(e).__name__}: {e}")
    return x


def render(x: np.ndarray, rate: float, config: dict, dither_bits: int | None = None, **hooks) -> tuple[np.ndarray, float, int]:
    """(channels, drive in dB, probes): the front stages, the gain that meets the target after limiting, and dither below 32 bits."""
    y = front(x, rate, config, **hooks)
    target, ceiling = config.get("target_lufs", -16.0), config.get("ceiling_dbtp", -1.0)
    limited = lambda g: recursive.limit(y * 10 ** (g / 20), rate, ceiling)
    gain, probes = drive_gain(lambda g: loudness(limited(g), rate)["integrated_lufs"], target, tolerance=0.3)
    out = limited(gain)
    if dither_bits is not None and dither_bits < 32:
        seed = recursive.content_hash(out, int(rate))
        out = np.stack([recursive.dither(c, dither_bits, seed) for c in out])
    return out, gain, probes


CONFIG = ("downmix", "cutoff_hz", "dehum_hz", "declip", "music_ratio", "declick_gate", "decrackle_ratio", "denoise_strength", "breath", "noise_floor_dbfs", "deess_threshold", "autoeq", "bandwidth_hz", "speaker_leveling", "noise_gate_lufs", "warm_start_db", "music_mode", "target_lufs", "ceiling_dbtp", "owner", "speaker_gains", "speaker_bands")


def _with_config(samples: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """samples, and before them a row of each signal's configuration (ch and n -1)."""
    config = F.struct(*[c for c in CONFIG if c in configured.columns])
    none = F.lit(None).cast(configured.select(config.alias("c")).schema[0].dataType)
    rows = samples.select(key, F.col("ch").cast("int").alias("ch"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"), none.alias("config"))
    return rows.unionByName(configured.select(key, F.lit(-1).alias("ch"), F.lit(-1).cast("long").alias("n"), F.lit(0.0).alias("x"), config.alias("config")))


def _configured(group) -> tuple[np.ndarray, dict]:
    """(channels, configuration) of a group of _with_config(); no channels for a signal without samples."""
    told = int(group["ch"][0].as_py() == -1)
    return _matrix(group.slice(told)) if group.num_rows > told else np.zeros((0, 0)), (group["config"][0].as_py() or {}) if told else {}


def master(samples: DataFrame, configured: DataFrame, rate: float, key: str = "signal_id", dither_bits: int | None = None, denoise: Callable | None = None, stages: tuple[Stage, ...] = FRONT) -> DataFrame:
    """key, ch, n, x of samples (key, ch, n, x) mastered by each signal's configuration (rows of decide.stages()).

    ch and n count from 0. Signals without a configuration have only the stages without settings.
    """
    def run(group):
        x, config = _configured(group)
        if not x.size:
            return None
        y, _, _ = render(x, rate, config, dither_bits, denoise=denoise, stages=stages)
        return {"ch": np.repeat(np.arange(len(y)), y.shape[1]), "n": np.tile(np.arange(y.shape[1]), len(y)), "x": y.reshape(-1)}

    return grouped_map(_with_config(samples, configured, key), [key], ["ch", "n"], ["x", "config"], run, "ch int, n long, x double")


MASTERED = "before_lufs double, after_lufs double, before_peak_dbtp double, after_peak_dbtp double, drive_db double, probes int, on_target boolean, failed array<string>"


def master_report(samples: DataFrame, configured: DataFrame, rate: float, key: str = "signal_id", tolerance: float = 0.5, denoise: Callable | None = None) -> DataFrame:
    """key and MASTERED: what mastering each signal gives, without its samples; failed tells what hooks raised."""

    def run(group):
        x, config = _configured(group)
        if not x.size:
            return None
        failed: list[str] = []
        y, gain, probes = render(x, rate, config, denoise=denoise, failed=failed)
        peak = lambda v: 20 * np.log10(max(float(recursive.true_peaks(v).max(initial=0.0)), 1e-6))
        before, after = (loudness(v, rate)["integrated_lufs"] for v in (x, y))
        return {"before_lufs": [before], "after_lufs": [after], "before_peak_dbtp": [peak(x)], "after_peak_dbtp": [peak(y)], "drive_db": [gain], "probes": [probes], "on_target": [abs(after - config.get("target_lufs", -16.0)) <= tolerance], "failed": [failed]}

    return grouped_map(_with_config(samples, configured, key), [key], ["ch", "n"], ["x", "config"], run, MASTERED)

