"""Mastering in blocks: signals of any length, many tasks a signal, equal to chain.render() on the whole.

A stage runs on chunks of blocks with the neighbours that its memory reaches; what it needs of the
whole signal comes first, as sums, order statistics or filter states by signal. Followers forget:
their copies beside a chunk are so long that a wrong start is below 1e-12. The front is written
once; each probe of the drive gain, for all signals together, is one pass over that table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import settled
from . import chain, recursive
from .blocks import BLOCK, CHUNK, Chunk, by_signal, filtered, mapped, over_chunks, packed, unpacked, upper_median
from .grouped import grouped_map
from .loudness import START, next_probe

HOP = chain.HOP
#: Blocks that followers look back: 0.06, 0.08 and 0.15 s of release at 48 kHz, by the 28 time constants of 1e-12 and more.
SIBILANCE, REDUCTION, TAMER = 4, 5, 7
#: Blocks beside a chunk that repairs look at.
REPAIR = 2


def _joined(facts: DataFrame, more: DataFrame, key: str) -> DataFrame:
    renamed = more.withColumnRenamed(key, "__key")
    return settled(facts.join(renamed, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key"), "master-facts")


def _engaged(facts: DataFrame, column: str) -> bool:
    """Whether any signal runs a stage."""
    if column not in facts.columns:
        return False
    on = F.col(column) if dict(facts.dtypes)[column] == "boolean" else F.col(column).isNotNull()
    return bool(facts.where(on).limit(1).count())


def _mono(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=0)


def high_passed(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """Downmix, DC blocker, high-pass and hum notches, with exact filter states."""
    dry = 0.01

    def chain_of(f: dict) -> list:
        hum = f.get("dehum_hz")
        notches = [recursive.biquad("notch", rate, k * hum, 30.0) for k in range(1, int(1000.0 // hum) + 1)] if hum else []
        return [(1.0, -1.0, 0.0, -0.9975, 0.0), recursive.biquad("highpass", rate, f.get("cutoff_hz") or 80.0, 0.7071), *notches]

    front = lambda c: c.x.mean(axis=0, keepdims=True) if c.facts.get("downmix") and len(c.x) > 1 else c.x
    return filtered(blocks, chain_of, key, facts, front, lambda y, f: y[-1] * (1 - dry) + y[1] * dry if f.get("dehum_hz") else y[1])


def _rebuilt(c: Chunk, rate: float) -> np.ndarray:
    tops = unpacked(c.facts["tops"])
    top = tops.max()
    if not c.facts.get("declip") or (c.facts.get("music_ratio") or 0.0) > 0.6 or top < 0.98 or c.facts["samples"] < 8:
        return c.x
    most = max(3, round(0.010 * rate))
    return np.stack([recursive.hermite_bridge(x, 3, most, top=own) if own >= top * 10 ** (-0.05 / 20) else x for x, own in zip(c.x, tops, strict=True)])


def declipped(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """Flat tops rebuilt against each channel's own ceiling, trimmed by the signal's new peak."""
    levels = over_chunks(blocks, lambda c: {"tops": [packed(np.abs(c.x).max(axis=1))], "n": [c.x.shape[1]]}, "tops binary, n long", key)
    facts = _joined(facts, by_signal(levels, ["tops", "n"], lambda g: {"tops": [packed(np.max([unpacked(t) for t in g["tops"].to_pylist()], axis=0))], "samples": [sum(g["n"].to_pylist())]}, "tops binary, samples long", key), key)

    def after(c: Chunk):
        y = _rebuilt(c, rate)[:, c.lo : c.hi]
        return {"peak": [float(np.abs(y).max())], "changed": [not np.array_equal(y, c.x[:, c.lo : c.hi])]}

    peaks = over_chunks(blocks, after, "peak double, changed boolean", key, facts=facts, left=REPAIR, right=REPAIR)
    facts = _joined(facts, peaks.groupBy(key).agg(F.max("peak").alias("peak"), F.bool_or("changed").alias("changed")), key)

    def run(c: Chunk):
        y, f = _rebuilt(c, rate), c.facts
        touched = f.get("declip") and (f.get("music_ratio") or 0.0) <= 0.6 and unpacked(f["tops"]).max() >= 0.98 and f["samples"] >= 8
        aim = 10 ** (-1.0 / 20)
        return y * (aim / f["peak"]) if touched and (f["changed"] or f["peak"] > 1.0) and f["peak"] > aim else y

    return mapped(blocks, run, key, facts=facts, left=REPAIR, right=REPAIR)


def repaired(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """Clicks by the sigma of all second differences of the signal, then crackle by what lies beside it."""

    def differences(c: Chunk):
        d2 = recursive.second_difference(_mono(c.x))[c.lo : c.hi]
        return d2[2:] if c.at + c.lo == 0 else d2

    if _engaged(facts, "declick_gate"):
        facts = _joined(facts, upper_median(blocks, differences, "d2", key, left=1), key)

    def run(c: Chunk):
        y, f = c.x, c.facts
        gate = f.get("declick_gate")
        if gate is not None:
            y = recursive.repair_clicks(y, rate, gate_db=gate, sigma=max(1.4826 * (f["d2"] or 0.0), 1e-6))
        if f.get("decrackle_ratio") is not None:
            y = recursive.repair_crackle(y, rate, f["decrackle_ratio"], gate_db=gate if gate is not None else -60.0)
        return y

    return mapped(blocks, run, key, facts=facts, left=REPAIR, right=REPAIR)


def softened(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """Breaths against the loud tenth of the signal's hops, then sibilance."""
    if _engaged(facts, "breath"):
        energies = over_chunks(blocks, lambda c: {"e": [packed(recursive.hop_levels(_mono(c.x), HOP)[0])]}, "e binary", key)
        facts = _joined(facts, by_signal(energies, ["e"], lambda g: {"loud_db": [recursive.nearest_rank(np.concatenate([unpacked(e) for e in g["e"].to_pylist()]), 0.9)]}, "loud_db double", key), key)

    def run(c: Chunk):
        y, f = c.x, c.facts
        if f.get("breath"):
            floor = f.get("noise_floor_dbfs")
            y = recursive.control_breath(y, rate, -60.0 if floor is None else floor, loud_db=f["loud_db"])
        if f.get("deess_threshold") is not None:
            y = np.stack([recursive.de_ess(row, rate, f["deess_threshold"]) for row in y])
        return y

    return mapped(blocks, run, key, facts=facts, left=SIBILANCE + 1, right=REPAIR)


def equaliser_facts(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """facts with bands (packed centre, gain, q): from the mean spectrum of frames 10 dB above the signal's quiet tenth."""

    def frames(c: Chunk):
        # Frames that begin in the chunk's own part; a whole one each.
        got, db = recursive.eq_frames(_mono(c.x)[c.lo :], HOP)
        n = -(-(c.hi - c.lo) // HOP)
        return got[:n], db[:n]

    levels = over_chunks(blocks, lambda c: {"db": [packed(frames(c)[1])]}, "db binary", key, right=1)

    def quiet(g):
        db = np.concatenate([unpacked(d) for d in g["db"].to_pylist()])
        at = recursive.nearest_rank(db, 0.10) + 10 if len(db) else 0.0
        return {"loud_from": [at if (db >= at).any() else -np.inf]}

    facts = _joined(facts, by_signal(levels, ["db"], quiet, "loud_from double", key), key)

    def sums(c: Chunk):
        got, db = frames(c)
        loud = np.flatnonzero(db >= c.facts["loud_from"])
        return {"power": [packed(recursive.power_sum(got, loud))], "n": [len(loud)], "bandwidth": [c.facts.get("bandwidth_hz")]}

    def fit(g):
        n = sum(g["n"].to_pylist())
        power = np.sum([unpacked(p) for p in g["power"].to_pylist()], axis=0)
        return {"bands": [packed(np.array(recursive.eq_bands(power / n, rate, bandwidth_hz=g["bandwidth"][0].as_py() or 0.0) if n else []))]}

    told = over_chunks(blocks, sums, "power binary, n long, bandwidth double", key, facts=facts, right=1)
    return _joined(facts, by_signal(told, ["power", "n", "bandwidth"], fit, "bands binary", key), key)


def _equalised(c: Chunk, rate: float) -> np.ndarray:
    """Equaliser, then each speaker's gain and bands."""
    bands = unpacked(c.facts.get("bands")).reshape(-1, 3)
    y = recursive.equalise(c.x, rate, [tuple(b) for b in bands]) if c.facts.get("autoeq") and len(bands) else c.x
    if (speakers := chain.speakers_of(c.facts)) is not None:
        owner, gains, own = speakers
        first = max(0, (c.at + c.lo) // BLOCK - TAMER - 1) * (BLOCK // HOP)
        y = recursive.level_speakers(y, rate, owner[c.at // HOP - first :], gains, own)
    return y


def _owners(blocks: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, chunk, owner: the owners of each chunk's hops and of those that it looks back to."""
    each, back = BLOCK // HOP, TAMER + 1
    ends = blocks.groupBy(key).agg(F.max("block").alias("end")).select(F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / CHUNK))).alias("chunk"))
    first = F.greatest(F.col("chunk") * CHUNK - back, F.lit(0)) * each
    return ends.join(facts.select(key, "owner"), F.col(key).eqNullSafe(F.col("__key"))).select(key, "chunk", F.slice("owner", (first + 1).cast("int"), (CHUNK + back) * each).alias("owner"))


def levelled(blocks: DataFrame, facts: DataFrame, rate: float, key: str) -> DataFrame:
    """Equaliser, slow gain by hops and fast tamer."""
    if _engaged(facts, "autoeq"):
        facts = equaliser_facts(blocks, facts, rate, key)
    owners = None
    if "owner" in facts.columns:
        # A chunk gets its own stretch of the owners only.
        owners, facts = settled(_owners(blocks, facts, key), "master-owners"), facts.drop("owner")

    def hops(c: Chunk):
        # The weighting forgets within a block; the equaliser before it within another.
        mono, first = _mono(_equalised(c, rate)), max(0, c.lo - BLOCK)
        ms = recursive.k_hops(mono[first : c.hi], HOP)[(c.lo - first) // HOP :]
        f = c.facts
        gate = f.get("noise_gate_lufs")
        return {"ms": [packed(ms)], "target": [f["target_lufs"] if f.get("target_lufs") is not None else -16.0], "gate": [-50.0 if gate is None else gate], "warm": [f.get("warm_start_db") or 0.0], "music": [bool(f.get("music_mode"))]}

    def gains(g):
        own = {c: g[c][0].as_py() for c in ("target", "gate", "warm", "music")}
        db = recursive.level_gain(np.concatenate([unpacked(m) for m in g["ms"].to_pylist()]), HOP / rate, target=own["target"], preserve=0.35, gate=own["gate"], warm_start=own["warm"], music=own["music"])
        chunks, each = g["chunk"].to_pylist(), BLOCK // HOP
        return {"chunk": chunks, "gains": [packed(db[max(0, k * CHUNK - TAMER - 1) * each : (k + 1) * CHUNK * each]) for k in chunks]}

    told = over_chunks(blocks, hops, "ms binary, target double, gate double, warm double, music boolean", key, facts=facts, own=owners, left=2)
    own = by_signal(told, ["ms", "target", "gate", "warm", "music"], gains, "chunk long, gains binary", key).select(key, "chunk", "gains")
    if owners is not None:
        renamed = owners.withColumnRenamed(key, "__key").withColumnRenamed("chunk", "__chunk")
        own = own.join(renamed, F.col(key).eqNullSafe(F.col("__key")) & (F.col("chunk") == F.col("__chunk")), "left").drop("__key", "__chunk")

    def run(c: Chunk):
        y = _equalised(c, rate)
        y = y * recursive.ramped(unpacked(c.facts["gains"]), HOP, y.shape[1])
        return recursive.tame(y, rate, c.facts["target_lufs"] if c.facts.get("target_lufs") is not None else -16.0)

    return mapped(blocks, run, key, facts=facts, own=settled(own, "master-gains"), left=TAMER + 1)


def front_blocks(blocks: DataFrame, configured: DataFrame, rate: float, key: str = "signal_id", denoise: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks after the stages before loudness, the configurations); stages that no signal engages cost nothing.

    denoise(x, rate, strength) sees a chunk with two blocks on each side; what it raises fails the job.
    """
    facts = settled(configured.select(key, *[c for c in chain.CONFIG if c in configured.columns]), "master-facts")
    y = settled(high_passed(blocks, facts, rate, key), "master-front")
    if _engaged(facts, "declip"):
        y = settled(declipped(y, facts, rate, key), "master-declip")
    if _engaged(facts, "declick_gate") or _engaged(facts, "decrackle_ratio"):
        y = settled(repaired(y, facts, rate, key), "master-repair")
    if denoise is not None and _engaged(facts, "denoise_strength"):
        y = settled(mapped(y, lambda c: c.x if c.facts.get("denoise_strength") is None else denoise(c.x, rate, c.facts["denoise_strength"]), key, facts=facts, left=REPAIR, right=REPAIR), "master-denoise")
    if _engaged(facts, "breath") or _engaged(facts, "deess_threshold"):
        y = settled(softened(y, facts, rate, key), "master-soft")
    return settled(levelled(y, facts, rate, key), "master-level"), facts


def _tenths(y: np.ndarray, chunk: Chunk, rate: float) -> dict:
    """K-weighted energy of the chunk's own part by tenth of a second, channels added, and its length."""
    first, step = max(0, chunk.lo - BLOCK), int(rate) // 10
    at = (chunk.at + np.arange(chunk.lo, chunk.hi)) // step
    total = np.zeros(at[-1] - at[0] + 1)
    for c in y:
        k = recursive.run_filters(c[first : chunk.hi], recursive.K_WEIGHTING)[chunk.lo - first :]
        total += np.bincount(at - at[0], weights=k * k)
    return {"tenth": [int(at[0])], "sums": [packed(total)], "n": [chunk.hi - chunk.lo]}


def _powers(g, rate: float) -> np.ndarray:
    """Powers of the complete tenths of a signal's chunks."""
    step, firsts = int(rate) // 10, g["tenth"].to_pylist()
    sums = [unpacked(s) for s in g["sums"].to_pylist()]
    total = np.zeros(firsts[-1] + len(sums[-1]))
    for at, s in zip(firsts, sums, strict=True):
        total[at : at + len(s)] += s
    return total[: sum(g["n"].to_pylist()) // step] / step


TENTHS = "tenth long, sums binary, n long"


def block_loudness(blocks: DataFrame, rate: float, key: str = "signal_id") -> DataFrame:
    """key, integrated_lufs, loudness_range_lu, momentary_max_lufs, short_term_max_lufs of blocks."""
    rows = over_chunks(blocks, lambda c: _tenths(c.x, c, rate), TENTHS, key, left=1)
    names = ["integrated_lufs", "loudness_range_lu", "momentary_max_lufs", "short_term_max_lufs"]
    return by_signal(rows, ["tenth", "sums", "n"], lambda g: {k: [v] for k, v in chain.loudness_of(_powers(g, rate)).items()}, ", ".join(f"{c} double" for c in names), key)


def _driven(c: Chunk, rate: float) -> np.ndarray:
    return recursive.pulled_down(c.x * 10 ** (c.facts["gain"] / 20), rate, c.facts["ceiling"])


STATE = "gain double, lo double, hi double, last_gain double, last_off double, probes long, done boolean"


def probed(blocks: DataFrame, states: DataFrame, rate: float, key: str, tolerance: float) -> DataFrame:
    """states (key, target, ceiling, STATE, trim, lufs) after one probe of each signal: one pass over the blocks.

    trim and lufs belong to the gain that was probed.
    """
    carried = [f.split()[0] for f in STATE.split(", ")]

    def measure(c: Chunk):
        if c.facts.get("gain") is None:
            return None
        y = _driven(c, rate)
        out = _tenths(y, c, rate) | {"peak": [float(recursive.true_peaks(y)[c.lo : c.hi].max())]}
        return out | {k: [c.facts[k]] for k in (*carried, "target", "ceiling")}

    def fold(g):
        own = {k: g[k][0].as_py() for k in (*carried, "target", "ceiling")}
        peak, ceiling = max(g["peak"].to_pylist()), 10 ** (own["ceiling"] / 20)
        trim = ceiling / peak if peak > ceiling else 1.0
        lufs = chain.gated_loudness(chain.sliding_mean(_powers(g, rate) * trim * trim, 4))
        state = {k: own[k] for k in carried}
        # A search that ended without a probe of its gain only learns the trim of it.
        state = state if state["done"] else next_probe(state, own["target"] - lufs, tolerance)
        known = state["gain"] == own["gain"]
        return {k: [v] for k, v in (own | state | {"trim": trim if known else None, "lufs": lufs if known else None}).items()}

    rows = over_chunks(blocks, measure, f"{TENTHS}, peak double, {STATE}, target double, ceiling double", key, facts=states, left=REDUCTION + 1, right=1)
    return by_signal(rows, ["tenth", "sums", "n", "peak", *carried, "target", "ceiling"], fold, f"{STATE}, target double, ceiling double, trim double, lufs double", key)


def drive(blocks: DataFrame, facts: DataFrame, rate: float, key: str = "signal_id", tolerance: float = 0.3) -> DataFrame:
    """key, gain, trim, lufs, probes: the gain that meets each signal's target after limiting, in 8 probes at most.

    All signals that still search are probed in one pass over the written blocks.
    """
    of = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in facts.columns else F.lit(default)
    start = [F.lit(START[f.split()[0]]).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")]
    none = F.lit(None).cast("double")
    wanted = facts.select(F.col(key).alias("__key"), of("target_lufs", -16.0).alias("target"), of("ceiling_dbtp", -1.0).alias("ceiling"))
    every = blocks.select(key).distinct().join(wanted, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").fillna({"target": -16.0, "ceiling": -1.0})
    open_ = settled(every.select(key, *start, "target", "ceiling", none.alias("trim"), none.alias("lufs")), "master-probes")
    found = None
    while open_.limit(1).count():
        part = blocks.join(open_.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_semi") if found is not None else blocks
        states = settled(probed(part, open_, rate, key, tolerance), "master-probes")
        ended = states.where("trim IS NOT NULL AND done")
        found = ended if found is None else found.unionByName(ended)
        open_ = states.where("NOT (trim IS NOT NULL AND done)")
    return settled(found, "master-drive") if found is not None else open_


def master_blocks(blocks: DataFrame, configured: DataFrame, rate: float, key: str = "signal_id", dither_bits: int | None = None, dither_seed: int = 0, denoise: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(rendered blocks, report) of blocks mastered by each signal's configuration (rows of decide.stages()).

    The samples are those of chain.master() on whole signals but for rounding, unless a chain of
    crackle repairs, each within 512 samples of the last, is longer than two blocks. report has key, gain_db,
    probes, after_lufs, before_lufs and after_peak_dbtp's trim. A seed takes the place of the content hash for
    dither, whose noise goes by a sample's place. Signals without a configuration have only the
    stages without settings; no blocks, no rows.
    """
    front, facts = front_blocks(blocks, configured, rate, key, denoise)
    driven = drive(front, facts, rate, key)

    def run(c: Chunk):
        y = _driven(c, rate) * c.facts["trim"]
        if dither_bits is not None and dither_bits < 32:
            y = np.stack([recursive.dither(row, dither_bits, dither_seed, c.at) for row in y])
        return y

    out = mapped(front, run, key, facts=driven.select(key, "gain", "ceiling", "trim"), left=REDUCTION + 1, right=1)
    before = block_loudness(blocks, rate, key).select(F.col(key).alias("__key"), F.col("integrated_lufs").alias("before_lufs"))
    report = driven.join(before, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out, report.select(key, F.col("gain").alias("drive_db"), "probes", "before_lufs", F.col("lufs").alias("after_lufs"), "trim")
