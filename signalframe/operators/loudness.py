"""Integrated loudness, range and true peak by gated blocks; the drive-gain search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lufs
from ..functions.stats import nearest_rank, order_statistics
from .grouped import grouped_map, numbers
from .recursive import K_WEIGHTING, run_filters, stage, true_peaks


def k_weighted(samples: DataFrame) -> DataFrame:
    return stage(samples, lambda x: run_filters(x, K_WEIGHTING))


def hop_mean_squares(weighted: DataFrame, hop: int) -> DataFrame:
    """signal_id, hop, ms with a short last hop."""
    return weighted.groupBy("signal_id", F.floor(F.col("n") / hop).alias("hop")).agg(F.avg(F.col("x") * F.col("x")).alias("ms"))


def block_loudness(weighted: DataFrame, block: int, step: int) -> DataFrame:
    """signal_id, block, ms of complete overlapping blocks, from sums of steps."""
    parts = weighted.groupBy("signal_id", F.floor(F.col("n") / step).alias("s")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count(F.lit(1)).alias("c"))
    k = block // step
    spread = parts.select("signal_id", "e", "c", F.explode(F.sequence(F.col("s") - k + 1, F.col("s"))).alias("block")).where("block >= 0")
    return spread.groupBy("signal_id", "block").agg(F.sum("e").alias("e"), F.sum("c").alias("c")).where(F.col("c") == block).select("signal_id", "block", (F.col("e") / F.col("c")).alias("ms"))


def integrated(blocks: DataFrame, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """signal_id, integrated_lufs: mean of blocks above -70 LUFS and above 10 LU under their mean."""
    loud = blocks.where(lufs(F.col("ms")) > absolute)
    first = loud.groupBy("signal_id").agg((lufs(F.avg("ms")) + relative).alias("gate"))
    kept = loud.join(first, "signal_id").where(lufs(F.col("ms")) > F.col("gate"))
    found = kept.groupBy("signal_id").agg(lufs(F.avg("ms")).alias("integrated_lufs"))
    return blocks.select("signal_id").distinct().join(found, "signal_id", "left").select("signal_id", F.coalesce("integrated_lufs", F.lit(-120.0)).alias("integrated_lufs"))


def loudness_range(short: DataFrame) -> DataFrame:
    """signal_id, range_lu: from the 10th to the 95th percentile of gated short-term blocks."""
    loud = short.where(lufs(F.col("ms")) > -70)
    gate = loud.groupBy("signal_id").agg((lufs(F.avg("ms")) - 20).alias("gate"))
    kept = loud.join(gate, "signal_id").withColumn("l", lufs(F.col("ms"))).where("l > gate")
    ends = order_statistics(kept, ["signal_id"], "l", {"lo": nearest_rank(0.10), "hi": nearest_rank(0.95)})
    return ends.select("signal_id", (F.col("hi") - F.col("lo")).alias("range_lu"))


def true_peak(samples: DataFrame) -> DataFrame:
    """signal_id, true_peak_db, four times oversampled."""

    def one(group):
        return {"true_peak_db": [20 * np.log10(max(true_peaks(numbers(group, "x")).max(initial=0.0), 1e-6))]}

    return grouped_map(samples, ["signal_id"], ["n"], ["x"], one, "true_peak_db double")


def loudness_maxima(weighted: DataFrame, rate: int) -> DataFrame:
    """signal_id, momentary_max_lufs, short_term_max_lufs: the loudest 400 ms and 3 s, a block each 100 ms.

    -120 for signals shorter than a block.
    """
    step = rate // 10
    top = lambda block, name: block_loudness(weighted, block, step).groupBy("signal_id").agg(lufs(F.max("ms")).alias(name))
    every = weighted.select("signal_id").distinct()
    out = every.join(top(4 * step, "momentary_max_lufs"), "signal_id", "left").join(top(30 * step, "short_term_max_lufs"), "signal_id", "left")
    return out.fillna(-120.0, ["momentary_max_lufs", "short_term_max_lufs"])


def weighted_blocks(weighted: DataFrame, block: int, step: int, gains: dict[int, float] | None = None) -> DataFrame:
    """signal_id, block, ms of channels (signal_id, ch, n, x) added up, each times its gain (1; surrounds 1.41)."""
    gain = F.create_map(*[F.lit(v) for kv in (gains or {}).items() for v in kv]) if gains else None
    g = F.coalesce(gain[F.col("ch")], F.lit(1.0)) if gain is not None else F.lit(1.0)
    power = weighted.groupBy("signal_id", "n").agg(F.sum(F.col("x") * F.col("x") * g).alias("p"))
    return block_loudness(power.select("signal_id", "n", F.sqrt("p").alias("x")), block, step)


START = {"gain": 0.0, "lo": None, "hi": None, "last_gain": None, "last_off": None, "probes": 0, "done": False}


def next_probe(state: dict, off: float, tolerance: float = 0.3, most_probes: int = 8, most_step: float = 12.0, cap: float = 30.0) -> dict:
    """The state of the search for a gain after its gain turned out `off` from the target: done, or with a new gain.

    Secant steps inside a bracket; after most_probes the gain of the next step stands without a probe.
    """
    gain, lo, hi, probes = state["gain"], state["lo"], state["hi"], state["probes"] + 1
    if abs(off) <= tolerance:
        return state | {"probes": probes, "done": True}
    lo, hi = (max(lo, gain) if lo is not None else gain, hi) if off > 0 else (lo, min(hi, gain) if hi is not None else gain)
    known = state["last_gain"] is not None and gain != state["last_gain"]
    slope = (state["last_off"] - off) / (gain - state["last_gain"]) if known else 1.0
    step = off / slope if slope > 0.05 else off
    wanted = min(gain + float(np.clip(step, -most_step, most_step)), cap)
    if lo is not None and hi is not None and not lo < wanted < hi:
        wanted = (lo + hi) / 2
    return {"gain": wanted, "lo": lo, "hi": hi, "last_gain": gain, "last_off": off, "probes": probes, "done": probes >= most_probes}


def drive_gain(measure, target: float, **settings) -> tuple[float, int]:
    """(gain in dB, probes) so that measure(gain) meets the target, by next_probe()."""
    state = START
    while not state["done"]:
        state = next_probe(state, target - measure(state["gain"]), **settings)
    return state["gain"], state["probes"]
