"""Decay estimates: from speech offsets of a recording, and from a clap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decay_seconds(energy: np.ndarray, speech: np.ndarray, hop_seconds: float) -> float | None:
    """Seconds for 60 dB from the median fall after speech offsets; null below three of them.

    A scan: after an offset it goes on behind the hops that it used.
    """
    if len(energy) < 60:
        return None
    slopes, i = [], 1
    while i + 20 < len(energy):
        if not (speech[i - 1] and not speech[i]):
            i += 1
            continue
        above = np.flatnonzero(energy[i : i + 15] > energy[i])
        last = i + (int(above[0]) if len(above) else min(15, len(energy) - i)) - 1
        fall = energy[i] - energy[last]
        if last > i + 3 and fall > 3:
            slopes.append(fall / ((last - i) * hop_seconds))
        i = last + 1
    if len(slopes) < 3:
        return None
    middle = sorted(slopes)[int((len(slopes) - 1) * 0.5 + 0.5)]
    return float(np.clip(60 / middle, 0.05, 3.0)) if middle > 0 else None


def rt60(marked: DataFrame, hop_seconds: float = 0.01, key: str = "signal_id") -> DataFrame:
    """key, rt60 of hops (key, hop, energy_db, speech)."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hop")
        found = decay_seconds(group["energy_db"].to_numpy(float), group["speech"].to_numpy(bool), hop_seconds)
        return pd.DataFrame({key: [group[key].iloc[0]], "rt60": [found]})

    kind = dict(marked.dtypes)[key]
    return marked.select(key, "hop", "energy_db", "speech").groupBy(key).applyInPandas(one, f"{key} {kind}, rt60 double")


def clap_decay(windows: DataFrame, window_seconds: float = 0.005, key: str = "signal_id") -> DataFrame:
    """key, rt60: three times the time from 5 to 25 dB under the (last) loudest window (key, win, level_db)."""
    w = Window.partitionBy(key)
    rows = windows.withColumn("top", F.max("level_db").over(w))
    peak = F.max(F.when(F.col("level_db") == F.col("top"), F.col("win"))).over(w)
    rows = rows.withColumn("peak", peak).where(F.col("win") > F.col("peak"))
    first = lambda db: F.min(F.when(F.col("level_db") <= F.col("top") - db, F.col("win")))
    out = rows.groupBy(key).agg(first(5).alias("a"), first(25).alias("b"))
    return out.where("a IS NOT NULL AND b IS NOT NULL").select(key, ((F.col("b") - F.col("a")) * window_seconds * 3).alias("rt60"))


def level_spread(levels: DataFrame, frames: int, step: int, key: str = "signal_id") -> DataFrame:
    """key, sigma: population deviation of means over `frames` rows (key, n, level), one each `step`.

    Rows more than 40 dB under the loudest mean don't count.
    """
    from .islands import framed

    rows = framed(levels, key, "n", 0, frames - 1, lambda w: {"m": F.avg("level").over(w(0, frames - 1)), "c": F.count("level").over(w(0, frames - 1))})
    rows = rows.where((F.col("c") == frames) & (F.col("n") % step == 0))
    top = rows.groupBy(key).agg(F.max("m").alias("top"))
    return rows.join(top, key).where(F.col("m") >= F.col("top") - 40).groupBy(key).agg(F.stddev_pop("m").alias("sigma"))
