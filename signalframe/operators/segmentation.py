"""Speech gates, noise floors, music windows, silence and hum over hop features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, order_statistic
from ..sources.storage import settled
from .islands import runs


def speech_gate(energy: Column, floor: Column, flatness: Column) -> Column:
    """10 dB above the floor, and structured or 25 dB above it."""
    return (energy > floor + 10) & ((flatness < 0.6) | (energy > floor + 25))


def gated(hops: DataFrame, key: str = "signal_id") -> DataFrame:
    """hops (key, hop, energy_db, flatness) with floor_db and speech.

    The floor is the 10th percentile of all hops, then of those that a first gate leaves out.
    """
    # Hops are few beside samples, and both passes read them: they are computed once.
    hops = settled(hops, "hops")
    first = settled(order_statistic(hops, [key], "energy_db", nearest_rank(0.1), "floor0"), "floors")
    rows = hops.join(first, key)
    quiet = rows.where(~speech_gate(F.col("energy_db"), F.col("floor0"), F.col("flatness")))
    second = order_statistic(quiet, [key], "energy_db", nearest_rank(0.1), "floor1")
    rows = rows.join(second, key, "left").withColumn("floor_db", F.coalesce("floor1", "floor0"))
    return rows.withColumn("speech", speech_gate(F.col("energy_db"), F.col("floor_db"), F.col("flatness"))).drop("floor0", "floor1")


def snr(marked: DataFrame, key: str = "signal_id") -> DataFrame:
    """key, floor_db, snr_db: mean level of speech above the floor, at least 0."""
    speech = F.coalesce(F.avg(F.when(F.col("speech"), F.col("energy_db"))), F.first("floor_db"))
    return marked.groupBy(key).agg(F.first("floor_db").alias("floor_db"), F.greatest(speech - F.first("floor_db"), F.lit(0.0)).alias("snr_db"))


def music_windows(marked: DataFrame, window: int = 100, key: str = "signal_id") -> DataFrame:
    """key, win, musical: continuous, steady and flat or with few crossings."""
    g = marked.groupBy(key, F.floor(F.col("hop") / window).alias("win")).agg(
        F.avg(F.col("speech").cast("double")).alias("active"), F.var_pop("energy_db").alias("var_e"), F.avg("flatness").alias("flat"), F.avg("zcr").alias("zcr"))
    return g.select(key, "win", ((F.col("active") > 0.85) & (F.col("var_e") < 25) & ((F.col("flat") > 0.10) | (F.col("zcr") < 0.15))).alias("musical"))


def ratios(marked: DataFrame, window: int = 100, key: str = "signal_id") -> DataFrame:
    """key, speech_ratio, music_ratio: gated hops outside and inside musical windows, over all hops."""
    rows = marked.withColumn("win", F.floor(F.col("hop") / window)).join(music_windows(marked, window, key), [key, "win"])
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg((F.count_if(F.col("speech") & ~F.col("musical")) / n).alias("speech_ratio"), (F.count_if(F.col("speech") & F.col("musical")) / n).alias("music_ratio"))


def silence_runs(marked: DataFrame, least: int = 30, hop_seconds: float = 0.01, key: str = "signal_id") -> DataFrame:
    """key, start, end in seconds of non-speech runs of at least `least` hops."""
    found = runs(marked, key, "hop", ~F.col("speech")).where(F.col("length") >= least)
    return found.select(key, (F.col("start") * hop_seconds).alias("start"), ((F.col("end") + 1) * hop_seconds).alias("end"))


def energy_silence(hops: DataFrame, floor_dbfs: float = -50.0, least_seconds: float = 0.3, hop_seconds: float = 0.01, key: str = "signal_id") -> DataFrame:
    """Runs of hops (key, hop, rms) below the larger of a fixed level and three times the p10 hop."""
    from ..functions.stats import floor_rank

    p10 = order_statistic(hops, [key], "rms", floor_rank(0.1), "p10")
    gate = F.greatest(F.lit(10 ** (floor_dbfs / 20)), F.col("p10") * 3)
    found = runs(hops.join(p10, key), key, "hop", F.col("rms") < gate).where(F.col("length") >= -int(-least_seconds // hop_seconds))
    return found.select(key, (F.col("start") * hop_seconds).alias("start"), ((F.col("end") + 1) * hop_seconds).alias("end"))


def hum(hops: DataFrame, key: str = "signal_id", threshold: float = 6.0, least: int = 20) -> DataFrame:
    """key, fundamental_hz, stable from hum50 and hum60; only where a median reaches the threshold.

    A tie goes to 50 Hz; stable if the ratio reaches the threshold in over 60 % of hops.
    """
    m50 = order_statistic(hops, [key], "hum50", nearest_rank(0.5), "m50")
    m60 = order_statistic(hops, [key], "hum60", nearest_rank(0.5), "m60")
    n = F.count(F.lit(1))
    share = hops.groupBy(key).agg(n.alias("n"), (F.count_if(F.col("hum50") >= threshold) / n).alias("p50"), (F.count_if(F.col("hum60") >= threshold) / n).alias("p60"))
    rows = share.join(m50, key).join(m60, key).where(F.col("n") >= least)
    low = F.col("m50") >= F.col("m60")
    rows = rows.where(F.greatest("m50", "m60") >= threshold)
    return rows.select(key, F.when(low, 50.0).otherwise(60.0).alias("fundamental_hz"), (F.when(low, F.col("p50")).otherwise(F.col("p60")) > 0.6).alias("stable"))
