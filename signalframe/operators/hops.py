"""Hop features of sampled signals: levels, crossings, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dbfs
from .islands import lagged


def hop_features(samples: DataFrame, hop: int, partial: bool = False) -> DataFrame:
    """signal_id, hop, size, energy_db, zcr of samples (signal_id, n, x).

    zcr: sign changes inside the hop over the hop's length; zero counts as positive. Only
    complete hops, or with partial a short last one too.
    """
    rows = lagged(samples.withColumn("hop", F.floor(F.col("n") / hop)), "signal_id", "n", "x", 1)
    flips = (F.col("n") % hop != 0) & ((F.col("x") >= 0) != (F.col("x_lag1") >= 0))
    out = rows.groupBy("signal_id", "hop").agg(
        F.count(F.lit(1)).alias("size"),
        dbfs(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("energy_db"),
        (F.sum(F.coalesce(flips, F.lit(False)).cast("int")) / F.count(F.lit(1))).alias("zcr"),
    )
    return out if partial else out.where(F.col("size") == hop)


def peaks_pyramid(samples: DataFrame, base: int, fold: int, levels: int) -> DataFrame:
    """signal_id, level, bin, lo, hi; each level is made from the one below it."""
    level = samples.groupBy("signal_id", F.floor(F.col("n") / base).alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels):
        level = level.groupBy("signal_id", F.floor(F.col("bin") / fold).alias("bin")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def downmix(samples: DataFrame) -> DataFrame:
    """Mean over channels of samples (signal_id, ch, n, x)."""
    return samples.groupBy("signal_id", "n").agg(F.avg("x").alias("x"))


def clip_regions(samples: DataFrame, level: float = 0.9999, least: int = 3) -> DataFrame:
    """Runs of at least `least` samples where a channel reaches the level."""
    from .islands import runs

    return runs(samples, "signal_id", "n", F.abs("x") >= level).where(F.col("length") >= least)


def hop_gain_ramp(samples: DataFrame, gains: DataFrame, hop: int) -> DataFrame:
    """samples times a gain that moves linearly from the last hop's gain to its own hop's.

    gains: signal_id, hop, gain. The first hop holds its own gain.
    """
    steps = lagged(gains, "signal_id", "hop", "gain", 1).select("signal_id", "hop", "gain", F.coalesce("gain_lag1", "gain").alias("prev"))
    rows = samples.withColumn("hop", F.floor(F.col("n") / hop)).join(steps, ["signal_id", "hop"])
    share = (F.col("n") % hop) / F.lit(float(hop))
    return rows.select("signal_id", "n", (F.col("x") * (F.col("prev") + (F.col("gain") - F.col("prev")) * share)).alias("x"))
