"""Several tracks on one timeline: audibility, masks, ducking, bleed gates and mixdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .islands import dilate, framed


def audible(tracks: DataFrame, session: str) -> DataFrame:
    """tracks with audible: not muted, and soloed if any track of the session is."""
    solo = F.bool_or("solo").over(Window.partitionBy(session))
    return tracks.withColumn("audible", ~F.col("mute") & (~solo | F.col("solo")))


def union_mask(frames: DataFrame, session: str) -> DataFrame:
    """session, frame, speech: whether any track speaks."""
    return frames.groupBy(session, "frame").agg(F.bool_or("speech").alias("speech"))


def duck_mask(mask: DataFrame, session: str, hangover: int = 10, hold: int = 30, lookahead: int = 20) -> DataFrame:
    """mask with down: speech with its hangover, hold and lookahead in frames."""
    return dilate(mask, session, "frame", "speech", hangover + hold, lookahead, "down")


def duck_target(mask: DataFrame, depth_db: float = -12.0) -> DataFrame:
    depth = max(-24.0, min(-6.0, depth_db))
    return mask.withColumn("wanted", F.when(F.col("down"), F.lit(depth)).otherwise(0.0))


def quiet_floor(levels: DataFrame, session: str) -> DataFrame:
    """track, floor: p10 of a track's frames where no other speaks; of all if those are under a tenth.

    levels: session, track, frame, level, others (whether another track speaks).
    """
    from ..functions.stats import nearest_rank, order_statistic

    keys = [session, "track"]
    quiet = order_statistic(levels.where(~F.col("others")), keys, "level", nearest_rank(0.1), "q")
    every = order_statistic(levels, keys, "level", nearest_rank(0.1), "a")
    n = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("others")).alias("m"))
    rows = n.join(every, keys).join(quiet, keys, "left")
    return rows.select(*keys, F.when(F.col("m") * 10 < F.col("n"), F.col("a")).otherwise(F.coalesce("q", "a")).alias("floor"))


def bleed(samples: DataFrame, session: str, window: int) -> DataFrame:
    """session, track, source, frame, rho, residual: how well each other track explains a frame.

    samples: session, track, n, x, aligned. The last of equal sources is the best one.
    """
    a = samples.select(session, F.col("track").alias("source"), "n", F.col("x").alias("y"))
    pairs = samples.join(a, [session, "n"]).where("track <> source").withColumn("frame", F.floor(F.col("n") / window))
    dot, ea, eb = F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y")), F.sum(F.col("x") * F.col("x"))
    rho = F.when((ea > 1e-12) & (eb > 1e-12), F.least(F.abs(dot) / F.sqrt(ea * eb), F.lit(1.0))).otherwise(0.0)
    return pairs.groupBy(session, "track", "source", "frame").agg(rho.alias("rho"), (eb * (1 - rho * rho)).alias("residual"))


def best_source(pairs: DataFrame, session: str, digits: int = 9) -> DataFrame:
    return pairs.groupBy(session, "track", "frame").agg(F.max_by("source", F.struct(F.round("rho", digits), "source")).alias("source"), F.max("rho").alias("rho"))


def gate_depth(rho, dominance_db, most_db: float = -15.0, coherence: float = 0.6, least_dominance: float = 6.0):
    """dB of reduction where another track explains and outweighs a frame."""
    share = clamp((rho - coherence) / (1 - coherence), 0.0, 1.0)
    return F.when((rho >= coherence) & (dominance_db >= least_dominance), most_db * share).otherwise(0.0)


def opened_early(depths: DataFrame, track: str, lookahead: int) -> DataFrame:
    """A frame ducks only as far as every frame within the lookahead does."""
    return framed(depths, track, "frame", 0, lookahead, lambda w: {"smooth": F.max("depth").over(w(0, lookahead))})


def place(samples: DataFrame, offsets: DataFrame, length: DataFrame, track: str) -> DataFrame:
    """Samples moved by whole offsets (track, offset) and cut to 0..length - 1 (track, length)."""
    moved = samples.join(offsets, track).join(length, track).withColumn("n", F.col("n") - F.col("offset"))
    return moved.where((F.col("n") >= 0) & (F.col("n") < F.col("length"))).drop("offset", "length")


def mixdown(samples: DataFrame, tracks: DataFrame, session: str) -> DataFrame:
    """session, n, x: the sum of audible tracks (session, track, gain_db, audible) at their gains."""
    on = tracks.where("audible").select(session, "track", F.pow(F.lit(10.0), F.col("gain_db") / 20).alias("g"))
    return samples.join(on, [session, "track"]).groupBy(session, "n").agg(F.sum(F.col("x") * F.col("g")).alias("x"))


def segment_crossfade(samples: DataFrame, length: int, overlap: int, key: str = "signal_id") -> DataFrame:
    """Each sample in the one or two overlapping segments that hold it, with its weight in each.

    Weights are linear over the overlap and sum to 1, so that processed segments add up again.
    """
    step = length - overlap
    last = F.floor(F.col("n") / step)
    rows = samples.withColumn("segment", F.explode(F.sequence(F.greatest(F.floor((F.col("n") - length) / step) + 1, F.lit(0)), last)))
    at = F.col("n") - F.col("segment") * step
    rise = F.when(F.col("segment") == 0, 1.0).otherwise(F.least((at + 0.5) / overlap, F.lit(1.0)))
    fall = F.least((F.lit(length) - at - 0.5) / overlap, F.lit(1.0))
    rows = rows.withColumn("weight", F.least(rise, fall))
    return rows


def joined_segments(rows: DataFrame, key: str = "signal_id") -> DataFrame:
    return rows.groupBy(key, "n").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
