"""A session's tracks to one mix: aligned, cleaned, gated, ducked, summed and brought to a target.

Each stage is a plan over all sessions; what one decides (is an alignment trusted, is drift
repaired, how far is a track moved) is a row that the next one joins, and a finding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import decide
from ..sources.storage import settled
from . import blocks, bleedgate, chain, longmaster, multitrack, recursive, spectral
from .grouped import grouped_map, numbers

LEAST_CONFIDENCE, LEAST_PPM, MOST_PPM = 0.15, 2.0, 50.0
#: Seconds of the frames that judge speech under a bed, their step, and dB above a track's floor.
FRAME, STEP, MARGIN_DB = 0.020, 0.010, 12.0
#: Titles of findings.
TITLES = {"unsure": "Alignment not confident", "drift": "Clock drift repaired", "far": "Clock drift too large to repair", "moved": "Track aligned", "bleed": "Bleed ducked", "duck": "Music ducked under speech", "normal": "Mix normalized"}


class Mix(NamedTuple):
    """audio: session, n, x. tracks: what was decided of each. findings: session, track (null: all), level, title, settings (name to number)."""

    audio: DataFrame
    tracks: DataFrame
    findings: DataFrame


KEY = ["session", "track"]


def alignment(samples: DataFrame, tracks: DataFrame, rate: float, **settings) -> DataFrame:
    """tracks (session, track, ...) with reference, offset_seconds, drift_ppm, confidence, trusted, repaired and shift in samples.

    The reference is a session's first track. One that nothing speaks for stays where it is.
    """
    first = tracks.groupBy("session").agg(F.min("track").alias("reference"))
    ref = samples.join(first, "session").where("track = reference").select("session", "n", F.col("x").alias("a"))
    other = samples.join(first, "session").where("track <> reference")
    pairs = other.join(ref, ["session", "n"]).select(F.struct("session", "track").alias("track"), "n", "a", F.col("x").alias("b"))
    found = spectral.align_tracks(settled(pairs, "mix-pairs"), rate, **settings).select("track.session", F.col("track.track").alias("track"), "offset_seconds", "drift_ppm", "confidence")
    rows = tracks.join(first, "session").join(found, KEY, "left")
    own = F.col("track") == F.col("reference")
    rows = rows.withColumns({c: F.when(own, 1.0 if c == "confidence" else 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("offset_seconds", "drift_ppm", "confidence")})
    trusted = own | (F.col("confidence") >= LEAST_CONFIDENCE)
    size = F.abs("drift_ppm")
    return rows.withColumns({"trusted": trusted, "repaired": trusted & (size >= LEAST_PPM) & (size <= MOST_PPM), "shift": F.when(trusted, F.round(F.col("offset_seconds") * rate)).otherwise(0).cast("long")})


def placed(samples: DataFrame, aligned: DataFrame) -> DataFrame:
    """samples with drift repaired and tracks in their places; what lies before the session's start is cut."""
    key = F.struct(*KEY).alias("track")
    ppm = aligned.select(key, F.when(F.col("repaired"), F.col("drift_ppm")).alias("ppm"))
    straight = spectral.repair_drift(samples.select(key, "n", "x"), ppm).select("track.session", F.col("track.track").alias("track"), "n", "x")
    return straight.join(aligned.select(*KEY, "shift"), KEY).select(*KEY, (F.col("n") - F.col("shift")).alias("n"), "x").where("n >= 0")


def fronted(samples: DataFrame, tracks: DataFrame, rate: float, target_lufs: float) -> DataFrame:
    """Speech tracks through the stages that their own reports call for, music through the high-pass only."""
    one = samples.select(F.struct(*KEY).alias("signal_id"), F.lit(0).alias("ch"), "n", "x")
    # Gaps before a track that was moved later are silence.
    spans = one.groupBy("signal_id").agg(F.max("n").alias("end"))
    every = spans.select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), "end")).alias("n"))
    whole = settled(blocks.to_blocks(every.join(one, ["signal_id", "n"], "left").select("signal_id", F.lit(0).alias("ch"), "n", F.coalesce("x", F.lit(0.0)).alias("x"))), "mix-blocks")
    speech = tracks.where("kind = 'speech'").select(F.struct(*KEY).alias("signal_id"))
    report = chain.analyze(blocks.from_blocks(whole.join(speech, "signal_id", "left_semi")), rate)
    facts = {"dc": F.lit(0.0), "diarized": F.lit(False), "target_lufs": F.lit(float(target_lufs)), "ceiling_dbtp": F.lit(-1.0)}
    configured = decide.stages(report.withColumns(facts)).withColumn("denoise_strength", F.lit(None).cast("double")).withColumn("downmix", F.lit(False))
    cleaned, _ = longmaster.front_blocks(whole.join(speech, "signal_id", "left_semi"), configured, rate)
    bed = whole.join(speech, "signal_id", "left_anti")
    passed = blocks.filtered(bed, lambda f: [(1.0, -1.0, 0.0, -0.9975, 0.0), recursive.biquad("highpass", rate, 40.0, 0.7071)])
    both = cleaned.unionByName(passed.select(*cleaned.columns))
    return blocks.from_blocks(both).select("signal_id.session", "signal_id.track", "n", "x")


def speech_frames(samples: DataFrame, rate: float) -> DataFrame:
    """session, frame, speech of speech tracks: whether any is MARGIN_DB above its own quiet tenth."""
    win, hop = round(FRAME * rate), round(STEP * rate)

    def run(group):
        level = bleedgate.frame_levels(numbers(group, "x"), win, hop)
        return {"frame": np.arange(len(level)), "speech": level > recursive.nearest_rank(level, 0.10) + MARGIN_DB}

    return multitrack.union_mask(grouped_map(samples, KEY, ["n"], ["x"], run, "frame long, speech boolean"), "session")


def ducked(beds: DataFrame, frames: DataFrame, rate: float, depth_db: float) -> tuple[DataFrame, DataFrame]:
    """(session, track, n, gain_db; session, track, active_ratio, max_reduction_db) of beds under speech."""
    mask = frames.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "speech"))), lambda s: s["speech"]).alias("mask"))
    rows = settled(beds.groupBy(*KEY).agg(F.max("n").alias("end")).join(mask, "session"), "mix-beds")
    hop = round(STEP * rate)
    told = lambda g: bleedgate.duck_gain(np.array(g["mask"][0].as_py(), bool), hop, int(g["end"][0].as_py()) + 1, rate, depth_db)

    def gain(g):
        db = told(g)[0]
        return {"n": np.arange(len(db)), "gain_db": db}

    def report(g):
        r = told(g)[1]
        return {"active_ratio": [r["active_ratio"]], "max_reduction_db": [r["max_reduction_db"]]}

    return grouped_map(rows, KEY, [], ["end", "mask"], gain, "n long, gain_db double"), grouped_map(rows, KEY, [], ["end", "mask"], report, "active_ratio double, max_reduction_db double")


def mix_sessions(samples: DataFrame, tracks: DataFrame, rate: float, target_lufs: float = -16.0, ceiling_dbtp: float = -1.0, duck_db: float = -12.0, align: bool = True, per_track_chain: bool = True, crossgate: bool = True, **align_settings) -> Mix:
    """The mix of each session of samples (session, track, n, x) and tracks (session, track, kind, gain_db, mute, solo).

    kind: speech or music; track: a number. Muted tracks still gate and duck, as their sound is in the
    others. Sessions without an audible track have no audio; tracks without samples add nothing.
    """
    samples = samples.select(*KEY, "n", F.col("x").cast("double").alias("x")).join(tracks.select(*KEY), KEY, "left_semi")
    known = multitrack.audible(tracks.select(*KEY, "kind", "gain_db", "mute", "solo"), "session")
    if align:
        decided = settled(alignment(samples, known, rate, **align_settings), "mix-aligned")
        samples = settled(placed(samples, decided), "mix-placed")
    else:
        decided = known.withColumns({"reference": F.col("track"), "offset_seconds": F.lit(0.0), "drift_ppm": F.lit(0.0), "confidence": F.lit(1.0), "trusted": F.lit(True), "repaired": F.lit(False), "shift": F.lit(0).cast("long")})
    if per_track_chain:
        samples = settled(fronted(samples, known, rate, target_lufs), "mix-front")
    faders = known.select(*KEY, "kind", "audible", F.pow(F.lit(10.0), F.col("gain_db") / 20).alias("g"))
    samples = settled(samples.join(faders, KEY).select(*KEY, "kind", "audible", "n", (F.col("x") * F.col("g")).alias("x")), "mix-faders")
    speech, beds = samples.where("kind = 'speech'").select(*KEY, "n", "x"), samples.where("kind = 'music'").select(*KEY, "n", "x")
    none = samples.sparkSession.createDataFrame([], f"{', '.join(f'{c} {dict(samples.dtypes)[c]}' for c in KEY)}, n long, gain_db double")
    gates, bleed = none, None
    if crossgate:
        numbered = speech.withColumn("track", F.col("track").cast("long"))
        gates = bleedgate.crossgate(numbered, "session", rate).select("session", F.col("track").cast(dict(samples.dtypes)["track"]).alias("track"), "n", "gain_db")
        bleed = settled(bleedgate.crossgate_report(numbered, "session", rate), "mix-bleed")
    ducks, under = ducked(beds, speech_frames(speech, rate), rate, duck_db)
    under = settled(under, "mix-ducks")
    gains = gates.unionByName(ducks.select(*gates.columns))
    heard = samples.where("audible").join(gains, [*KEY, "n"], "left")
    total = settled(heard.groupBy("session", "n").agg(F.sum(F.col("x") * F.pow(F.lit(10.0), F.coalesce("gain_db", F.lit(0.0)) / 20)).alias("x")), "mix-sum")

    def whole(group) -> np.ndarray:
        n = group["n"].to_numpy()
        x = np.zeros((1, int(n[-1]) + 1))
        x[0, n] = numbers(group, "x")
        return x

    def finish(group):
        y = bleedgate.bus(whole(group), rate, target_lufs, ceiling_dbtp)[0]
        return {"n": np.arange(len(y)), "x": y}

    audio = settled(grouped_map(total, ["session"], ["n"], ["x"], finish, "n long, x double"), "mix-audio")
    level = lambda df, name: grouped_map(df, ["session"], ["n"], ["x"], lambda g: {name: [chain.loudness(whole(g), rate)["integrated_lufs"]]}, f"{name} double")
    levels = settled(level(total, "before_lufs").join(level(audio, "after_lufs"), "session"), "mix-levels")

    def told(rows: DataFrame, level_: str, title: str, **settings) -> DataFrame:
        told_ = F.map_from_arrays(F.array(*map(F.lit, settings)), F.array(*[F.col(c).cast("double") for c in settings.values()]))
        track = F.col("track") if "track" in rows.columns else F.lit(None).cast(dict(samples.dtypes)["track"])
        return rows.select("session", track.alias("track"), F.lit(level_).alias("level"), F.lit(TITLES[title]).alias("title"), told_.alias("settings"))

    findings = [
        told(decided.where("NOT trusted"), "warn", "unsure", confidence="confidence"),
        told(decided.where("repaired"), "info", "drift", ppm="drift_ppm"),
        told(decided.where(F.col("trusted") & (F.abs("drift_ppm") > MOST_PPM)), "warn", "far", ppm="drift_ppm"),
        told(decided.where("shift <> 0"), "info", "moved", seconds="offset_seconds", confidence="confidence"),
        told(under.where("active_ratio > 0"), "info", "duck", share="active_ratio", most_db="max_reduction_db"),
        told(levels, "info", "normal", before="before_lufs", after="after_lufs"),
    ]
    if bleed is not None:
        findings.append(told(bleed.where("active_ratio > 0"), "info", "bleed", source="source", share="active_ratio", most_db="max_reduction_db", veto="veto_ratio"))
    every = findings[0]
    for more in findings[1:]:
        every = every.unionByName(more.select("session", more["track"].cast(dict(every.dtypes)["track"]).alias("track"), "level", "title", "settings"))
    return Mix(audio, decided, settled(every, "mix-findings"))
