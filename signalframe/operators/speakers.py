"""Speaker profiles: gated levels by speaker, their medians, and what speakers sound like alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lufs
from ..functions.stats import averaging_median
from . import spectral
from .intervals import hop_owners
from .islands import framed

WINDOW_HOPS = 300


def gated_hops(hops: DataFrame, key: str, gate: float = -50.0) -> DataFrame:
    """Hops (key, hop, ms, speaker) of a speaker above the gate, and above 10 LU under their mean."""
    loud = hops.where(F.col("speaker").isNotNull() & (lufs(F.col("ms")) > gate))
    mean = loud.groupBy(key, "speaker").agg((lufs(F.avg("ms")) - 10).alias("floor"))
    return loud.join(mean, [key, "speaker"]).where(lufs(F.col("ms")) > F.col("floor")).drop("floor")


def median_levels(gated: DataFrame, key: str, window: int = WINDOW_HOPS) -> DataFrame:
    """key, speaker, hops, median_lufs: median of the means over `window` hops in a row, pauses left out.

    Speakers with fewer hops have one mean, of all of them.
    """
    numbered = gated.withColumn("k", F.row_number().over(Window.partitionBy(key, "speaker").orderBy("hop")) - 1)
    numbered = numbered.withColumn("who", F.struct(key, "speaker"))
    means = framed(numbered, "who", "k", window - 1, 0, lambda w: {"m": F.avg("ms").over(w(-(window - 1), 0))})
    sizes = gated.groupBy(key, "speaker").agg(F.count(F.lit(1)).alias("hops"), F.avg("ms").alias("whole"))
    few = sizes.where(F.col("hops") < window).select(key, "speaker", lufs(F.col("whole")).alias("level"))
    many = means.where(F.col("k") >= window - 1).select(key, "speaker", lufs(F.col("m")).alias("level"))
    return averaging_median(few.unionByName(many), [key, "speaker"], "level", "median_lufs").join(sizes.drop("whole"), [key, "speaker"])


def only_speaker(samples: DataFrame, owners: DataFrame, key: str, hop: int) -> DataFrame:
    """key, speaker, n, x: each speaker's samples one hop after another, renumbered.

    samples: key, n, x; owners: key, hop, speaker.
    """
    place = F.row_number().over(Window.partitionBy(key, "speaker").orderBy("hop")) - 1
    own = owners.where("speaker IS NOT NULL").withColumn("place", place)
    rows = samples.withColumn("hop", F.floor(F.col("n") / hop)).join(own, [key, "hop"])
    return rows.select(key, "speaker", (F.col("place") * hop + F.col("n") % hop).cast("long").alias("n"), "x")


def profiles(samples: DataFrame, hops: DataFrame, key: str, hop: int, rate: float, gate: float = -50.0) -> DataFrame:
    """key, speaker, median_lufs, hops, bands (array of centre_hz, gain_db, q) of each speaker with a gated hop."""
    medians = median_levels(gated_hops(hops, key, gate), key)
    solo = only_speaker(samples, hops.select(key, "hop", "speaker"), key, hop).withColumn("signal_id", F.struct(key, "speaker"))
    fits = spectral.eq_bands(solo.select("signal_id", "n", "x"), rate)
    bands = fits.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("centre_hz", "gain_db", "q"))).alias("bands")).select(F.col(f"signal_id.{key}").alias(key), "signal_id.speaker", "bands")
    return medians.join(bands, [key, "speaker"], "left").withColumn("bands", F.coalesce("bands", F.array().cast("array<struct<centre_hz:double,gain_db:double,q:double>>")))


def with_speakers(configured: DataFrame, turns: DataFrame, gains: DataFrame, rate: float, key: str = "signal_id", hop: int = 480, bands: DataFrame | None = None) -> DataFrame:
    """configured (with duration_secs) with what the per-speaker stage takes: owner, speaker_gains and speaker_bands.

    turns: key, ord, speaker, t_start, t_end; gains: key, speaker, gain_db; bands: key, speaker, bands,
    as profiles() gives them. A hop's owner is the number of its speaker in the order of labels, null
    for nobody. Speakers without a gain keep their level, those without bands their sound; gains of
    speakers without a turn serve nobody. Signals without turns have nulls, which bypass the stage.
    """
    known = turns.where("speaker IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("speaker")).alias("__who"))
    spans = configured.select(key, F.ceil(F.col("duration_secs") * rate / hop).cast("long").alias("__n")).join(known, key).where("__n > 0")
    hops = spans.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("hop"))
    numbered = hop_owners(hops, turns, key, hop / rate).join(known, key)
    number = F.when(F.col("speaker").isNotNull(), F.array_position("__who", F.col("speaker")).cast("int") - 1)
    placed = F.array_sort(F.collect_list(F.struct("hop", number.alias("o"))))
    owner = numbered.groupBy(key).agg(F.transform(placed, lambda s: s["o"]).alias("owner"))

    def by_number(rows: DataFrame, value: str, name: str) -> DataFrame:
        found = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("speaker", value))).alias("__m"))
        return known.join(found, key, "left").select(key, F.transform("__who", lambda w: F.try_element_at("__m", w)).alias(name))

    out = configured.join(owner, key, "left").join(by_number(gains.dropDuplicates([key, "speaker"]), "gain_db", "speaker_gains"), key, "left")
    return out.join(by_number(bands.dropDuplicates([key, "speaker"]), "bands", "speaker_bands"), key, "left") if bands is not None else out
