"""Shipped presets as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_id

# Id, name, tier, target loudness and true-peak ceiling of the shipped presets.
PRESETS = [
    ("podcast_stereo", "Podcast (Stereo −16)", "standard", -16.0, -1.0),
    ("podcast_mono", "Podcast (Mono −19)", "standard", -19.0, -1.0),
    ("spotify_youtube", "Spotify/YouTube −14", "standard", -14.0, -1.0),
    ("broadcast_ebu", "Broadcast EBU −23", "standard", -23.0, -1.0),
    ("audiobook_acx", "Audiobook (ACX)", "standard", -20.5, -3.0),
    ("voice_memo_cleanup", "Voice memo cleanup", "fast", -16.0, -1.0),
    ("music_heavy_show", "Music-heavy show", "fast", -14.0, -1.0),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, *p) for p in PRESETS], "schema_version int, preset_id string, preset_name string, tier string, target_lufs double, ceiling_dbtp double")


# Short names of the shipped presets.
ALIASES = [
    ("stereo", "podcast_stereo"), ("podcast", "podcast_stereo"), ("mono", "podcast_mono"), ("spotify", "spotify_youtube"), ("youtube", "spotify_youtube"), ("streaming", "spotify_youtube"),
    ("broadcast", "broadcast_ebu"), ("ebu", "broadcast_ebu"), ("r128", "broadcast_ebu"), ("acx", "audiobook_acx"), ("audiobook", "audiobook_acx"),
    ("voice", "voice_memo_cleanup"), ("voice-memo", "voice_memo_cleanup"), ("music", "music_heavy_show"),
]


def resolved(names: DataFrame, name: str = "name") -> DataFrame:
    """names with preset_id: that of a shipped preset, in any case and with - for _, or of an alias; null for others."""
    known = [(p[0].replace("_", "-"), p[0]) for p in PRESETS]
    # Ids come before aliases of the same spelling.
    table = names.sparkSession.createDataFrame(list((dict(ALIASES) | dict(known)).items()), "canonical string, preset_id string")
    return names.withColumn("canonical", canonical_id(F.col(name))).join(F.broadcast(table), "canonical", "left").drop("canonical")
