"""Model files: what is known, what is there, and whether it is whole. And results kept by what they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import settled

KNOWN = "id string, kind string, file string, bytes long, sha256 string"


def known(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """KNOWN models as a table; sha256 may be null where no hash is published."""
    return spark.createDataFrame(entries, KNOWN)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """file, path, bytes, found_sha256 of the files under a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("found_sha256"))


def located(models: DataFrame, files: DataFrame) -> DataFrame:
    """models with path and state: missing, wrong size, wrong hash, unverified (no hash published) or ok.

    files: file, path, bytes and, to check contents, found_sha256. Of several files of one name the
    first path counts.
    """
    one = files.groupBy("file").agg(F.min_by(F.struct(*files.columns), "path").alias("f"))
    rows = models.join(one, "file", "left")
    sure = F.col("f.found_sha256") if "found_sha256" in files.columns else F.lit(None).cast("string")
    state = (
        F.when(F.col("f").isNull(), "missing")
        .when(F.col("f.bytes") != F.col("bytes"), "wrong size")
        .when(F.col("sha256").isNull() | sure.isNull(), "unverified")
        .when(F.lower("sha256") != sure, "wrong hash")
        .otherwise("ok")
    )
    return rows.select(*models.columns, F.col("f.path").alias("path"), state.alias("state"))


class StageCache:
    """Results of stages by the plan they read and their settings: the same question is answered once a session."""

    def __init__(self) -> None:
        self.tables: dict[tuple[int, str], DataFrame] = {}

    def get(self, source: DataFrame, settings: dict, make: Callable[[DataFrame], DataFrame], tag: str = "stage") -> DataFrame:
        """make(source), written to the shared folder the first time."""
        name = (source.semanticHash(), tag + repr(sorted(settings.items())))
        if name not in self.tables:
            self.tables[name] = settled(make(source), tag)
        return self.tables[name]


def merged_tags(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """path, tags (map) where updates replace stored values of the same name, empty ones remove them, and others stay."""
    rows = stored.select("path", F.col("tags").alias("old")).join(updates.select("path", F.col("tags").alias("new")), "path", "full")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return rows.select("path", F.map_concat(kept, F.map_filter(new, lambda k, v: v != "")).alias("tags"))


# Formats that an output can have, with their default kilobits a second (none: lossless).
FORMATS = [("wav", None), ("flac", None), ("mp3", 192), ("aac", 192), ("opus", 96), ("vorbis", 160), ("audiobook", 64)]


def output_errors(specs: DataFrame, key: str) -> DataFrame:
    """key, error of output specs (key, format, kbps, channels, bits): unknown formats and impossible settings."""
    names = [f for f, _ in FORMATS]
    lossless = F.col("format").isin([f for f, k in FORMATS if k is None])
    errors = F.array(
        F.when(~F.coalesce(F.col("format").isin(names), F.lit(False)), "unknown format"),
        F.when(lossless & F.col("kbps").isNotNull(), "a lossless format has no bitrate"),
        F.when(~lossless & ~F.coalesce(F.col("kbps").between(8, 512), F.lit(True)), "bitrate out of range"),
        F.when(~F.coalesce(F.col("channels").isin(1, 2), F.lit(True)), "one or two channels"),
        F.when(~F.coalesce(F.col("bits").isin(16, 24, 32), F.lit(True)), "16, 24 or 32 bits"),
    )
    return specs.select(key, F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))
