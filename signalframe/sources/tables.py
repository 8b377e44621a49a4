"""Driver tables and the views that give them the shape of signals, words, turns and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, n, x of events: one signal a user, in time order."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), n.cast("long").alias("n"), F.col("value").alias("x"))


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples less their signal's mean."""
    rows = samples(spark, sf_dir)
    mean = rows.groupBy("signal_id").agg(F.avg("x").alias("m"))
    return rows.join(mean, "signal_id").select("signal_id", "n", F.round(F.col("x") - F.col("m"), 9).alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, n, x of embeddings: one short signed signal a vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), F.posexplode("embedding").alias("n", "x"))
    return rows.select("signal_id", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, seg, s_start, s_end, text of conversations: a turn a minute, 40 s long."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.col("turn").alias("seg"), (F.col("turn") * 60.0).alias("s_start"), (F.col("turn") * 60.0 + 40).alias("s_end"), F.coalesce("text", F.lit("")).alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, word, text, start, end, confidence: words of turns at 0.4 s each, in hundredths of a second."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "text"))
    start = F.col("turn") * 60.0 + F.col("pos") * 0.4
    return rows.select("conv_id", (F.col("turn") * 100_000 + F.col("pos")).alias("word"), "text", F.round(start, 2).alias("start"), F.round(start + 0.3, 2).alias("end"), (((F.col("pos") * 37 + F.col("turn") * 11) % 100) / 100).alias("confidence"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, ord, t_start, t_end, speaker: turns that begin early and end late, so that they leave gaps and overlap."""
    rows = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    start = F.col("turn") * 60.0 - (F.col("turn") % 3) * 5
    return rows.select("conv_id", F.col("turn").alias("ord"), start.alias("t_start"), (start + 30 + (F.col("turn") % 4) * 12).alias("t_end"), speaker.alias("speaker"))
