"""Readers of transcripts, turns, manifests, folders and PCM files, and their writers."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASR = "result struct<language:string>, transcription array<struct<text:string, offsets:struct<`from`:bigint, `to`:bigint>, tokens array<struct<text:string, p:double>>>>".replace("tokens array", "tokens:array")


def asr_words(documents: DataFrame, key: str, body: str) -> DataFrame:
    """key, word, text, start, end, confidence of recogniser JSON: milliseconds to seconds.

    Blank entries are skipped; confidence is the mean over tokens that don't start with '[', or 0.
    """
    parsed = documents.select(key, F.from_json(body, ASR).alias("j"))
    rows = parsed.select(key, F.posexplode("j.transcription").alias("pos", "t")).where(F.trim("t.text") != "")
    scored = F.filter(F.coalesce("t.tokens", F.array().cast("array<struct<text:string,p:double>>")), lambda k: ~F.ltrim(k["text"]).startswith("["))
    mean = F.when(F.size(scored) > 0, F.aggregate(scored, F.lit(0.0), lambda a, k: a + k["p"]) / F.size(scored)).otherwise(0.0)
    word = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return rows.select(key, word.alias("word"), F.trim("t.text").alias("text"), (F.col("t.offsets.from") / 1000).alias("start"), (F.col("t.offsets.to") / 1000).alias("end"), mean.alias("confidence"))


def diarization_turns(lines: DataFrame, key: str, line: str = "value", order: str | None = None) -> DataFrame:
    """key, start, end, label, speaker of 'start -- end label' lines; others are skipped.

    A turn that ends before it starts fails the query. Speakers are numbered by first appearance in
    (start, end) order; equal ones by `order`, the lines' number, if that is given, or by label.
    """
    pattern = r"^\s*(\S+)\s+--\s+(\S+)\s+(\S+)\s*$"
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    got = [F.regexp_extract(line, pattern, i) for i in (1, 2, 3)]
    rows = lines.where(F.col(line).rlike(pattern)).withColumns({"__s": got[0], "__e": got[1], "label": got[2]}).where(F.col("__s").rlike(number) & F.col("__e").rlike(number))
    rows = rows.withColumns({"__s": F.col("__s").cast("double"), "__e": F.col("__e").cast("double")})
    wrong = F.raise_error(F.concat(F.lit("turn ends before it starts: "), F.col(line))).cast("double")
    rows = rows.select(key, F.col("__s").alias("start"), F.when(F.col("__e") < F.col("__s"), wrong).otherwise(F.col("__e")).alias("end"), "label", *([F.col(order).alias("__o")] if order else []))
    first = rows.groupBy(key, "label").agg(F.min(F.struct("start", "end", *(["__o"] if order else []))).alias("f"))
    first = first.withColumn("speaker", F.row_number().over(Window.partitionBy(key).orderBy("f", "label")) - 1).drop("f")
    return rows.drop("__o").join(first, [key, "label"])


def rttm_turns(lines: DataFrame, line: str = "value") -> DataFrame:
    """file, label, start, end of SPEAKER lines with 8 fields or more."""
    f = F.split(F.trim(line), r"\s+")
    rows = lines.where((f[0] == "SPEAKER") & (F.size(f) >= 8)).select(f[1].alias("file"), f[7].alias("label"), f[3].try_cast("double").alias("start"), f[4].try_cast("double").alias("d"))
    return rows.where("start IS NOT NULL AND d IS NOT NULL").select("file", "label", "start", (F.col("start") + F.col("d")).alias("end"))


def banner_chapters(texts: DataFrame, key: str, body: str) -> DataFrame:
    """key, chapter, start, end of 'Chapter #0:1: start 1.0, end 2.0' lines."""
    found = F.regexp_extract_all(body, F.lit(r"Chapter #[0-9]+[:.][0-9]+: start [0-9.]+, end [0-9.]+"), F.lit(0))
    rows = texts.select(key, F.posexplode(found).alias("chapter", "c"))
    return rows.select(key, "chapter", F.regexp_extract("c", r"start ([0-9.]+)", 1).try_cast("double").alias("start"), F.regexp_extract("c", r"end ([0-9.]+)", 1).try_cast("double").alias("end"))


def chapter_metadata(chapters: DataFrame, key: str) -> DataFrame:
    """key, body: chapters (key, start, end, title) as a metadata text, = ; # \\ and line feeds escaped."""
    title = F.regexp_replace(F.regexp_replace("title", r"([=;#\\])", r"\\$1"), "\n", "\\\\\n")
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    part = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms("start"), F.lit("\nEND="), ms("end"), F.lit("\ntitle="), title, F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", part.alias("p")))), lambda x: x["p"]), "")
    return chapters.groupBy(key).agg(F.concat(F.lit(";FFMETADATA1\n"), body).alias("body"))


def scan_folder(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, size, modified of files under root with one of the extensions; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(ext.isin(extensions))


def json_documents(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Whole-file JSON documents; schema_version beyond version is an error, a missing path no rows."""
    try:
        rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    newer = F.coalesce("schema_version", F.lit(1)) > version
    return rows.where(F.when(newer, F.raise_error(F.lit("a document is newer than this reader"))).otherwise(F.lit(True)).cast("boolean")) if "schema_version" in rows.columns else rows


def probe_wav(content: bytes) -> tuple[float, int, int, str] | None:
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), f"pcm_s{8 * w.getsampwidth()}"
    except (wave.Error, EOFError):
        return None


def resample(x: np.ndarray, source: int, target: int, lobes: int = 16) -> np.ndarray:
    """Band-limited, by a windowed sinc; the same samples at equal rates. Length is frames * target / source, rounded.

    When the rate falls, the kernel widens so that nothing above the new band is left.
    """
    if source == target or not len(x):
        return x
    return resample_at(x, source, target, 0, int(np.floor(len(x) * target / source + 0.5)), 0, lobes)


def resample_at(x: np.ndarray, source: int, target: int, first: int, last: int, begin: int, lobes: int = 16) -> np.ndarray:
    """The samples first..last-1 of resample() of a signal of which x is the part from place begin on."""
    cut = min(1.0, target / source)
    half = int(np.ceil(lobes / cut))
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    out = np.empty(last - first)
    taps = np.arange(1 - half, half + 1)
    for lo in range(first, last, 1 << 15):
        at = np.arange(lo, min(last, lo + (1 << 15))) * source / target
        base = np.floor(at).astype(np.int64)
        t = (at - base)[:, None] - taps
        kernel = cut * np.sinc(cut * t) * np.cos(np.pi * np.clip(t / (2 * half), -0.5, 0.5)) ** 2
        kernel /= np.maximum(kernel.sum(axis=1, keepdims=True), 1e-12)
        out[lo - first : lo - first + len(at)] = (padded[(base - begin)[:, None] + taps + half] * kernel).sum(axis=1)
    return out


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """(channel, sample) values of PCM bytes of 8 (unsigned), 16, 24 or 32 bits."""
    if width == 1:
        v = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        v = np.concatenate([np.zeros((len(b), 1), np.uint8), b], axis=1).view("<i4").ravel() / 2.0**31
    else:
        v = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return v.reshape(-1, channels).T


def probe(files: DataFrame) -> DataFrame:
    """path, duration, rate, channels, format of binary files (path, content); nulls for those that aren't PCM."""

    def facts(batches):
        for batch in batches:
            found = [probe_wav(c) or (None,) * 4 for c in batch["content"]]
            yield pd.DataFrame([(p, *f) for p, f in zip(batch["path"], found, strict=True)], columns=["path", "duration", "rate", "channels", "format"])

    return files.select("path", "content").mapInPandas(facts, "path string, duration double, rate int, channels int, format string")


def read_wav(spark: SparkSession, path: str, rate: int = 48_000, block: int = 4_800) -> DataFrame:
    """path, ch, block_no, x (array<float>) of PCM files at the given rate; bad files give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                facts = probe_wav(content)
                if facts is None:
                    continue
                with wave.open(io.BytesIO(content)) as w:
                    data = [resample(c, w.getframerate(), rate) for c in pcm(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())]
                for ch, x in enumerate(data):
                    rows = [(p, ch, i // block, x[i : i + block].astype(np.float32)) for i in range(0, len(x), block)]
                    yield pd.DataFrame(rows, columns=["path", "ch", "block_no", "x"])

    return files.mapInPandas(decode, "path string, ch int, block_no long, x array<float>")


def long_samples(blocks: DataFrame, block: int = 4_800) -> DataFrame:
    """path, ch, n, x from blocks."""
    return blocks.select("path", "ch", "block_no", F.posexplode("x").alias("i", "x")).select("path", "ch", (F.col("block_no") * block + F.col("i")).alias("n"), "x")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of channel-by-sample values."""
    v = np.clip(samples, -1, 1) * 32767
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(samples))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.sign(v) * np.floor(np.abs(v) + 0.5)).astype("<i2").T.tobytes())
    return out.getvalue()


def write_wav(samples: DataFrame, path: str, rate: int, key: str = "signal_id") -> None:
    """A table of key, name and content (16-bit PCM files) at path, of samples (key, ch, n, x).

    Files are rows, so the sink is any that Spark can write; a signal is encoded where it is grouped.
    """
    from ..operators.grouped import grouped_map, numbers

    def run(group):
        rows = len(np.unique(group["ch"].to_numpy()))
        return {"content": [wav_bytes(numbers(group, "x").reshape(rows, -1), rate)]}

    out = grouped_map(samples, [key], ["ch", "n"], ["x"], run, "content binary")
    out.select(key, F.concat(F.regexp_replace(F.regexp_extract(F.col(key).cast("string"), r"([^/\\]*)$", 1), r"\.[^.]*$", ""), F.lit("_mastered.wav")).alias("name"), "content").write.parquet(path)


def write_blocks(blocks: DataFrame, path: str, checkpoint: str | None = None):
    """Blocks of samples to Parquet: a table at once, or of a stream each micro-batch, and then the running query."""
    if not blocks.isStreaming:
        blocks.write.mode("append").parquet(path)
        return None

    def sink(batch: DataFrame, number: int) -> None:
        # A batch that is told again after a failure replaces its own files.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return blocks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def output_format(path: Column) -> Column:
    """Target of an output path's extension; null for one that isn't known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("wav", "wave"), "wav").when(ext.isin("flac", "mp3", "opus"), ext).when(ext.isin("m4a", "aac"), "aac").when(ext == "m4b", "audiobook").when(ext.isin("ogg", "oga"), "vorbis")


def loudness_summary(texts: DataFrame, key: str, body: str) -> DataFrame:
    """key, lufs, range_lu, true_peak from the last summary block of a meter's log."""
    last = F.substring_index(body, "Summary:", -1)
    number = lambda p: F.regexp_extract(last, p, 1).try_cast("double")
    return texts.where(F.instr(body, "Summary:") > 0).select(key, number(r"I:\s+(-?[0-9.]+) LUFS").alias("lufs"), number(r"LRA:\s+(-?[0-9.]+) LU\b").alias("range_lu"), number(r"Peak:\s+(-?[0-9.]+) dBFS").alias("true_peak"))
