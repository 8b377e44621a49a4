"""Command line: analyze, master, targets and notes over files. Exit codes: 0 fine, 1 failed, 2 wrong arguments, 3 off target."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chain, notes
from .plans import decide, jobs, presets
from .sources import readers

RATE = 48_000


def _samples(spark: SparkSession, path: str) -> DataFrame:
    return readers.long_samples(readers.read_wav(spark, path, RATE)).withColumnRenamed("path", "signal_id")


def _configured(spark: SparkSession, samples: DataFrame, preset: str) -> DataFrame:
    """Each signal's configuration, decided from its report and a preset by name."""
    name = presets.resolved(spark.createDataFrame([(preset,)], "name string")).join(presets.presets(spark), "preset_id").select("target_lufs", "ceiling_dbtp")
    report = chain.analyze(samples, RATE).withColumns({"dc": F.array_max(F.transform("dc_offset", F.abs)), "diarized": F.lit(False)})
    return decide.stages(report.crossJoin(F.broadcast(name)))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "targets":
        files = jobs.targets(readers.scan_folder(spark, args.path, jobs.EXTENSIONS))
        for row in jobs.outputs(files, args.path, args.out or args.path).select("path", "output").toLocalIterator():
            print(json.dumps(row.asDict()))
        return 0
    if args.command == "notes":
        segments = spark.read.schema("key string, seg long, s_start double, s_end double, text string").json(args.path)
        for row in notes.show_notes(segments, "key").toLocalIterator():
            print(json.dumps(row.asDict(recursive=True)))
        return 0
    samples = _samples(spark, args.path)
    if args.command == "analyze":
        for row in chain.analyze(samples, RATE).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True)))
        return 0
    configured = _configured(spark, samples, args.preset)
    if args.out:
        readers.write_wav(chain.master(samples, configured, RATE), args.out, RATE)
    fine = True
    for row in chain.master_report(samples, configured, RATE).toLocalIterator():
        print(json.dumps(row.asDict()))
        fine &= row["on_target"]
    return 0 if fine else 3


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="signalframe")
    parser.add_argument("command", choices=["analyze", "master", "targets", "notes"])
    parser.add_argument("path")
    parser.add_argument("--preset", default="podcast_stereo")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("signalframe").getOrCreate()
    try:
        return run(args, spark)
    except Exception as e:  # noqa: BLE001  told to the shell by a code
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
