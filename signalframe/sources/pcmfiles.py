"""PCM files as a data source: blocks by byte range, headers alone, and writers that commit.

    register(spark)
    spark.read.format("pcm_blocks").load(folder)     # path, block, channels, rate, x
    spark.read.format("pcm_headers").load(folder)    # path, duration, rate, channels, format, frames
    write_files(blocks, folder, rate)            # a file a signal, all of it or none

Planning lists files and cuts them by size; a task reads a header and its own blocks, so neither a
file nor its samples are ever whole in memory. Paths are those of pyarrow.fs: local, hdfs, s3, gs.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.blocks import BLOCK, packed, unpacked
from ..operators.grouped import grouped_map
from .readers import pcm

RANGE_BYTES = 16 << 20
#: Files whose headers a task reads.
HEADERS = 1000
#: Fixed value: sizes in a header that mean "up to the end".
UNKNOWN = (0, 0xFFFFFFFF)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)


class Header(NamedTuple):
    """Where a file's samples begin, their bytes, and how they are laid out."""

    at: int
    size: int
    channels: int
    rate: int
    width: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.width)


def header_of(file, size: int) -> Header | None:
    """The header of a RIFF or RF64 file of PCM; None for anything else."""
    start = file.read(12)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64") or start[8:] != b"WAVE":
        return None
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            return None
        name, n = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"ds64":
            long_size = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            rest = size - at - 8
            n = long_size if long_size is not None and n == UNKNOWN[1] else rest if n in UNKNOWN else n
            # 1: PCM; 0xFFFE: the extensible form of it.
            if form is None or form[0] not in (1, 0xFFFE) or not form[1] or not form[2] or form[5] not in (8, 16, 24, 32):
                return None
            return Header(at + 8, min(n, rest), form[1], form[2], form[5] // 8)
        at += 8 + n + n % 2
    return None


def header_bytes(frames: int, channels: int, rate: int, width: int) -> bytes:
    """The header of a PCM file of so many frames; RF64 from 4 GB on."""
    n = frames * channels * width
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    if n + 36 < UNKNOWN[1]:
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", n)
    sizes = struct.pack("<QQQI", 72 + n, n, frames, 0)
    return b"RF64" + struct.pack("<I", UNKNOWN[1]) + b"WAVEds64" + struct.pack("<I", 28) + sizes + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", UNKNOWN[1])


def pcm_bytes(x: np.ndarray, width: int) -> bytes:
    """Interleaved signed PCM of 16, 24 or 32 bits of (channel, sample) values, halves away from zero, clipped."""
    top = 2 ** (8 * width - 1) - 1
    v = np.clip(x, -1, 1) * top
    v = (np.sign(v) * np.floor(np.abs(v) + 0.5)).T
    if width == 3:
        return np.ascontiguousarray(v, "<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return np.ascontiguousarray(v, f"<i{width}").tobytes()


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the .wav files below a folder."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path.rstrip("/")
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.split("/"))
    files = [(f.path[len(inner.rstrip("/")) :], f.size) for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and f.path.lower().endswith(".wav")]
    return sorted((prefix + p, n) for p, n in files if not hidden(p))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        return [Range(path, size, at, min(at + self.range, size)) for path, size in listed(self.path) for at in range(0, max(size, 1), self.range)]

    def read(self, partition: Range | None):
        """The blocks that begin in the range; without files there is no range."""
        if partition is None:
            return
        system, inner = opened(partition.path)
        with system.open_input_file(inner) as file:
            head = header_of(file, partition.size)
            if head is None or not head.frames:
                return
            frame = head.channels * head.width
            each, end = BLOCK * frame, head.at + head.frames * frame
            block = max(0, -(-(partition.start - head.at) // each))
            while (at := head.at + block * each) < min(partition.end, end):
                file.seek(at)
                x = pcm(file.read(min(each, end - at)), head.width, head.channels)
                columns = [pa.array([partition.path]), pa.array([block], pa.int64()), pa.array([head.channels], pa.int32()), pa.array([head.rate], pa.int32()), pa.array([packed(x)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "channels", "rate", "x"])
                block += 1


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        found = listed(self.path)
        return [Files(found[k : k + HEADERS]) for k in range(0, len(found), HEADERS)] or [Files([])]

    def read(self, partition: Files):
        for path, size in partition.found:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                h = header_of(file, size)
            yield (path, h.frames / h.rate, h.rate, h.channels, f"pcm_s{8 * h.width}" if h.width > 1 else "pcm_u8", h.frames) if h else (path, None, None, None, None, None)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]


class FileWriter(DataSourceWriter):
    """A file a signal, from rows (name, block, frames, channels, x) in order; see write_files().

    Tasks write below a folder of this job; commit moves whole files to their places, abort removes
    the folder, so no part of a file is ever seen. What a failed attempt of a task wrote goes with it.
    """

    def __init__(self, options: dict):
        self.path, self.rate, self.width = options["path"].rstrip("/"), int(options["rate"]), int(options.get("width", 2))
        self.folder = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, folder = opened(f"{self.folder}/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        done, out, name, block, frames, total = [], None, None, 0, 0, 0

        def close():
            if out is not None:
                out.close()
                if frames != total:
                    raise ValueError(f"{name}: {frames} of {total} frames")

        for row in iterator:
            if row["name"] != name or out is None:
                close()
                name, block, frames, total = row["name"], 0, 0, row["frames"]
                file = quote(str(name), safe="") + ".wav"
                out = system.open_output_stream(f"{folder}/{file}")
                out.write(header_bytes(total, row["channels"], self.rate, self.width))
                done.append((f"{folder}/{file}", file))
            if row["block"] != block:
                raise ValueError(f"{name}: block {block} is missing")
            x = unpacked(row["x"]).reshape(row["channels"], -1)
            out.write(pcm_bytes(x, self.width))
            block, frames = block + 1, frames + x.shape[1]
        close()
        return Written(done)

    def commit(self, messages):
        system, inner = opened(self.path)
        for made, file in (f for m in messages if m is not None for f in m.files):
            if system.get_file_info(f"{inner}/{file}").type != fs.FileType.NotFound:
                system.delete_file(f"{inner}/{file}")
            system.move(made, f"{inner}/{file}")
        self.abort(messages)

    def abort(self, messages):
        system, folder = opened(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class PartWriter(DataSourceStreamWriter):
    """Blocks of a stream, rows (name, block, last, channels, x), as parts that a batch's manifest names.

    A batch counts from the moment its manifest is there; told again after a failure, it finds the
    manifest and adds nothing. finish_files() makes files of signals whose blocks are all there.
    """

    def __init__(self, options: dict):
        self.path, self.width = options["path"].rstrip("/"), int(options.get("width", 2))

    def write(self, iterator):
        system, folder = opened(f"{self.path}/_parts/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        done = []
        for row in iterator:
            x = unpacked(row["x"]).reshape(row["channels"], -1)
            file = f"{folder}/{len(done)}.pcm"
            with system.open_output_stream(file) as out:
                out.write(pcm_bytes(x, self.width))
            done.append((row["name"], row["block"], bool(row["last"]), row["channels"], x.shape[1], file))
        return Written(done)

    def commit(self, messages, batchId):
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/_manifests", recursive=True)
        place = f"{inner}/_manifests/{batchId}.json"
        if system.get_file_info(place).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        made = f"{place}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(made) as out:
            out.write("\n".join(json.dumps(f) for m in messages if m is not None for f in m.files).encode())
        system.move(made, place)

    def abort(self, messages, batchId):
        system, _ = opened(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            if system.get_file_info(f[-1]).type != fs.FileType.NotFound:
                system.delete_file(f[-1])


class PcmBlocks(DataSource):
    @classmethod
    def name(cls):
        return "pcm_blocks"

    def schema(self):
        return "path string, block long, channels int, rate int, x binary"

    def reader(self, schema):
        return BlockReader(self.options)

    def writer(self, schema, overwrite):
        return FileWriter(self.options)

    def streamWriter(self, schema, overwrite):
        return PartWriter(self.options)


class PcmHeaders(DataSource):
    @classmethod
    def name(cls):
        return "pcm_headers"

    def schema(self):
        return "path string, duration double, rate int, channels int, format string, frames long"

    def reader(self, schema):
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmBlocks)
    spark.dataSource.register(PcmHeaders)


def write_files(blocks: DataFrame, path: str, rate: int, key: str = "signal_id", width: int = 2) -> None:
    """A PCM file `<key>.wav` of each signal of blocks (key, block, channels, x) below path; files of those names are replaced.

    A signal's blocks are written by one task, block by block. All files appear when all are whole:
    a signal that lacks a block fails the job, and a failed job leaves none. A null key is "null".
    """
    register(blocks.sparkSession)
    size = F.when(F.col("channels") > 0, F.octet_length("x") / (8 * F.col("channels"))).otherwise(0)
    rows = blocks.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("name"), "block", "channels", "x")
    totals = rows.groupBy("name").agg(F.sum(size).cast("long").alias("frames"))
    rows = rows.join(totals, "name").repartition("name").sortWithinPartitions("name", "block")
    rows.select("name", "block", "frames", "channels", "x").write.format("pcm_blocks").mode("append").option("path", path).option("rate", rate).option("width", width).save()


def write_parts(stream: DataFrame, path: str, checkpoint: str, key: str = "signal_id", width: int = 2, **options):
    """The running query that puts a stream's blocks (key, block, last, channels, x) below path; see PartWriter."""
    register(stream.sparkSession)
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("name"), "block", "last", "channels", "x")
    return rows.writeStream.format("pcm_blocks").outputMode("append").option("path", path).option("width", width).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def finish_files(spark: SparkSession, path: str, rate: int, width: int = 2) -> list[str]:
    """Files of the signals whose last block and all before it are committed; the names of those that appeared now.

    A task copies a signal's parts, one after another, and moves the whole file to its place.
    """
    system, inner = opened(path.rstrip("/"))
    if system.get_file_info(f"{inner}/_manifests").type == fs.FileType.NotFound:
        return []
    manifests = [f.path for f in system.get_file_info(fs.FileSelector(f"{inner}/_manifests")) if f.path.endswith(".json")]
    read = spark.read.schema("line string").text([f"file://{m}" if isinstance(system, fs.LocalFileSystem) else f"{path.split('://')[0]}://{m}" for m in manifests]).where("line <> ''")
    told = read.select(F.from_json("line", "array<string>").alias("f"))
    parts = told.select(F.col("f")[0].alias("name"), F.col("f")[1].cast("long").alias("block"), F.col("f")[2].cast("boolean").alias("last"), F.col("f")[3].cast("int").alias("channels"), F.col("f")[4].cast("long").alias("frames"), F.col("f")[5].alias("file")).dropDuplicates(["name", "block"])
    whole = parts.groupBy("name").agg(F.max(F.when(F.col("last"), F.col("block"))).alias("end"), F.count(F.lit(1)).alias("n"), F.sum("frames").alias("total"), F.max("channels").alias("channels")).where("end IS NOT NULL AND n = end + 1").select("name", "total")
    rows = parts.join(whole, "name").select("name", "block", "channels", "file", "total").repartition("name").sortWithinPartitions("name", "block")

    def assemble(group):
        name, total, channels = (group[c][0].as_py() for c in ("name", "total", "channels"))
        place = f"{inner}/{quote(str(name), safe='')}.wav"
        own, _ = opened(path)
        if own.get_file_info(place).type != fs.FileType.NotFound:
            return None
        made = f"{inner}/_parts/{uuid.uuid4().hex}.wav"
        with own.open_output_stream(made) as out:
            out.write(header_bytes(total, channels, rate, width))
            for file in group["file"].to_pylist():
                with own.open_input_stream(file) as part:
                    while piece := part.read(1 << 22):
                        out.write(piece)
        own.move(made, place)
        return {"made": [place]}

    done = grouped_map(rows, ["name"], ["block"], ["channels", "file", "total"], assemble, "made string").collect()
    return sorted(r["name"] for r in done)
