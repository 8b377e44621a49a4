"""Signals in blocks against the same work on whole signals, and PCM files by byte range."""

import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from signalframe.operators import blocks, chain, folds, longmaster, recursive, speakers
from signalframe.plans import decide
from signalframe.sources import pcmfiles, readers

RATE = 48_000.0


def table(spark, path, signals):
    parts = [pa.table({"signal_id": [k] * x.shape[1], "ch": pa.array(np.full(x.shape[1], c), pa.int32()), "n": np.arange(x.shape[1]), "x": x[c]}) for k, x in signals.items() for c in range(len(x))]
    pq.write_table(pa.concat_tables(parts), f"{path}/in.parquet")
    return spark.read.parquet(f"{path}/in.parquet")


def arrays(df):
    got = {}
    for r in df.orderBy("signal_id", "block").collect():
        got.setdefault(r["signal_id"], []).append(np.frombuffer(r["x"]).reshape(r["channels"], -1))
    return {k: np.concatenate(v, axis=1) for k, v in got.items()}


def voice(n, seed, pitch):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / RATE
    x = np.where(np.sin(2 * np.pi * 3 * t) > 0, 0.08, 0.0005) * (np.sin(2 * np.pi * pitch * t) + 0.3 * rng.standard_normal(n)) + 0.004 * np.sin(2 * np.pi * 50 * t)
    x[rng.integers(1000, n - 1000, 20)] += 0.5
    return x


CONFIG = dict(cutoff_hz=80.0, dehum_hz=50.0, declip=True, music_ratio=0.0, declick_gate=-60.0, decrackle_ratio=6.0, breath=True, noise_floor_dbfs=-55.0, deess_threshold=0.3, autoeq=True, bandwidth_hz=16000.0, noise_gate_lufs=-45.0, warm_start_db=3.0, music_mode=False, target_lufs=-16.0, ceiling_dbtp=-1.0)


@pytest.fixture(scope="module")
def signals():
    n = int(12.3 * RATE)  # more than one chunk
    return {"a": np.stack([voice(n, 1, 220), voice(n, 2, 233)]), "b": np.clip(voice(n - 777, 3, 180)[None] * 16, -1, 1), "c": voice(5000, 4, 200)[None]}


@pytest.fixture(scope="module")
def block_table(spark, signals, tmp_path_factory):
    df = blocks.to_blocks(table(spark, tmp_path_factory.mktemp("blocks"), signals))
    path = f"{tmp_path_factory.mktemp('blocks')}/t"
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_blocks_hold_the_samples(block_table, signals):
    assert all(np.array_equal(v, signals[k]) for k, v in arrays(block_table).items())
    rows = blocks.from_blocks(block_table.where("signal_id = 'c'")).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(5000)) and np.array_equal([r["x"] for r in rows], signals["c"][0])


def test_filters_by_scan_are_the_whole_filters(block_table, signals):
    """Slow notches, whose states outlast many blocks."""
    cascade = [recursive.biquad("notch", RATE, 50.0 * k, 60.0) for k in (1, 2, 3)] + [recursive.biquad("highpass", RATE, 30.0, 0.7071)]
    for size in (1, 3, 16):
        got = arrays(blocks.filtered(block_table, lambda f: cascade, size=size))
        assert all(np.abs(got[k] - np.stack([recursive.run_filters(c, cascade) for c in x])).max() < 1e-9 for k, x in signals.items())


def test_median_of_all_samples(block_table, signals):
    got = {r["signal_id"]: r["m"] for r in blocks.upper_median(block_table, lambda c: c.x[:, c.lo : c.hi].ravel(), "m").collect()}
    for k, x in signals.items():
        v = np.sort(np.abs(x).ravel())
        assert got[k] == v[len(v) // 2]


def test_convolution_and_resampling(block_table, signals):
    kernel = np.random.default_rng(5).standard_normal(70_001) * np.exp(-np.arange(70_001) / 9000)
    got = arrays(blocks.convolved(block_table, kernel))
    for k, x in signals.items():
        n = x.shape[1] + len(kernel)
        want = [np.fft.irfft(np.fft.rfft(c, n) * np.fft.rfft(kernel, n), n)[: x.shape[1]] for c in x]
        assert np.abs(got[k] - want).max() < 1e-9
    short = kernel[:40]
    assert np.abs(arrays(blocks.convolved(block_table, short))["c"][0] - np.convolve(signals["c"][0], short)[:5000]).max() < 1e-9
    for target in (44_100, 16_000, 96_000):
        got = arrays(blocks.resampled(block_table, 48_000, target))
        for k, x in signals.items():
            want = np.stack([readers.resample(c, 48_000, target) for c in x])
            assert got[k].shape == want.shape and np.abs(got[k] - want).max() < 1e-9


def test_loudness_of_blocks(block_table, signals):
    got = {r["signal_id"]: r for r in longmaster.block_loudness(block_table, RATE).collect()}
    for k, x in signals.items():
        assert all(abs(got[k][name] - v) < 1e-9 for name, v in chain.loudness(x, RATE).items())


def test_mastering_in_blocks_is_mastering_the_whole(spark, block_table, signals):
    loud = CONFIG | {"target_lufs": -9.0, "downmix": True, "declip": False, "dehum_hz": None}
    wanted = {"a": CONFIG | {"downmix": False}, "b": CONFIG | {"downmix": False}, "c": loud}
    names = list(loud)
    configured = spark.createDataFrame([(k, *(c[n] for n in names)) for k, c in wanted.items()], "signal_id string, " + ", ".join(f"{n} {'boolean' if isinstance(loud[n], bool) else 'double'}" for n in names))
    out, report = longmaster.master_blocks(block_table, configured, RATE)
    got, told = arrays(out), {r["signal_id"]: r for r in report.collect()}
    for k, x in signals.items():
        y, gain, probes = chain.render(x, RATE, wanted[k])
        assert np.abs(got[k] - y).max() < 1e-9, k
        assert abs(told[k]["drive_db"] - gain) < 1e-6 and told[k]["probes"] == probes
        assert abs(told[k]["after_lufs"] - chain.loudness(y, RATE)["integrated_lufs"]) < 1e-6
    assert blocks.over_chunks(block_table.where("false"), lambda c: {"n": [1]}, "n int").count() == 0


def test_mastering_blocks_without_configuration(spark, block_table, signals):
    none = spark.createDataFrame([], "signal_id string, target_lufs double")
    out, _ = longmaster.master_blocks(block_table.where("signal_id = 'c'"), none, RATE, dither_bits=16, dither_seed=7)
    y = chain.render(signals["c"], RATE, {})[0]
    assert np.abs(arrays(out)["c"] - recursive.dither(y[0], 16, 7)).max() < 1e-9


def test_speakers_reach_the_master(spark, block_table, signals):
    """Turns and profiles as tables; blocks give what whole signals give."""
    n = signals["a"].shape[1]
    seconds = n / RATE
    spans = [(0, 0.0, 3.0, "eve"), (1, 3.0, 7.5, "bob"), (2, 7.0, 9.0, "eve"), (3, 9.5, 99.0, "bob")]
    turns = spark.createDataFrame([("a", o, w, s, e) for o, s, e, w in spans], "signal_id string, ord int, speaker string, t_start double, t_end double")
    gains = spark.createDataFrame([("a", "eve", 6.0), ("a", "bob", -9.0), ("a", "nobody", 3.0)], "signal_id string, speaker string, gain_db double")
    bell = [(1000.0, 3.0, 1.0)]
    bands = spark.createDataFrame([("a", "eve", bell)], "signal_id string, speaker string, bands array<struct<centre_hz:double,gain_db:double,q:double>>")
    base = spark.createDataFrame([("a", seconds, True, -16.0, -1.0), ("c", 0.1, True, -16.0, -1.0)], "signal_id string, duration_secs double, speaker_leveling boolean, target_lufs double, ceiling_dbtp double")
    configured = speakers.with_speakers(base, turns, gains, RATE, bands=bands)
    row = {r["signal_id"]: r for r in configured.collect()}
    assert row["a"]["speaker_gains"] == [-9.0, 6.0] and row["c"]["owner"] is None and len(row["a"]["owner"]) == -(-n // 480)
    assert row["a"]["owner"][0] == 1 and row["a"]["owner"][400] == 0 and row["a"]["owner"][720] == 1 and row["a"]["owner"][920] is None
    owner = np.array([-1 if o is None else o for o in row["a"]["owner"]])
    whole = chain.front(signals["a"], RATE, row["a"].asDict(recursive=True))
    plain = chain.front(signals["a"], RATE, {"target_lufs": -16.0})
    assert not np.allclose(whole, plain)
    y, _ = longmaster.front_blocks(block_table.where("signal_id <> 'b'"), configured, RATE)
    got = arrays(y)
    assert np.abs(got["a"] - whole).max() < 1e-9
    assert np.abs(got["c"] - chain.front(signals["c"], RATE, {"target_lufs": -16.0})).max() < 1e-9
    # Owners of another length than the hops: what is missing is nobody's, what is over is left out.
    x, g = signals["a"], {0: -9.0, 1: 6.0}
    assert np.array_equal(recursive.level_speakers(x, RATE, np.append(owner, [1, 1]), g), recursive.level_speakers(x, RATE, owner, g))
    assert np.array_equal(recursive.level_speakers(x, RATE, owner[:500], g), recursive.level_speakers(x, RATE, np.concatenate([owner[:500], np.full(len(owner) - 500, -1)]), g))


def test_a_stage_of_a_user_runs_in_its_place(spark, block_table, signals):
    seen = []
    note = chain.Stage("note", lambda c: c.get("cutoff_hz") == 80.0, lambda y, rate, c: seen.append(y.copy()) or -y)
    x = signals["c"]
    got = chain.front(x, RATE, {"cutoff_hz": 80.0}, stages=chain.with_stage(note, "dc_hpf"))
    want = chain.front(x, RATE, {"cutoff_hz": 80.0})
    assert np.allclose(got, -want) and np.allclose(seen[0], chain.FRONT[1].run(x, RATE, {"cutoff_hz": 80.0}))
    assert np.array_equal(chain.front(x, RATE, {"cutoff_hz": 40.0}, stages=chain.with_stage(note, "dc_hpf")), chain.front(x, RATE, {"cutoff_hz": 40.0}))
    mute = chain.with_stage(chain.Stage("leveler", lambda c: True, lambda y, rate, c: 0 * y))
    assert len(mute) == len(chain.FRONT) and not chain.front(x, RATE, {}, stages=mute).any()
    samples = blocks.from_blocks(block_table.where("signal_id = 'c'"))
    configured = spark.createDataFrame([("c", 80.0)], "signal_id string, cutoff_hz double")
    turned = chain.Stage("turned", lambda c: True, lambda y, rate, c: -y)
    rows = chain.master(samples, configured, RATE, stages=chain.with_stage(turned, "leveler")).orderBy("n").collect()
    assert np.allclose([r["x"] for r in rows], -chain.render(x, RATE, {"cutoff_hz": 80.0})[0][0])


def test_lists_zip_by_place(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([1], ["a", "b"]), (None, ["a"])], "x array<int>, y array<string>")
    told = lambda how: [[(e["x"], e["y"]) for e in r["zipped"]] for r in folds.zipped(df, ["x", "y"], uneven=how).collect()]
    assert told("shortest") == [[(1, "a"), (2, "b")], [(1, "a")], []]
    assert told("longest") == [[(1, "a"), (2, "b")], [(1, "a"), (None, "b")], [(None, "a")]]
    with pytest.raises(Exception, match="other lengths"):
        told("error")


def test_failing_hook_is_told(spark, block_table, signals):
    def broken(x, rate, strength):
        raise RuntimeError("no model")

    samples = blocks.from_blocks(block_table.where("signal_id = 'c'"))
    configured = spark.createDataFrame([("c", 0.5, -16.0)], "signal_id string, denoise_strength double, target_lufs double")
    told = chain.master_report(samples, configured, RATE, denoise=broken).first()
    assert told["failed"] == ["denoise: RuntimeError: no model"]
    with pytest.raises(Exception, match="no model"):
        longmaster.front_blocks(block_table.where("signal_id = 'c'"), configured, RATE, denoise=broken)


def test_renders_do_not_depend_on_partitions(spark, block_table):
    """The whole chain twice, dealt to other tasks: the same bytes, and the same hash of the configuration."""
    names = list(CONFIG)
    configured = spark.createDataFrame([("c", *CONFIG.values())], ["signal_id", *names])
    part = block_table.where("signal_id = 'c'")
    digests, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out, _ = longmaster.master_blocks(part.repartition(int(n)), configured, RATE)
            digests.append([bytes(r["x"]) for r in out.orderBy("block").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert digests[0] == digests[1] and len(digests[0]) == 1
    key = lambda df, order: df.select(decide.config_hash(order)).first()[0]
    assert key(configured, names) == key(configured, names[::-1]) != key(configured.withColumn("target_lufs", F.lit(-14.0)), names)


@pytest.fixture
def folder(spark, tmp_path):
    pcmfiles.register(spark)
    rng = np.random.default_rng(8)
    for name, width, channels, rate, n in (("a", 2, 2, 48_000, 100_001), ("b", 3, 1, 44_100, 40_000), ("c", 1, 3, 8000, 30_720), ("d", 2, 1, 8000, 0)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as w:
            w.setparams((channels, width, rate, n, "NONE", ""))
            w.writeframes(rng.integers(0, 256, n * channels * width, np.uint8).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF no wave at all")
    (tmp_path / "more").mkdir()
    body = rng.integers(0, 256, 4000, np.uint8).tobytes()
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    (tmp_path / "more" / "stream.wav").write_bytes(b"RIFF\xff\xff\xff\xffWAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data\xff\xff\xff\xff" + body)
    return tmp_path


def test_block_source_reads_ranges(spark, folder):
    whole = {}
    for name in ("a", "b", "c"):
        with wave.open(f"{folder}/{name}.wav") as w:
            whole[f"{folder}/{name}.wav"] = readers.pcm(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())
    whole[f"{folder}/more/stream.wav"] = readers.pcm((folder / "more" / "stream.wav").read_bytes()[-4000:], 2, 1)
    for size in (10_000, 200_000, 1 << 24):
        df = spark.read.format("pcm_blocks").option("range_bytes", size).load(str(folder))
        got = arrays(df.withColumnRenamed("path", "signal_id"))
        assert set(got) == set(whole) and all(np.array_equal(got[k], whole[k]) for k in whole)
    heads = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("pcm_headers").load(f"file://{folder}").collect()}
    assert heads["a.wav"]["frames"] == 100_001 and heads["b.wav"]["format"] == "pcm_s24" and heads["c.wav"]["channels"] == 3
    assert heads["bad.wav"]["rate"] is None and heads["d.wav"]["duration"] == 0 and heads["stream.wav"]["frames"] == 2000
    assert spark.read.format("pcm_blocks").load(f"{folder}/a.wav").count() == 4


def test_headers_of_large_files():
    for frames in (1000, 2**31, 2**33):
        head = pcmfiles.header_bytes(frames, 2, 48_000, 2)
        found = pcmfiles.header_of(io.BytesIO(head), len(head) + frames * 4)
        assert found == pcmfiles.Header(len(head), frames * 4, 2, 48_000, 2) and found.frames == frames


def test_files_appear_whole_or_not_at_all(spark, block_table, signals, tmp_path):
    out = f"{tmp_path}/out"
    pcmfiles.write_files(block_table, out, 48_000)
    got = arrays(spark.read.format("pcm_blocks").load(out).withColumn("signal_id", F.regexp_extract("path", r"(\w+)\.wav", 1)))
    assert set(got) == set(signals) and all(np.abs(got[k] - np.clip(signals[k], -1, 1)).max() < 1e-4 for k in signals)
    assert all(not p.name.startswith("_") for p in (tmp_path / "out").iterdir())
    # A signal without its second block fails the job, which leaves nothing new.
    holed = block_table.where("NOT (signal_id = 'a' AND block = 1)").withColumn("signal_id", F.concat(F.lit("new/"), "signal_id"))
    with pytest.raises(Exception, match="block 1 is missing"):
        pcmfiles.write_files(holed, out, 48_000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav", "c.wav"]


def test_streamed_parts_become_files_once(spark, block_table, signals, tmp_path):
    source, out, state = (f"{tmp_path}/{k}" for k in ("in", "out", "state"))
    rows = block_table.where("signal_id IN ('b', 'c')").withColumn("last", (F.col("signal_id") == "c") | (F.col("block") == 19)).repartition(1)
    schema = rows.schema
    for low, high in ((0, 7), (7, 99)):
        rows.where(f"block >= {low} AND block < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        pcmfiles.write_parts(stream, out, state).awaitTermination()
        names = pcmfiles.finish_files(spark, out, 48_000)
        assert names == (["c"] if low == 0 else ["b"])
    assert pcmfiles.finish_files(spark, out, 48_000) == []
    got = arrays(spark.read.format("pcm_blocks").load(out).withColumn("signal_id", F.regexp_extract("path", r"(\w+)\.wav", 1)))
    assert all(got[k].shape == signals[k].shape and np.abs(got[k] - np.clip(signals[k], -1, 1)).max() < 1e-4 for k in ("b", "c"))
    # A batch that is told again adds nothing.
    writer = pcmfiles.PartWriter({"path": out})
    message = writer.write(iter([{"name": "z", "block": 0, "last": True, "channels": 1, "x": blocks.packed(np.zeros(4))}]))
    writer.commit([message], 0)
    assert pcmfiles.finish_files(spark, out, 48_000) == []
