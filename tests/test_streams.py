"""Streams against what their batches give: carried state, durable logs, late rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import recursive
from signalframe.plans import gates, jobs
from signalframe.queries.streams import ROCKS
from signalframe.streaming import streams

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, ROCKS)
    yield spark
    spark.conf.unset(STORE)


def test_carried_limiter_is_the_whole_one(rocks, tmp_path):
    rate = 8000.0
    x = 1.3 * np.sin(2 * np.pi * 97 * np.arange(3000) / rate) * np.repeat([0.3, 1.0, 0.5], 1000)
    for k, (lo, hi) in enumerate(((0, 700), (700, 701), (701, 2200), (2200, 3000))):
        part = [(1, n, float(x[n]), n == 2999) for n in range(lo, hi)]
        rocks.createDataFrame(part, "signal_id long, n long, x double, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = rocks.readStream.schema("signal_id long, n long, x double, last boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = streams.run_to_table(streams.limited(stream, rate, -3.0), f"file://{tmp_path}/out", f"file://{tmp_path}/state").orderBy("n").collect()
    want = recursive.Limiter(rate, -3.0).push(x, last=True)
    assert [r["n"] for r in got] == list(range(3000)) and np.allclose([r["x"] for r in got], want, atol=1e-12)


def test_log_tells_each_file_once(spark, tmp_path):
    schema = "path string, size_bytes long, mtime_ms long, ready_ms long"
    told = lambda: sorted(r["path"] for r in spark.read.parquet(f"{tmp_path}/jobs").collect())
    for k, rows in enumerate(([("a", 1, 1, 1), ("b", 1, 1, 1), ("a", 1, 1, 1)], [("a", 1, 1, 9), ("b", 2, 1, 9), ("c", 1, 1, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.log_processed(stream, f"{tmp_path}/jobs", f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
        assert told() == (["a", "b"], ["a", "b", "b", "c"])[k]


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "id long, ts timestamp, k string, v double"
    rows = lambda *items: spark.createDataFrame(items, "id long, ts string, k string, v double").select("id", F.col("ts").cast("timestamp").alias("ts"), "k", "v")
    source, sink = f"{tmp_path}/in", f"file://{tmp_path}/out"
    batches = (rows((1, "2024-01-01 00:00:01", "a", 1.0), (2, "2024-01-01 03:00:00", "a", 1.0)), rows((3, "2024-01-01 00:00:02", "a", 9.0), (4, "2024-01-01 06:00:00", "a", 1.0)), rows((5, "2024-01-01 09:00:00", "a", 1.0)))
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = streams.timed(spark.readStream.schema(schema).parquet(source))
        got = streams.run_to_table(streams.tumbling(stream, "1 hour", ["k"], "v"), sink, f"file://{tmp_path}/state")
    assert {(str(r["start"]), r["total"]) for r in got.collect()} >= {("2024-01-01 00:00:00", 1.0), ("2024-01-01 03:00:00", 1.0)}
    assert all(r["total"] < 9 for r in got.collect())


def test_saves_do_not_depend_on_order_or_batches(rocks, tmp_path):
    """Bursts by definition, over edits that come out of order in several batches."""
    rng = np.random.default_rng(2)
    edits = [(int(d), int(t), k) for k, (d, t) in enumerate(zip(rng.integers(0, 3, 90), np.sort(rng.integers(0, 900_000, 90)), strict=True))]
    cut = [edits[k : k + 30] for k in (0, 30, 60)]
    for k, part in enumerate(cut):
        rng.shuffle(part)
        rows = rocks.createDataFrame([(int(d), int(t), int(r)) for d, t, r in part], "document long, t long, revision long")
        rows.select("document", F.timestamp_millis("t").alias("ts"), "revision").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = rocks.readStream.schema("document long, ts timestamp, revision long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = streams.run_to_table(streams.autosaved(stream.withWatermark("ts", "100 seconds"), 30_000), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    mark, want = max(t for _, t, _ in edits) - 100_000, []
    for d in range(3):
        own = sorted((t, r) for x, t, r in edits if x == d)
        while own and own[0][0] + 30_000 <= mark:
            burst = [e for e in own if e[0] < own[0][0] + 30_000]
            want.append((d, own[0][0] + 30_000, len(burst), burst[-1][1]))
            own = own[len(burst) :]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


@pytest.mark.parametrize("groups", [1, 2])
def test_documents_of_a_group_are_saved_apart(rocks, tmp_path, groups):
    """Documents, null among them, that share state and timer; batches bring earlier edits of some and later ones of others."""
    cut = [[("a", 50, 1), ("b", 200, 2)], [("b", 40, 3), (None, 60, 4), ("a", 65, 5)], [("c", 900, 6), ("a", 300, 7)]]
    for k, part in enumerate(cut):
        rows = rocks.createDataFrame(part, "document string, t long, revision long")
        rows.select("document", F.timestamp_millis(F.col("t") * 1000).alias("ts"), "revision").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = rocks.readStream.schema("document string, ts timestamp, revision long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = streams.run_to_table(streams.autosaved(stream.withWatermark("ts", "500 seconds"), 30_000, groups), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    want = {("a", 80_000, 2, 5), ("a", 330_000, 1, 7), ("b", 70_000, 1, 3), ("b", 230_000, 1, 2), (None, 90_000, 1, 4)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_files_get_ready_without_another_sighting(rocks, tmp_path):
    schema = "path string, size_bytes long, mtime_ms long"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put = lambda *rows: rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put(("a", 1, 1), ("b", 5, 1))
    stream = rocks.readStream.schema(schema).parquet(source)
    query = streams.quiet_files(stream, 1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    told = lambda: sorted((r["path"], r["size_bytes"]) for r in rocks.read.schema(streams.READY).parquet(out).collect())

    def until(rows):
        end = time.monotonic() + 60
        while time.monotonic() < end:
            if query.exception():
                raise query.exception()
            try:
                if told() == rows:
                    return
            except Exception as e:  # noqa: BLE001  nothing is written yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            time.sleep(0.3)
        raise AssertionError(told())

    try:
        until([("a", 1), ("b", 5)])
        # A sighting of the same size tells nothing; a changed size does, once.
        put(("a", 1, 2), ("b", 6, 2))
        until([("a", 1), ("b", 5), ("b", 6)])
        time.sleep(3)
        until([("a", 1), ("b", 5), ("b", 6)])
    finally:
        query.stop()


def test_best_mapping_of_any_number_of_speakers(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (3, 3), (2, 4), (4, 2), (4, 4)):
        for _ in range(40):
            gain = rng.integers(0, 9, (rows, columns)).astype(float)
            wide = gain if rows <= columns else gain.T
            best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
            assert gates.assigned(gain) == best
    # Thirty speakers under other names: all time is right; one is taken for two.
    turns = [("k", f"r{s}", 10.0 * k, 10.0 * k + 8) for k in range(90) for s in [k % 30]]
    found = [("k", f"h{(7 * int(r[1:])) % 30}" if a >= 10 else "other", a, b) for _, r, a, b in turns]
    names = "key string, speaker string, t_start double, t_end double"
    got = gates.diarization_error(spark.createDataFrame(turns, names), spark.createDataFrame(found, names), "key", 0.5, 0.25).first()["der"]
    assert abs(got - 1 / 90) < 1e-9


def test_one_bad_item_fails_nothing_else(spark, tmp_path):
    folder = f"file://{tmp_path}/queue"

    def work(item):
        if item["item"] == "bad":
            raise ValueError("corrupt file")
        if item["item"] == "shaky":
            mark = tmp_path / "shaky"
            if not mark.exists():
                mark.write_text("tried")
                raise OSError("once")
        return f"{item['path']}.out"

    names = ["a", "b", "bad", "shaky", "z"]
    items = spark.createDataFrame([(n, f"/in/{n}") for n in names], "item string, path string")
    state = lambda: {r["item"]: (r["state"], r["attempts"]) for r in jobs.item_states(spark, folder, items).collect()}
    assert set(state().values()) == {("queued", 0)}
    jobs.control(spark, folder, 1, "pause")
    jobs.control(spark, folder, 2, "cancel", "z")
    jobs.work_round(spark, folder, items, work, 0)
    assert {k: v[0] for k, v in state().items()} == {"a": "paused", "b": "paused", "bad": "paused", "shaky": "paused", "z": "cancelled"}
    jobs.control(spark, folder, 3, "resume")
    jobs.control(spark, folder, 4, "pause", "b")
    jobs.work_round(spark, folder, items, work, 1, attempts=2)
    assert state() == {"a": ("done", 1), "b": ("paused", 0), "bad": ("failed", 2), "shaky": ("done", 2), "z": ("cancelled", 0)}
    rows = {r["item"]: r for r in jobs.item_states(spark, folder, items).collect()}
    assert rows["bad"]["error"] == "ValueError: corrupt file" and rows["a"]["output"] == "/in/a.out"
    # A retry works on what failed or was cancelled, and once.
    for at, n in ((5, "bad"), (6, "z")):
        jobs.control(spark, folder, at, "retry", n)
    jobs.control(spark, folder, 7, "resume", "b")
    jobs.work_round(spark, folder, items, lambda item: "mended", 2, most=2)
    assert {k: v[0] for k, v in state().items()} == {"a": "done", "b": "done", "bad": "done", "shaky": "done", "z": "queued"}
    jobs.work_round(spark, folder, items, lambda item: "mended", 3)
    assert {v[0] for v in state().values()} == {"done"}
    # A round that is told again replaces its own results.
    before = spark.read.parquet(f"{folder}/results").count()
    jobs.work_round(spark, folder, items, lambda item: "mended", 4)
    assert spark.read.parquet(f"{folder}/results").count() == before


def test_stream_of_items_with_progress(spark, tmp_path):
    schema, told = "item string, path string", []
    for k in range(3):
        spark.createDataFrame([(f"i{k}{j}", "p") for j in range(4)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = jobs.RoundListener(lambda batch, rows, ms: told.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        jobs.serve(stream, f"file://{tmp_path}/queue", lambda item: "ok", f"{tmp_path}/state").awaitTermination()
        end = time.monotonic() + 20
        while len(told) < 3 and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(told)[:3] == [(0, 4), (1, 4), (2, 4)]
    assert spark.read.parquet(f"{tmp_path}/queue/results").where("state = 'done'").select("item").distinct().count() == 12
