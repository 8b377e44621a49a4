"""Batch jobs: states, progress, retries, targets."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import extension, output_name

TERMINAL = ("done", "failed", "cancelled")
#: State after an event; other events leave the state as it is.
MOVES = {("queued", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("failed", "retry"): "queued", ("cancelled", "retry"): "queued"}

# Extensions of files that a folder scan takes.
EXTENSIONS = ["wav", "wave", "mp3", "m4a", "m4b", "flac", "ogg", "oga", "aac", "wma", "aiff", "aif", "mp4", "mov", "mkv"]
#: Name of the file in which a watcher keeps what it has processed; it is never an input.
LOG_FILE = ".signalframe-watch-log.json"


def progress(jobs: DataFrame, key: str) -> DataFrame:
    """key, progress: mean of job progress, terminal states counting 1."""
    p = F.when(F.col("state").isin(*TERMINAL), 1.0).otherwise(F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0)))
    return jobs.groupBy(key).agg(F.avg(p).alias("progress"))


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag, so that cancel() ends them and no others."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)


def overall(jobs: DataFrame) -> DataFrame:
    """progress over all jobs, 1 without any."""
    p = F.when(F.col("state").isin(*TERMINAL), 1.0).otherwise(F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0)))
    return jobs.agg(F.coalesce(F.avg(p), F.lit(1.0)).alias("progress"))


def queue_order(requests: DataFrame, batch: str) -> DataFrame:
    """batch, job, place of queued jobs after requests (batch, at, job, action, place) in order.

    submit appends, remove takes out, move puts a job at a place; requests for jobs that aren't queued
    do nothing.
    """
    from ..operators.grouped import grouped_map

    def run(group):
        line: list = []
        for job, action, place in zip(group["job"].to_pylist(), group["action"].to_pylist(), group["place"].to_pylist(), strict=True):
            if action == "submit" and job not in line:
                line.append(job)
            elif action in ("remove", "move") and job in line:
                line.remove(job)
                if action == "move":
                    line.insert(max(0, place or 0), job)
        return {"job": line, "place": list(range(len(line)))}

    return grouped_map(requests, [batch], ["at"], ["job", "action", "place"], run, f"job {dict(requests.dtypes)['job']}, place int")


def replay(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, state, attempts after a job's events in order, from queued."""
    table = F.create_map(*[F.lit(x) for (s, e), to in MOVES.items() for x in (f"{s}/{e}", to)])
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "event"))).alias("rows"))

    def step(acc, x):
        to = F.coalesce(table[F.concat(acc["state"], F.lit("/"), x["event"])], acc["state"])
        return F.struct(to.alias("state"), (acc["attempts"] + ((to == "running") & (acc["state"] != "running")).cast("int")).alias("attempts"))

    return rows.select(key, F.aggregate("rows", F.struct(F.lit("queued").alias("state"), F.lit(0).alias("attempts")), step).alias("s")).select(key, "s.*")


# A work queue is three tables below a folder: items, control (at, item, action) and results by round.
CONTROL = "at long, item string, action string"
OUTCOME = "item string, state string, attempts int, error string, output string, at_ms long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty if nothing is there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def control(spark: SparkSession, folder: str, at: int, action: str, item: str | None = None) -> None:
    """Asks for pause, resume, cancel or retry of an item, or of all of them, from now on (at: a rising number)."""
    spark.createDataFrame([(at, item, action)], CONTROL).coalesce(1).write.mode("append").parquet(f"{folder}/control")


def item_states(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """items (item, ...) with state, attempts, error and output: queued, paused, cancelled, done or failed.

    An item's latest result counts unless a later retry asks for another; pause and resume of all
    items and of one count by which came last.
    """
    asked = _table(spark, f"{folder}/control", CONTROL)
    last = lambda rows, name: rows.groupBy("item").agg(F.max_by("action", "at").alias(name), F.max("at").alias(f"{name}_at"))
    whole = asked.where("item IS NULL AND action IN ('pause', 'resume')").agg(F.max_by("action", "at").alias("all"), F.max("at").alias("all_at"))
    held = last(asked.where("item IS NOT NULL AND action IN ('pause', 'resume')"), "own")
    ended = last(asked.where("item IS NOT NULL AND action IN ('cancel', 'retry')"), "end")
    results = _table(spark, f"{folder}/results", f"{OUTCOME}, asked_at long, round long")
    newest = Window.partitionBy("item").orderBy(F.col("round").desc())
    told = results.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k", "round", "at_ms").withColumnRenamed("state", "told")
    rows = items.join(held, "item", "left").join(ended, "item", "left").join(told, "item", "left").join(F.broadcast(whole), how="left")
    c = F.col
    again = (c("end") == "retry") & (c("end_at") > F.coalesce("asked_at", F.lit(-1)))
    paused = F.when(c("own_at").isNull() | (c("all_at") > c("own_at")), c("all")).otherwise(c("own")) == "pause"
    state = F.when(c("told").isNotNull() & ~F.coalesce(again, F.lit(False)), c("told")).when(c("end") == "cancel", "cancelled").when(F.coalesce(paused, F.lit(False)), "paused").otherwise("queued")
    return rows.select(*items.columns, state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error", "output", F.coalesce("end_at", F.lit(0).cast("long")).alias("asked_at"))


def work_round(spark: SparkSession, folder: str, items: DataFrame, work: Callable[[dict], str], number: int, attempts: int = 3, most: int | None = None) -> None:
    """One round over the queued items: each is a row of the round's results, whatever becomes of it.

    work(item as a dict) gives an item's output; what it raises counts as an attempt, and after the
    last one is the row's error, so one bad item fails nothing else. most: items of a round, in their
    order. A round that is told again after a failure replaces its own results.
    """
    queued = item_states(spark, folder, items).where("state = 'queued'").drop("state", "attempts", "error", "output")
    queued = queued.orderBy("item").limit(most) if most else queued

    def run(batches):
        import time

        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                asked, tried, error, output = row.pop("asked_at"), 0, None, None
                while tried < attempts:
                    tried += 1
                    try:
                        output, error = work(row), None
                        break
                    except Exception as e:  # noqa: BLE001  an item's failure is its result
                        error = f"{type(e).__name__}: {e}"
                rows.append((row["item"], "done" if error is None else "failed", tried, error, output, int(time.time() * 1000), asked))
            yield pd.DataFrame(rows, columns=["item", "state", "attempts", "error", "output", "at_ms", "asked_at"])

    queued.repartition("item").mapInPandas(run, f"{OUTCOME}, asked_at long").write.mode("overwrite").parquet(f"{folder}/results/round={number}")


def serve(items: DataFrame, folder: str, work: Callable[[dict], str], checkpoint: str, attempts: int = 3, most: int | None = None, **trigger):
    """The running query that works on a stream of items (item, ...): each batch adds its items and is a round."""
    schema = items.schema

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
        known = spark.read.schema(schema).parquet(f"{folder}/items").dropDuplicates(["item"])
        work_round(spark, folder, known, work, number, attempts, most)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class RoundListener(StreamingQueryListener):
    """Tells each batch of a stream to a function: number, rows and milliseconds."""

    def __init__(self, tell: Callable[[int, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_log_file(path: Column, name: str = LOG_FILE) -> Column:
    return base_name(path) == name


def matches(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a path's extension, in any case, is one of those given, or a supported one."""
    return extension(path).isin([e.lower() for e in extensions] if extensions is not None else EXTENSIONS)


def targets(files: DataFrame, path: str = "path", extensions: list[str] | None = None) -> DataFrame:
    """Supported files in path order; a watcher's log isn't one."""
    return files.where(matches(F.col(path), extensions) & ~is_log_file(F.col(path))).orderBy(path)


def outputs(files: DataFrame, root: str, output_dir: str, naming: str = "{name}_mastered", mirror: bool = False, path: str = "path") -> DataFrame:
    """files with output: {name} replaced by the stem, under output_dir, with mirror in the same sub-folder as under root."""
    name = output_name(F.col(path), F.lit(naming), "wav")
    if not mirror:
        return files.withColumn("output", F.concat(F.lit(f"{output_dir.rstrip('/')}/"), name))
    top = root.rstrip("/") + "/"
    inside = F.regexp_extract(F.expr(f"substr(`{path}`, {len(top) + 1})"), r"^(.*/)?[^/]*$", 1)
    folder = F.when(F.col(path).startswith(top), inside).otherwise(F.lit(""))
    return files.withColumn("output", F.concat(F.lit(f"{output_dir.rstrip('/')}/"), folder, name))


def candidates(files: DataFrame, log: DataFrame, known_outputs: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """files (path, size, mtime_ms) that a watcher takes: supported, not its log, not its own output, not processed yet.

    log: path, size, mtime_ms of processed files; known_outputs: path of what the watcher wrote.
    """
    fresh = files.where(matches(F.col("path"), extensions) & ~is_log_file(F.col("path")))
    return unseen(fresh.join(known_outputs.select("path"), "path", "left_anti"), log)


def unseen(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose path, size and mtime_ms aren't all in the log."""
    return files.join(log.select("path", "size", "mtime_ms"), ["path", "size", "mtime_ms"], "left_anti")
