"""Streaming queries, run over all there is and compared with batch SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import headroom_bucket, noise_bucket
from ..operators.recursive import pole
from ..sources.storage import shared_path
from ..sources.tables import samples, table
from ..streaming import streams
from . import sql

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, tag: str) -> str:
    return shared_path(spark, "streams", tag)


@contextmanager
def _state_store(spark: SparkSession):
    """Queries with their own state need this store; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _stream(spark: SparkSession, source: DataFrame, tag: str) -> DataFrame:
    """source as a file stream: written to a folder of its own, read as a stream."""
    path = _folder(spark, tag)
    source.write.parquet(path)
    return spark.readStream.schema(source.schema).parquet(path)


def _complete(stream: DataFrame, tag: str) -> DataFrame:
    path = _folder(stream.sparkSession, tag)
    return streams.run_complete(stream, path, f"{path}-state")


def _events(spark, d):
    return streams.timed(_stream(spark, table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), "events"))


def stream_tumbling(spark, d):
    out = _complete(streams.tumbling(_events(spark, d), "1 day", ["event_type"], "value"), "tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, d):
    out = _complete(streams.sliding(_events(spark, d), "2 days", "1 day", ["event_type"], "value"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


def stream_session(spark, d):
    out = _complete(streams.sessions(_events(spark, d), "6 hours", ["user_id"]), "session")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def stream_dedup(spark, d):
    twice = table(spark, d, "events").select("event_id", "ts", "user_id")
    source = streams.timed(_stream(spark, twice.unionByName(twice.where("event_id % 3 = 0")), "dup"), late="400 days")
    path = _folder(spark, "dedup")
    return streams.run_to_table(streams.deduplicated(source, ["event_id"]), path, f"{path}-state").select("event_id", "user_id")


def stream_stability(spark, d):
    """Sizes of files by user: observed once an event, ready after 3 like sightings in a row."""
    n = samples(spark, d)
    observed = n.select(F.concat(F.lit("/f"), F.col("signal_id")).alias("path"), F.least(F.floor(F.col("n") / 7), F.lit(5)).alias("size_bytes"), F.col("n").alias("mtime_ms"), (F.col("n") * 1000).alias("observed_ms"))
    path = _folder(spark, "stable")
    with _state_store(spark):
        return streams.run_to_table(streams.stable_files(_stream(spark, observed, "observed"), 5000), path, f"{path}-state")


SAVE_MS = 12 * 3_600_000


def stream_autosave(spark, d):
    """Saves of each user's edits (events), 12 hours behind the first of a burst, as far as the watermark got."""
    source = _stream(spark, table(spark, d, "events").select(F.col("user_id").alias("document"), "ts", F.col("event_id").alias("revision")), "edits")
    path = _folder(spark, "autosave")
    with _state_store(spark):
        return streams.run_to_table(streams.autosaved(streams.timed(source, late="1 hour"), SAVE_MS), path, f"{path}-state")


METER_RATE = 100.0


def guard_meter(spark, d):
    """Levels of each signal's input at its end, metered as a stream, and what they call for."""
    rows = samples(spark, d).select("signal_id", "n", (F.col("x") / 500).alias("x"))
    path = _folder(spark, "meter")
    with _state_store(spark):
        told = streams.run_to_table(streams.metered(_stream(spark, rows, "metered"), METER_RATE), path, f"{path}-state")
    last = told.groupBy("signal_id").agg(F.max_by(F.struct("power", "floor"), "n").alias("v"))
    db = lambda c: F.round(10 * F.log10(F.greatest(F.col(f"v.{c}"), F.lit(1e-14))), 5)
    return last.select("signal_id", db("power").alias("level_db"), db("floor").alias("floor_db")).select("*", headroom_bucket(F.col("level_db")).alias("headroom"), noise_bucket(F.col("floor_db")).alias("noise"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_stability, stream_autosave, guard_meter)}
_UP, _DOWN, _DRIFT = (f"{pole(v, METER_RATE)!r}::DOUBLE" for v in (0.010, 0.300, 4.0))
ORACLES = {
    "guard_meter": f"""WITH RECURSIVE {sql.SAMPLES}, p AS (SELECT signal_id, n, (x / 500) * (x / 500) AS p FROM samples), f AS (SELECT signal_id, n, p + (0 - p) * CASE WHEN p > 0 THEN {_UP} ELSE {_DOWN} END AS w, p + (0 - p) * CASE WHEN p > 0 THEN {_UP} ELSE {_DOWN} END AS l FROM p WHERE n = 0
        UNION ALL SELECT signal_id, n, w, CASE WHEN w < l THEN w ELSE w + (l - w) * {_DRIFT} END FROM (SELECT p.signal_id, p.n, p.p + (f.w - p.p) * CASE WHEN p.p > f.w THEN {_UP} ELSE {_DOWN} END AS w, f.l FROM f JOIN p ON p.signal_id = f.signal_id AND p.n = f.n + 1)),
        e AS (SELECT signal_id, round(10 * log10(greatest(arg_max(w, n), 1e-14)), 5) AS level_db, round(10 * log10(greatest(arg_max(l, n), 1e-14)), 5) AS floor_db FROM f GROUP BY 1)
        SELECT *, CASE WHEN level_db > -9 THEN 'hot' WHEN level_db > -24 THEN 'good' WHEN level_db > -50 THEN 'quiet' ELSE 'silent' END AS headroom, CASE WHEN floor_db < -55 THEN 'quiet' WHEN floor_db < -40 THEN 'some_hiss' ELSE 'noisy' END AS noise FROM e""",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(CAST(ts AS DATE) - k, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "stream_session": """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM s)
        SELECT user_id, epoch_us(min(ts)) AS "start", epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "stream_autosave": f"""WITH RECURSIVE e AS (SELECT user_id AS document, epoch_us(ts) // 1000 AS tm, event_id AS revision FROM events), w AS (SELECT max(tm) - 3600000 AS mark FROM e),
        b(document, start) AS (SELECT document, min(tm) FROM e GROUP BY 1 UNION ALL SELECT document, (SELECT min(tm) FROM e WHERE e.document = b.document AND tm >= b.start + {SAVE_MS}) FROM b WHERE start IS NOT NULL)
        SELECT b.document, start + {SAVE_MS} AS saved_ms, count(*) AS edits, arg_max(revision, tm * 1000000 + revision) AS revision FROM b JOIN w ON start + {SAVE_MS} <= mark JOIN e ON e.document = b.document AND tm >= start AND tm < start + {SAVE_MS} GROUP BY 1, 2""",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_stability": """WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events), s AS (SELECT user_id, n, least(n // 7, 5) AS size FROM n), f AS (SELECT user_id, size, min(n) AS first FROM s GROUP BY 1, 2)
        SELECT '/f' || f.user_id AS path, CAST(f.size AS BIGINT) AS size_bytes, CAST(s.n AS BIGINT) AS mtime_ms, CAST(s.n * 1000 AS BIGINT) AS ready_ms FROM f JOIN s ON s.user_id = f.user_id AND s.n = first + 5 AND s.size = f.size""",
}
