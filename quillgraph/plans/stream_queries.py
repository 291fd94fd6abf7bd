"""Queries that run as streams to the end of the events and give what the stream has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.registry import query, table
from quillgraph.scratch import fresh_path
from quillgraph.streaming import events as streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with timestamps that watermarks can read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, label: str) -> DataFrame:
    """What a stream appends until its source is used up; its state and its output are in the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    done = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, f"{label}-state"))
    done.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    f"""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 2) AS total FROM events
    GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}"""
)
def stream_windows(spark, sf_dir):
    """19.1: hourly windows of a stream, those that the watermark has closed."""
    found = _drained(streams.windowed_counts(_events(spark, sf_dir), "1 hour"), "stream-windows")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 2).alias("total"))


@query(
    f"""WITH t AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS start FROM events)
    SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM t GROUP BY event_type, t.start HAVING t.start + INTERVAL 30 MINUTE <= {_CLOSED}"""
)
def stream_sliding_windows(spark, sf_dir):
    """19.1: sliding windows of half an hour, every quarter, of a stream."""
    found = _drained(streams.windowed_counts(_events(spark, sf_dir), "30 minutes", slide="15 minutes"), "stream-sliding")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}"""
)
def stream_sessions(spark, sf_dir):
    """19.1: sessions of a stream that half an hour of silence and the watermark have closed."""
    found = _drained(streams.sessions(_events(spark, sf_dir)), "stream-sessions")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), "events")


@query("SELECT event_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    """19.1: a stream with every event said twice, each once."""
    stream = _events(spark, sf_dir)
    twice = stream.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return _drained(streams.first_seen(twice).select("event_id", "event_type"), "stream-first")


@query("SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_snapshot(spark, sf_dir):
    """13.11, 19.1: a snapshot that a stream keeps up to date, one row per user."""
    path = fresh_path(spark, "stream-snapshot")
    newest = _events(spark, sf_dir).select("user_id", "event_id")

    def merge(batch: DataFrame, number: int) -> DataFrame:
        return batch.groupBy("user_id").agg(F.max("event_id").alias("last_event"))

    last = streams.extend_snapshot(newest, path, ["user_id"], fresh_path(spark, "stream-snapshot-state"), merge)
    last.awaitTermination()
    return streams.latest_snapshot(spark, path)
