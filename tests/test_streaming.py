"""Streams with late, repeated and missing rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import events as streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def folder(spark, tmp_path):
    """Four files, one a batch: the last holds a late event and one said twice."""
    batches = [
        [(1, at(0), 1, "view", 1.0), (2, at(10), 1, "view", 2.0), (3, at(50), 2, "buy", None)],
        [(4, at(200), 1, "view", 4.0), (5, at(205), None, "view", 5.0)],
        [(8, at(210), 3, "buy", 1.0)],
        [(6, at(1), 1, "view", 100.0), (4, at(200), 1, "view", 4.0), (7, at(600), 1, "view", 7.0)],
    ]
    for n, rows in enumerate(batches):
        path = tmp_path / "in" / f"{n}.parquet"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        path.parent.mkdir(exist_ok=True)
        next((tmp_path / f"part{n}").glob("*.parquet")).rename(path)
    return tmp_path


def drained(stream, folder, name):
    out = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state")
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}").collect()


def source(spark, folder):
    return streams.event_stream(spark, f"{folder}/in", SCHEMA, files_per_trigger=1)


def test_windows_leave_late_events_out(spark, folder):
    got = drained(streams.windowed_counts(source(spark, folder), "1 hour"), folder, "windows")
    assert {(r["event_type"], r["start"], r["n"], r["total"]) for r in got} == {("view", at(0), 2, 3.0), ("buy", at(0), 1, None), ("view", at(180), 3, 13.0), ("buy", at(180), 1, 1.0)}


def test_sessions_close_after_silence(spark, folder):
    got = drained(streams.sessions(source(spark, folder)), folder, "sessions")
    assert {(r["user_id"], r["start"], r["events"]) for r in got} == {(1, at(0), 2), (2, at(50), 1), (1, at(200), 2), (None, at(205), 1), (3, at(210), 1)}


def test_repeats_within_the_watermark_go(spark, folder):
    got = drained(streams.first_seen(source(spark, folder)), folder, "first")
    assert sorted(r["event_id"] for r in got) == [1, 2, 3, 4, 5, 7, 8]


def test_snapshot_survives_a_restart(spark, folder):
    newest = source(spark, folder).select("user_id", "event_id").where("user_id IS NOT NULL")
    reduce = lambda batch, n: batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    for _ in range(2):  # the second run finds nothing new
        streams.extend_snapshot(newest, f"{folder}/snap", ["user_id"], f"{folder}/snap-state", reduce).awaitTermination()
    got = streams.latest_snapshot(spark, f"{folder}/snap").collect()
    assert {(r["user_id"], r["event_id"]) for r in got} == {(1, 7), (2, 3), (3, 8)}
