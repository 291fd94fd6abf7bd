"""Event streams (inventory section 19): windows, sessions, incremental snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.sources.sinks import path_exists, upsert


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and tumbling or sliding window; events later than ``late`` are left out."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy("event_type", span.alias("w"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        "event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users that ``gap`` of silence closes."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without those that come again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def extend_snapshot(
    stream: DataFrame, path: str, key: list[str], checkpoint: str, reduce: Callable[[DataFrame, int], DataFrame] | None = None
) -> StreamingQuery:
    """Keeps a snapshot up to date, one version a batch: rows of a batch take the place of those with their key.

    ``reduce`` makes one row per key of a batch; without it any one of equal
    keys stays. Empty batches give no version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{path}/v={number:09d}/_SUCCESS") or batch.isEmpty():
            return  # the batch was merged before a restart, or brings nothing
        fresh = reduce(batch, number) if reduce else batch.dropDuplicates(key)
        before = [v for v in _versions(spark, path) if v < number]
        merged = upsert(spark.read.parquet(f"{path}/v={before[-1]:09d}"), fresh, key) if before else fresh
        merged.write.mode("overwrite").parquet(f"{path}/v={number:09d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a snapshot, in order; one folder a batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]:09d}")
