"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests, a laptop) a
    local temporary folder is used; on a cluster the setting must name shared
    storage, and without it nothing is written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/quillgraph-{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with Hadoop's own client, whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    atexit.register(_guarded, spark, path)


def _guarded(spark: SparkSession, path: str) -> None:
    try:
        # a session that has ended already took its py4j gateway with it
        if not spark._jsc.sc().isStopped():
            remove_path(spark, path)
    except Exception as error:  # the JVM may be gone at interpreter exit
        del error


def staged(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, compressed as the session does or by ``codec``, and read it again.

    The written table cuts the lineage: a lost executor costs the tasks of the
    current job, never the jobs that led here.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete a table that ``staged`` gave back and that no later job reads."""
    for name in df.inputFiles()[:1]:
        remove_path(df.sparkSession, name.rpartition("/")[0])


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query written in here go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table in fewer splits than cores (one small file, one row group) would
    leave cores idle in a stage that works hard on each row. With as many
    splits or more, as any large table has, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
