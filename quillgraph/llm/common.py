"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.scratch import released, remove_at_exit, shared_root, shuffles_removed, spread, staged

__all__ = ["WORD", "hash_buckets", "released", "remove_at_exit", "running_total", "shared_root", "shuffles_removed", "spread", "staged"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def hash_buckets(rows: int, per_bucket: int = 20_000) -> int:
    """How many hash buckets keep about ``per_bucket`` rows in each."""
    return max(1, -(-rows // per_bucket))


def running_total(
    df: DataFrame, groups: list[str], order: list[Column], bucket: Column, value: str, out: str
) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``groups`` without one task per group.

    Rows are ordered by (bucket, order). Each bucket is summed on its own, the
    few bucket totals are summed over the buckets, and both parts are added, so
    a group that holds a third of all rows is still dealt over many tasks.
    """
    cut = df.withColumn("__bucket", bucket)
    totals = cut.groupBy(*groups, "__bucket").agg(F.sum(value).alias("__total"))
    ahead = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__base"),
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return (
        local.join(bases, match, "left")
        .withColumn(out, F.col("__local") + F.col("__base"))
        .drop("__bucket", "__local", "__b", "__base", *[f"__g{i}" for i in range(len(groups))])
    )
