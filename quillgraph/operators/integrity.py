"""Locks, fingerprints and recomputed results (inventory section 18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(inventory: DataFrame) -> str:
    """One hash of a small inventory, in the order of names."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = F.array_sort(F.collect_list(F.struct(name.alias("name"), F.col("sha256"))))
    return inventory.agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["name"], r["sha256"])), "\n"), 256).alias("h")).first()["h"]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash sum of a table of any size: 48 bits of each row's hash, columns by name, null apart from empty."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    row = F.conv(F.left(F.sha2(F.concat_ws("|", *[text(c) for c in sorted(df.columns)]), 256), F.lit(12)), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"))


def changed_inputs(lock: DataFrame, now: DataFrame) -> DataFrame:
    """Locked inputs that are missing or differ."""
    joined = lock.select("path", F.col("sha256").alias("locked")).join(now.select("path", F.col("sha256").alias("found")), "path", "left")
    return joined.where(~F.col("locked").eqNullSafe(F.col("found")))


def pack_problems(pack: DataFrame) -> DataFrame:
    """What keeps a frozen pack from use: ``problem, n``; no rows if nothing does."""
    counts = pack.agg(
        (F.count(F.lit(1)) - F.count_distinct("annotation_id")).alias("duplicate_ids"),
        F.count_if(F.col("review_status") != "reviewed").alias("not_reviewed"),
        F.count_if(F.size("gold_evidence_chunk_ids") == 0).alias("without_gold"),
        F.count_if(~F.col("eligible_for_formal_evaluation")).alias("not_eligible"),
        (F.count(F.lit(1)) == 0).cast("long").alias("empty"),
    )
    return counts.unpivot([], counts.columns, "problem", "n").where("n > 0")


def quota_problems(rows: DataFrame, slice_col: str, least: dict[str, int]) -> DataFrame:
    """Slices with fewer rows than they need."""
    spark = rows.sparkSession
    need = spark.createDataFrame(list(least.items()), f"{slice_col} string, least int")
    have = rows.groupBy(slice_col).agg(F.count(F.lit(1)).alias("n"))
    return need.join(have, slice_col, "left").select(slice_col, "least", F.coalesce("n", F.lit(0)).alias("n")).where("n < least")


def recomputed_differences(stored: DataFrame, again: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys whose stored and recomputed values differ or that only one side has."""
    left = stored.select(*key, *[F.col(v).alias(f"{v}_stored") for v in values], F.lit(True).alias("__s"))
    right = again.select(*key, *[F.col(v).alias(f"{v}_again") for v in values], F.lit(True).alias("__a"))
    joined = left.join(right, key, "full_outer")
    off = F.col("__s").isNull() | F.col("__a").isNull()
    for v in values:
        off = off | (F.abs(F.col(f"{v}_stored") - F.col(f"{v}_again")) > tolerance)
    return joined.where(off).drop("__s", "__a")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two sets share, which must often be none."""
    return a.select(key).intersect(b.select(key))


def label_problems(labels: DataFrame, domain: list[str]) -> DataFrame:
    """Rows whose label is outside its domain."""
    return labels.where(~F.coalesce(F.col("label").isin(*domain), F.lit(False)))
