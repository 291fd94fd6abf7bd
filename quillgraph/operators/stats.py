"""Paired tests, intervals and agreement (inventory section 16)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  # units whose counts travel together
DRAWN_AT_ONCE = 1 << 20  # numbers that a draw holds in memory


def stable_seed(seed: int, label: str) -> int:
    """A 32-bit seed from a base seed and a label."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{label}".encode()).digest()[:8], "big") % (1 << 32)


def bootstrap_means(values: DataFrame, iterations: int = 1000, seed: int = 20260716) -> DataFrame:
    """Mean and 95 % interval per ``label`` from rows ``label, unit, value``, without collecting.

    Sample b draws as many units as there are, the i-th by a hash of (seed,
    label, b, i); units are numbered by id. Quantiles interpolate linearly. The
    values are sent to the samples, which are dealt out before they are drawn.
    """
    by = Window.partitionBy("label").orderBy("unit")
    numbered = values.select("label", "value", (F.row_number().over(by) - 1).alias("nth"))
    sizes = numbered.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    draws = (
        sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .repartition("label", "b")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("nth", F.pmod(F.xxhash64(F.lit(seed), "label", "b", "i"), F.col("n")))
    )
    samples = draws.join(F.broadcast(numbered), ["label", "nth"]).groupBy("label", "b").agg(F.avg("value").alias("m"))
    bands = samples.groupBy("label").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sizes.join(bands, "label").select(
        "label", "n", F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high")
    )


def bootstrap_exact(values: DataFrame, iterations: int = 10_000, seed: int = 20260716) -> DataFrame:
    """As ``bootstrap_means`` with NumPy's generator, for results that must repeat bit by bit.

    A label's values are one small sample of a study and are drawn in one task,
    some samples at a time; the generator goes on where it stopped.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, label = pdf.sort_values("unit")["value"].to_numpy(float), pdf["label"].iloc[0]
        rng = np.random.default_rng(stable_seed(seed, str(label)))
        step = max(1, DRAWN_AT_ONCE // len(x))
        parts = [x[rng.integers(0, len(x), size=(min(step, iterations - at), len(x)))].mean(axis=1) for at in range(0, iterations, step)]
        means = np.concatenate(parts)
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"label": [label], "n": [len(x)], "mean": [round(x.mean(), 6)], "low": [round(low, 6)], "high": [round(high, 6)]})

    kind = values.schema["label"].dataType.simpleString()
    return values.select("label", "unit", "value").groupBy("label").applyInPandas(
        run, f"label {kind}, n long, mean double, low double, high double"
    )


def _hash_long(numbers: np.ndarray, seed: int) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of longs after columns whose hash is ``seed``."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    first = np.uint64((seed + int(five) + 8) % (1 << 64))
    x = turn(first ^ turn(numbers.astype(np.uint64) * two, 31) * one, 27) * one + four
    x = (x ^ x >> np.uint64(33)) * two
    x = (x ^ x >> np.uint64(29)) * three
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _draw_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, n, b, h) to (label, b, block, counts): how often sample b draws each unit, a block of units a row."""
    for batch in batches:
        for row, (n, b, h) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
            counts = np.zeros(n, np.int64)
            for at in range(0, n, DRAWN_AT_ONCE):
                counts += np.bincount(_hash_long(np.arange(at, min(n, at + DRAWN_AT_ONCE)), h) % n, minlength=n)
            counts = counts.astype("<u1" if counts.max() < 256 else "<u8")
            blocks = [counts[at : at + BLOCK].tobytes() for at in range(0, n, BLOCK)]
            columns = [pa.repeat(batch.column(0)[row], len(blocks)), pa.array([b] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "b", "block", "counts"])


def _block_sums(drawn: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    """Of a block of units, what each sample draws: label, b, total (null where all are), rows."""
    units = units.sort_values("nth")
    total, known, rows, sums = units["total"].to_numpy(float), units["known"].to_numpy(bool), units["rows"].to_numpy(), []
    for raw in drawn["counts"]:
        counts = np.frombuffer(raw, f"<u{len(raw) // len(rows)}").astype(np.int64)
        at = np.flatnonzero(counts)
        some = at[known[at]]
        sums.append((float(counts[some] @ total[some]) if len(some) else None, int(counts[at] @ rows[at])))
    found = pd.DataFrame(sums, columns=["total", "rows"], dtype=object)
    return pd.concat([drawn[["label", "b"]].reset_index(drop=True), found], axis=1)


def cluster_bootstrap(values: DataFrame, iterations: int = 1000, seed: int = 20260716) -> DataFrame:
    """Resamples whole clusters: rows ``label, unit, value`` with several values a unit, weighted by their counts.

    Draws are as those of ``bootstrap_means``. They don't travel: each sample is
    counted where it is drawn, and the counts, a byte a unit, meet the units by
    blocks. A task holds the counts of one sample of a label.
    """
    units = values.groupBy("label", "unit").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy("label").orderBy("unit")
    numbered = units.withColumn("nth", (F.row_number().over(by) - 1).cast("long"))
    sizes = numbered.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.sum("total") / F.sum("rows")).alias("mean"))
    kind = values.schema["label"].dataType.simpleString()
    draws = (
        sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .select("label", "n", "b", F.xxhash64(F.lit(seed), "label", "b").alias("h"))
        .repartition(4 * values.sparkSession.sparkContext.defaultParallelism, "label", "b")
        .mapInArrow(_draw_counts, f"label {kind}, b int, block long, counts binary")
    )
    blocks = numbered.select(
        "label", F.expr(f"nth div {BLOCK}").alias("block"), "nth", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), F.col("total").isNotNull().alias("known"), "rows"
    )
    sums = draws.groupBy("label", "block").cogroup(blocks.groupBy("label", "block")).applyInPandas(_block_sums, f"label {kind}, b int, total double, rows long")
    samples = sums.groupBy("label", "b").agg((F.sum("total") / F.sum("rows")).alias("m"))
    bands = samples.groupBy("label").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sizes.join(bands, "label").select("label", "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def stratified_bootstrap(values: DataFrame, iterations: int = 1000, seed: int = 20260716) -> DataFrame:
    """Resamples inside strata: rows ``label, stratum, unit, value``; each stratum keeps its size in every draw."""
    numbered = values.withColumn("nth", F.row_number().over(Window.partitionBy("label", "stratum").orderBy("unit")) - 1)
    sizes = numbered.groupBy("label", "stratum").agg(F.count(F.lit(1)).alias("n"))
    draws = (
        sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("nth", F.pmod(F.xxhash64(F.lit(seed), "label", "stratum", "b", "i"), F.col("n")))
    )
    samples = draws.join(numbered.select("label", "stratum", "nth", "value"), ["label", "stratum", "nth"]).groupBy("label", "b").agg(F.avg("value").alias("m"))
    bands = samples.groupBy("label").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    means = values.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return means.join(bands, "label").select("label", "n", F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series above 20, by summing below."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    large = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, small).otherwise(large)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact two-sided test per ``label`` from rows ``label, treatment, baseline`` of 0 and 1; p is 1 without discordance."""
    counts = pairs.groupBy("label").agg(
        F.count_if(F.col("treatment") > F.col("baseline")).alias("improvements"),
        F.count_if(F.col("treatment") < F.col("baseline")).alias("regressions"),
    )
    n = F.col("improvements") + F.col("regressions")
    less = F.least("improvements", "regressions").cast("int")
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2))
    tail = F.aggregate(F.sequence(F.lit(0), less), F.lit(0.0), lambda a, i: a + term(i))
    return counts.withColumn("discordant", n).withColumn("p_value", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test per ``label`` from rows ``label, treatment, baseline``, zeros left out.

    Exact for up to 50 untied differences, else the normal approximation with
    tie correction. Ranks come from windows; only the exact tail is Python.
    """
    diffs = pairs.select("label", (F.col("treatment") - F.col("baseline")).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    order = Window.partitionBy("label").orderBy("size")
    ties = Window.partitionBy("label", "size")
    ranked = diffs.withColumn("row", F.row_number().over(order)).withColumn("rank", F.avg("row").over(ties)).withColumn("t", F.count(F.lit(1)).over(ties))
    sums = ranked.groupBy("label").agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"),
        F.count(F.lit(1)).alias("n"),
        F.max("t").alias("most_tied"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("tie_sum"),
    )
    all_labels = pairs.select("label").distinct()

    @F.pandas_udf("double")
    def tail(n: pd.Series, w: pd.Series, tied: pd.Series, tie_sum: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(*x) for x in zip(n, w, tied, tie_sum, strict=True)], dtype=float)

    tested = sums.withColumn("statistic", F.least("plus", "minus")).withColumn("p_value", tail("n", "statistic", "most_tied", "tie_sum"))
    return all_labels.join(tested, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce("p_value", F.lit(1.0)).alias("p_value")
    )


def signed_rank_p(n: int, w: float, most_tied: int, tie_sum: float) -> float:
    """Two-sided p value of the smaller rank sum."""
    n = int(n)
    if n <= 50 and most_tied == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * variance))) if variance > 0 else 1.0


def holm(tests: DataFrame) -> DataFrame:
    """Step-down correction within ``family`` of rows ``family, test, p_value``: adds ``p_holm``."""
    order = Window.partitionBy("family").orderBy("p_value", "test")
    size = F.count(F.lit(1)).over(Window.partitionBy("family"))
    step = tests.withColumn("raw", F.least(F.lit(1.0), F.col("p_value") * (size - F.row_number().over(order) + 1)))
    return step.withColumn("p_holm", F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def agreement(pairs: DataFrame, categories: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Exact agreement, Cohen's kappa and Gwet's AC1; kappa and AC1 are null where undefined."""
    q = len(categories)
    share = lambda side, c: F.avg((F.col(side) == c).cast("double"))
    rows = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"),
        *[share(a, c).alias(f"a{i}") for i, c in enumerate(categories)],
        *[share(b, c).alias(f"b{i}") for i, c in enumerate(categories)],
    )
    chance = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(q)), F.lit(0.0))
    mean = lambda i: (F.col(f"a{i}") + F.col(f"b{i}")) / 2
    gwet = sum((mean(i) * (1 - mean(i)) for i in range(q)), F.lit(0.0)) / max(1, q - 1)
    ratio = lambda e: F.when((F.col("n") > 0) & (F.abs(1 - e) > 1e-12), (F.col("exact") - e) / (1 - e))
    return rows.select("n", "exact", ratio(chance).alias("kappa"), ratio(gwet).alias("ac1"))


def binary_agreement(pairs: DataFrame, positive: str | int, a: str = "a", b: str = "b") -> DataFrame:
    """The 2x2 counts with positive and negative agreement."""
    x, y = F.col(a) == positive, F.col(b) == positive
    counts = pairs.agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither")
    )
    odd = F.col("only_a") + F.col("only_b")
    part = lambda c: F.try_divide(2.0 * F.col(c), 2.0 * F.col(c) + odd)
    return counts.withColumn("positive_agreement", part("both")).withColumn("negative_agreement", part("neither"))


def set_agreement(sets: DataFrame) -> DataFrame:
    """Jaccard and F1 per query of array columns ``a`` and ``b``; null where both are empty."""
    x, y = F.array_distinct("a"), F.array_distinct("b")
    both, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return sets.select(
        "query_id",
        F.try_divide(both.cast("double"), union.cast("double")).alias("jaccard"),
        F.try_divide(2.0 * both, (F.size(x) + F.size(y)).cast("double")).alias("f1"),
    )


def confusion(pairs: DataFrame, categories: list, a: str = "a", b: str = "b") -> DataFrame:
    """Counts of every pair of categories, zeros included."""
    grid = pairs.sparkSession.createDataFrame([(x, y) for x in categories for y in categories], f"a {pairs.schema[a].dataType.simpleString()}, b {pairs.schema[b].dataType.simpleString()}")
    counted = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return F.broadcast(grid).join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0)).alias("n"))
