"""Expected values of the statistics fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import stats


def pairs(spark, a, b, label="x"):
    return spark.createDataFrame([(label, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "label string, unit int, treatment double, baseline double")


def test_mcnemar(spark):
    r = stats.mcnemar(pairs(spark, [1, 1, 0, 1], [0, 1, 1, 0])).first()
    assert (r["improvements"], r["regressions"], r["discordant"]) == (2, 1, 3) and r["p_value"] == pytest.approx(1.0)
    assert stats.mcnemar(pairs(spark, [1, 0], [1, 0])).first()["p_value"] == 1
    r = stats.mcnemar(pairs(spark, [1] * 60, [0] * 60)).first()
    assert r["p_value"] == pytest.approx(2 * 0.5**60, rel=1e-6)


def test_wilcoxon(spark):
    assert stats.wilcoxon(pairs(spark, [1, 2], [1, 2])).first()["p_value"] == 1
    r = stats.wilcoxon(pairs(spark, [1, 2, 3, 4, 5], [0, 0, 0, 0, 0])).first()
    assert r["statistic"] == 0 and r["p_value"] == pytest.approx(2 / 2**5)
    r = stats.wilcoxon(pairs(spark, [1, 1, -1, 1, 1, 1], [0] * 6)).first()
    z = (3.5 - 10.5) / math.sqrt(6 * 7 * 13 / 24 - (6**3 - 6) / 48)
    assert r["p_value"] == pytest.approx(math.erfc(-z / math.sqrt(2)))


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.5)], "family string, test string, p_value double")
    got = {r["test"]: round(r["p_holm"], 6) for r in stats.holm(df).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06, "d": 0.5}


def test_agreement(spark):
    both = lambda rows: stats.agreement(spark.createDataFrame(rows, "a string, b string"), ["y", "n"]).first()
    r = both([("y", "y"), ("n", "n")])
    assert (r["kappa"], r["ac1"]) == (1, 1)
    r = both([("y", "y")] * 58 + [("y", "n")] * 2)
    assert r["kappa"] == pytest.approx(0) and r["ac1"] > 0.96
    r = both([])
    assert r["n"] == 0 and r["kappa"] is None and r["ac1"] is None


def test_set_agreement(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], [])], "query_id int, a array<string>, b array<string>")
    got = {r["query_id"]: (r["jaccard"], r["f1"]) for r in stats.set_agreement(df).collect()}
    assert got == {1: (0.5, pytest.approx(2 / 3)), 2: (None, None)}


def test_bootstraps(spark):
    values = spark.createDataFrame([("x", i, float(i % 2)) for i in range(60)], "label string, unit int, value double")
    for found in (stats.bootstrap_means(values, 400), stats.bootstrap_exact(values, 2000), stats.cluster_bootstrap(values, 400)):
        r = found.first()
        assert r["mean"] == pytest.approx(0.5) and 0.3 < r["low"] < 0.45 and 0.55 < r["high"] < 0.7
    rng = np.random.default_rng(stats.stable_seed(20260716, "x"))
    x = np.array([i % 2 for i in range(60)], float)
    means = x[rng.integers(0, 60, size=(2000, 60))].mean(axis=1)
    assert stats.bootstrap_exact(values, 2000).first()["low"] == round(float(np.quantile(means, 0.025)), 6)
    assert stats.bootstrap_means(values, 50).collect() == stats.bootstrap_means(values.orderBy(F.desc("unit")), 50).collect()


def test_cluster_draws_dont_travel(spark):
    """The samples are those of the row-by-row join, over several blocks and with nulls; no row is made for a draw."""
    unit = F.col("id") % 9000
    values = spark.range(18_100).select(F.lit("x").alias("label"), unit.alias("unit"), F.when(unit % 7 != 0, F.sqrt("id")).alias("value"))
    found = stats.cluster_bootstrap(values, 7, seed=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # the samples
    groups = values.toPandas().groupby("unit")["value"].agg([lambda v: v.sum(min_count=1), "size"]).to_numpy()
    draws = spark.range(9000).crossJoin(spark.range(7).select(F.col("id").cast("int").alias("b"))).select("b", F.pmod(F.xxhash64(F.lit(3), F.lit("x"), "b", "id"), F.lit(9000)).alias("nth")).toPandas()
    means = [np.nansum(groups[d, 0]) / groups[d, 1].sum() for d in (x["nth"].to_numpy() for _, x in draws.groupby("b"))]
    r = found.first()
    assert r["n"] == 9000 and (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), rel=1e-12)
    nothing = stats.cluster_bootstrap(values.withColumn("value", F.lit(None).cast("double")), 2).first()
    assert nothing["n"] == 9000 and nothing["mean"] is None and nothing["low"] is None


def test_exact_draws_are_held_in_parts(spark):
    """A label of many units holds some of its samples at a time, and draws the same."""
    x = np.arange(2_000, dtype=float)
    rng = np.random.default_rng(stats.stable_seed(20260716, "x"))
    means = x[rng.integers(0, 2_000, size=(1_500, 2_000))].mean(axis=1)
    values = spark.range(2_000).select(F.lit("x").alias("label"), F.col("id").alias("unit"), F.col("id").cast("double").alias("value"))
    assert 1_500 * 2_000 > 2 * stats.DRAWN_AT_ONCE
    r = stats.bootstrap_exact(values, 1_500).first()
    assert (r["low"], r["high"]) == tuple(round(q, 6) for q in np.quantile(means, [0.025, 0.975]))


def test_confusion_has_zeros(spark):
    df = spark.createDataFrame([("y", "y"), ("y", "n")], "a string, b string")
    assert {(r["a"], r["b"]): r["n"] for r in stats.confusion(df, ["y", "n"]).collect()} == {("y", "y"): 1, ("y", "n"): 1, ("n", "y"): 0, ("n", "n"): 0}


def test_bootstrap_query_draws_ten_thousand(spark, monkeypatch):
    from quillgraph.plans import retrieval_queries

    asked = {}
    monkeypatch.setattr(stats, "bootstrap_means", lambda values, **k: asked.update(k) or values)
    assert retrieval_queries.bootstrap_intervals(spark, "/root/testdata/sf0.001").count() > 0
    assert asked["iterations"] == 10_000
