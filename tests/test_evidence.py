"""Small fixtures of records, evidence routes and retained rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dense, evidence, fusion, records
from quillgraph.plans import evidence_queries  # noqa: F401
from quillgraph.plans.registry import ORACLE_SQL, QUERIES
from quillgraph.scratch import released, spread, staged


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_similarity(spark):
    alike = lambda a, b: one(spark, records.content_similarity(F.lit(a), F.lit(b)))
    assert alike("The shelf life", "shelf life") == 1.0 and alike("", "x") == 0.0 and alike(None, "x") == 0.0
    assert 0 < alike("storage at room temperature", "stored at a temperature") < 1


def test_folded_tokens(spark):
    assert one(spark, records.normalized_tokens(F.lit("ＩＣＨ Q9① ﬁne"))) == ["ich", "q91", "fine"]
    assert one(spark, records.normalized_tokens(F.lit(None).cast("string"))) == []


def test_forbidden_paths(spark):
    found = lambda t: one(spark, records.forbidden_paths(["gold"])(F.lit(t)))
    assert found('{"a": [{"gold": 1}, {"b": {"gold": {"gold": 2}}}]}') == ["a[0].gold", "a[1].b.gold", "a[1].b.gold.gold"]
    assert found("no json") == [] and found(None) == []


def test_entity_text(spark):
    said = lambda *c: one(spark, records.entity_text(*[F.lit(x).cast("string") for x in c]))
    assert said("Manufacturer", "Acme", None, "A") == "Acme is a manufacturer, rated A."
    assert said("Region", "North", None, None) == "North is a region."


def kept_by_hand(rows, top_k):
    """Required rows swapped in one after the other."""
    rows = sorted(rows, key=lambda r: r[2])
    for want in [r for r in rows if r[3]]:
        head = rows[:top_k]
        spare = [r for r in head if not r[3]]
        if want in head or not spare:
            continue
        out = min(spare, key=lambda r: (r[1], r[0]))
        place = rows.index(out)
        rows.remove(want)
        rows[place] = want
        rows.insert(top_k, out)
    return [r[0] for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_retained_rows_by_hand(spark, seed):
    rng, data, want = random.Random(seed), [], {}
    for q in range(30):
        n = rng.randrange(1, 14)
        rows = [(f"i{k}", round(1 - k / 50 - (0.0 if rng.random() < 0.5 else 0.01), 3), k + 1, rng.random() < 0.3) for k in range(n)]
        rows = [(i, s, r, f) for r, (i, s, _, f) in enumerate(sorted(rows, key=lambda x: -x[1]), 1)]
        want[q] = kept_by_hand(rows, 5)
        data += [(q, *r) for r in rows]
    df = spark.createDataFrame(data, "query_id int, item string, score double, rank int, required boolean")
    got = {}
    for r in fusion._retained(df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item"])
    assert got == want


def test_blocked_search_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)] if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plain = dense.dense_top_k(df.where("embedding IS NOT NULL"), queries.where("query_vector IS NOT NULL"), 5)
    found = dense.dense_top_k_blocked(df, queries, 5, chunk_rows=37, block_rows=16)
    key = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in d.collect())
    assert key(found) == key(plain) and len(key(found)) == 5 * 90
    assert dense.dense_top_k_blocked(df.limit(0), queries, 5).count() == 0


def test_short_paths_stop_where_there_are_enough(spark):
    edges = spark.createDataFrame([("a", "r", f"b{i}") for i in range(30)] + [("b0", "r", "c"), ("a", "s", "b1")], "source string, relation string, target string")
    starts = spark.createDataFrame([("a",), ("c",), ("z",)], "node string")
    got = evidence.short_paths(starts, edges, depth=3, most=10).collect()
    by = lambda s: [r["path"] for r in sorted(got, key=lambda r: r["rank"]) if r["start"] == s]
    assert len(by("a")) == 10 and all(len(p) == 2 for p in by("a")) and by("z") == []
    assert by("c")[:2] == [["c", "b0"], ["c", "b0", "a"]] and len(by("c")) == 10


def test_concentration_needs_three_hits(spark):
    rows = [(1, "x", "d1", "s1"), (1, "y", "d1", "s2"), (1, "z", "d1", "s2"), (2, "x", "d1", "s1"), (2, "q", "d2", "s1")]
    hits = spark.createDataFrame(rows, "query_id int, item string, doc string, section string")
    found = evidence.concentration(hits, "doc", "section").collect()
    assert [(r["query_id"], r["doc"], r["section"], r["n"]) for r in found] == [(1, "d1", "s2", 3)]


def test_staged_tables_and_spreading(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string").coalesce(1)
    kept = staged(df, "test")
    assert kept.collect() == df.collect() and spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    released(kept)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        kept.collect()


@pytest.mark.parametrize("seed", range(2))
def test_pool_with_repeats_and_a_large_document(spark, tmp_path, seed):
    """One document has most chunks, rows repeat, ids of two documents meet, documents are null."""
    rng = random.Random(seed)
    rows = [(1, t) for t in range(300)] + [(c, t) for c in range(2, 9) for t in range(4)] + [(5, 1002), (4, 2), (4, 2), (4, 3), (7, 2), (None, 2), (None, 3)]
    rows += [rng.choice(rows[:300]) for _ in range(30)]
    table = pd.DataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "x") for c, t in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})
    table.to_parquet(tmp_path / "conversations.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
        want = db.execute(ORACLE_SQL["confirmatory_pool"]).fetchall()
    got = QUERIES["confirmatory_pool"](spark, str(tmp_path)).select("query_id", "chunk_id", "kind").collect()
    key = lambda r: tuple((v is None, v or 0) for v in r[:2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pool_meets_few_rows_a_seed(spark):
    """What is read for distractors is a row a seed and a row a bucket, not a part of all chunks for each seed."""
    chunks = spark.range(60_000).select(F.col("id").alias("chunk_id"), (F.col("id") % 6000).alias("doc_id"), (F.col("id") % 6000).alias("parent"), F.lit(0).alias("seq"), F.lit(1).alias("level"))
    pool = records.confirmatory_pool(chunks.where("chunk_id < 6000").select(F.col("doc_id").alias("query_id"), "chunk_id"), chunks, siblings=2)
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and pool.where("kind = 'distractor'").groupBy("query_id").count().where("count = 4").count() > 5_990
