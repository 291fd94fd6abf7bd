"""Expected values of the retrieval fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.operators import dense, fusion, lexical, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.lit("ICH Q14: Risk-based/ATP"))) == ["ich", "q14", "risk", "based", "atp"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, text.normalize_alias(F.lit("Acme (US) Pharma, Inc."))) == "acme pharma inc"
    assert one(spark, text.ndc_codes(F.lit("NDC 12345-678-90 and 1-2-3"))) == ["1234567890"]
    assert one(spark, text.parse_ids(F.lit("a; b\n;a"))) == ["a", "b"]
    assert set(one(spark, text.document_aliases(F.lit("ich_q9")))) == {"ich q9", "q9"}


def test_routes(spark):
    route = lambda q, named=False: one(spark, text.route(F.lit(q), F.lit(named)))
    assert route("Which table in ICH Q9 concerns a drug shortage?", True) == "table"
    assert route("Which section covers it", True) == "hierarchy"
    assert route("ICH Q9 scope", True) == "lexical" and route("what is risk") == "semantic"
    assert one(spark, text.wants_graph(F.lit("Which table in ICH Q9 concerns a drug shortage?")))
    assert not one(spark, text.has_any_term(F.lit("tablets"))) and one(spark, text.has_any_term(F.lit("tablets"), ("table",), whole=False))


def test_bm25_drops_zero_scores(spark):
    chunks = spark.createDataFrame([("a", "Viral clearance\nmodel virus selection"), ("b", "Stability\nstorage conditions")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "model virus")], "query_id int, query string")
    got = lexical.bm25_rank(lexical.build_index(chunks), queries).collect()
    assert [(r["doc"], r["rank"]) for r in got] == [("a", 1)]


def test_bm25_value(spark):
    docs = spark.createDataFrame([(1, "x x y"), (2, "y z"), (3, "z")], "doc_id int, text string")
    got = {r["doc"]: r["score"] for r in lexical.bm25_scores(lexical.build_index(docs), lexical.query_terms(spark.createDataFrame([(1, "x x")], "query_id int, query string"))).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))}


def ranking(spark, lists):
    rows = [(1, f"r{i}", i, x, n + 1) for i, items in enumerate(lists) for n, x in enumerate(items)]
    return spark.createDataFrame(rows, "query_id int, route string, list int, item string, rank int")


def order(df):
    return [r["item"] for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    lists = ranking(spark, [["a", "b"], ["b", "c"]])
    assert order(fusion.rrf(lists)) == ["b", "a", "c"] and order(fusion.rrf(lists, ties="list")) == ["b", "a", "c"]
    assert order(fusion.weighted_rrf(lists.withColumn("weight", F.lit(1.0)))) == ["b", "a", "c"]


def test_sidecar_hits_keep_their_first_rank(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.8), (1, "b", 3, 0.95)], "query_id int, item string, rank int, score double")
    assert order(dense.dedupe_ranking(hits, "item")) == ["a", "b"] and order(dense.best_per_item(hits, "item")) == ["b", "a"]


def test_gate_leaves_bm25_alone(spark):
    bm25, other = ranking(spark, [["c1", "c2", "c3"]]), ranking(spark, [["c3", "c1"]])
    routes = spark.createDataFrame([(1, "semantic")], "query_id int, text_route string")
    tables = spark.createDataFrame([("c1",), ("c2",)], "item string")
    none = tables.limit(0)
    off = fusion.selective_rerank(bm25, other, routes, none)
    assert order(off) == ["c1", "c2", "c3"] and {r["reason"] for r in off.collect()} == {"insufficient_table_support"}
    on = fusion.selective_rerank(bm25, other, routes, tables, support_depth=2)
    assert {r["reason"] for r in on.collect()} == {"candidate_table_support"} and order(on)[0] == "c1"


def test_lexical_top1_is_protected(spark):
    bm25, other = ranking(spark, [["c1", "c2"]]), ranking(spark, [["c2"]])
    routes = spark.createDataFrame([(1, "lexical")], "query_id int, text_route string")
    none = spark.createDataFrame([], "query_id int, item string, explicit_document boolean, is_table boolean, selected_rank int")
    assert order(fusion.routed_rerank(bm25, other, routes, none))[0] == "c2"
    assert order(fusion.routed_rerank(bm25, other, routes, none, fusion.RerankWeights(lexical=1.25)))[0] == "c1"


def test_adaptive_ignores_an_ungated_graph(spark):
    rows = [(1, "bottom_up", "text-1", 1), (1, "graph_path", "graph-only", 1)]
    lists = spark.createDataFrame(rows, "query_id int, route string, item string, rank int")
    gates = spark.createDataFrame([(1, False)], "query_id int, graph_on boolean")
    boosts = spark.createDataFrame([], "query_id int, item string, explicit_document boolean, table_match boolean, overlap double")
    assert order(fusion.adaptive_rank(lists, gates, boosts)) == ["text-1"]


def test_adaptive_keeps_text_routes(spark):
    rows = [(1, "bottom_up", "bottom-1", 1), (1, "top_down", "top-1", 1)] + [(1, "graph_path", f"g{i}", i) for i in range(1, 8)]
    lists = spark.createDataFrame(rows, "query_id int, route string, item string, rank int")
    gates = spark.createDataFrame([(1, True)], "query_id int, graph_on boolean")
    boosts = spark.createDataFrame([], "query_id int, item string, explicit_document boolean, table_match boolean, overlap double")
    got = fusion.adaptive_rank(lists, gates, boosts, fusion.AdaptiveWeights(graph=20.0))
    assert {"bottom-1", "top-1"} <= set(order(got)[:5]) and got.where("retained").count() == 2


def test_gate_reasons(spark):
    kind = "query_id int, structured int, graph_rows int, anchor_labels array<string>, reachable_documents array<string>, selected_documents array<string>, explicit_documents array<string>"
    rows = [
        (1, 1, 0, [], [], [], []), (2, 0, 1, [], [], [], []), (3, 0, 1, ["RegulatoryDocument"], [], [], []),
        (4, 0, 1, ["RegulatoryTopic"], ["d"], [], ["d"]), (5, 0, 1, ["NDC"], ["d"], ["d"], []), (6, 0, 1, ["NDC"], ["d"], [], ["d"]),
    ]
    got = {r["query_id"]: (r["graph_on"], r["gate_reason"]) for r in fusion.graph_gate(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (True, "direct_structured_record") and got[2] == (False, "no_qualified_graph_anchor")
    assert [got[i][0] for i in (3, 4, 5, 6)] == [True, True, True, False]


def metric_rows(spark, items, gold):
    rows = [("m", 1, x, n + 1) for n, x in enumerate(items)]
    ranked = spark.createDataFrame(rows, "method string, query_id int, item string, rank int")
    golds = spark.createDataFrame([(1, g) for g in gold], "query_id int, item string")
    return metrics.query_metrics(ranked, golds, ks=(1, 2, 3, 5, 50)).first()


def test_metrics(spark):
    r = metric_rows(spark, ["x", "a", "b"], ["a", "b"])
    assert (r["hit1"], r["hit3"], r["mrr"]) == (0, 1, 0.5) and r["ndcg5"] > 0
    r = metric_rows(spark, [f"c{i}" for i in range(1, 51)], ["c2", "c5"])
    assert (r["hit1"], r["hit3"], r["hit5"], r["hit50"], r["mrr"]) == (0, 1, 1, 1, 0.5)
    assert r["ndcg5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3)))
    r = metric_rows(spark, ["a", "a"], ["a"])
    assert (r["precision2"], r["recall2"]) == (0.5, 1)


def test_contiguous_paths(spark):
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, metrics.contiguous(a("b", "c"), a("a", "b", "c", "d")))
    assert not one(spark, metrics.contiguous(a("a", "c"), a("a", "b", "c"))) and not one(spark, metrics.contiguous(a("a", "b"), a("a")))


def test_ids(spark):
    assert one(spark, ids.surrogate_id("drug", F.lit("Example Drug"))) == "drug:example-drug"
    assert len(one(spark, ids.surrogate_id("drug", F.lit("药")))) == len("drug:") + 20
    assert one(spark, ids.allowed_ids(F.array(F.lit("x"), F.lit("c1"), F.lit("c1")), F.array(F.lit("c1")))) == ["c1"]
    assert one(spark, F.to_json(ids.model_json(F.lit('```json\n{"a": 1}\n```')))) == '{"a":1}'
    assert one(spark, ids.model_json(F.lit("no object"))) is None
