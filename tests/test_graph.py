"""Expected values of the graph fixtures."""

from pyspark.sql import functions as F

from quillgraph.operators import chains, graph


def edges(spark, rows):
    return spark.createDataFrame([(s, t, r, "{}") for s, r, t in rows], "source string, target string, relation string, properties string")


def test_stack_parents(spark):
    df = spark.createDataFrame([("d", i, n, f"d_{i}") for i, n in enumerate([1, 2, 3, 2, 1], 1)], "doc string, pos int, level int, item string")
    got = {r["item"]: r["parent"] for r in graph.stack_parents(df, "doc", "pos", "level", "item").collect()}
    assert got == {"d_1": None, "d_2": "d_1", "d_3": "d_2", "d_4": "d_1", "d_5": None}
    assert graph.next_edges(df, "doc", "pos", "item").count() == 4


def test_mentions_whole_words(spark):
    chunks = spark.createDataFrame([("d_1", "Acme Pharma must act"), ("d_2", "Acmepharma is here"), ("d_3", None)], "chunk string, text string")
    nodes = spark.createDataFrame([("m:1", "Manufacturer", "Acme Pharma")], "id string, label string, name string")
    got = graph.mentions(chunks, nodes, "chunk", "text").collect()
    assert [(r["source"], r["target"]) for r in got] == [("d_1", "m:1")]


def test_citations(spark):
    texts = spark.createDataFrame([("ich_q7", "See ICH Q9 and ICH Q2 and ICH Q1 and ICH Q7")], "doc string, text string")
    catalogue = spark.createDataFrame([("ICHQ9", "ich_q9"), ("ICHQ2(R2)", "ich_q2r2"), ("ICHQ1(R1)", "q1a"), ("ICHQ1(R2)", "q1b"), ("ICHQ7", "ich_q7")], "code string, doc string")
    got = {r["target"] for r in graph.citations(texts, catalogue, "doc", "text").collect()}
    assert {"regdoc:ich_q9", "regdoc:ich_q2r2"} <= got and len(got) == 3 and any(x.startswith("regref:") for x in got)


def test_rules(spark):
    texts = spark.createDataFrame([("a", "This guideline complements\nICH Q2.")], "doc string, text string")
    rules = spark.createDataFrame(
        [("r1", "a", "COMPLEMENTS", "ich_q2", "complements.ICH Q2"), ("r2", "a", "SUPERSEDES", "x", "replaces"), ("r3", "b", "COVERS_TOPIC", "x", "y")],
        "rule_id string, source_doc_id string, relation string, target_value string, evidence_pattern string",
    )
    got = {r["rule_id"]: r["status"] for r in graph.rule_relations(texts, rules, "doc", "text").collect()}
    assert got == {"r1": "accepted", "r2": "rejected_evidence_not_found", "r3": "rejected_source_missing"}


def test_dedup_and_audits(spark):
    rows = edges(spark, [("a", "NEXT", "b"), ("a", "NEXT", "b"), ("b", "NEXT", "c")]).withColumn("seq", F.monotonically_increasing_id())
    assert graph.dedupe_edges(rows, "seq").count() == 2
    nodes = spark.createDataFrame([("a", "X", "a", "{}"), ("b", "X", "b", "{}")], "id string, label string, name string, properties string")
    assert [r["missing"] for r in graph.dangling(rows, nodes).collect()] == [["c"]]
    assert graph.append_missing(rows.drop("seq"), edges(spark, [("a", "NEXT", "b"), ("c", "NEXT", "d")])).count() == 4
    assert graph.extend(nodes, nodes).count() == 2
    assert graph.isolated(nodes, edges(spark, [("a", "NEXT", "a")])).first()["id"] == "b"


def test_paths_and_budget(spark):
    near = graph.adjacency(edges(spark, [("drug", "CONTAINS_API", "api"), ("api", "SUPPLIED_BY", "mfg"), ("chunk", "MENTIONS", "mfg"), ("drug", "INTERACTS_WITH", "other")]))
    anchors = spark.createDataFrame([("q", "drug")], "query_id string, node string")
    goals = spark.createDataFrame([("chunk",)], "node string")
    got = graph.bounded_paths(anchors, near, goals).collect()
    assert [(r["path"], r["rank"]) for r in got] == [(["drug", "api", "mfg", "chunk"], 1)]
    exact = graph.exact_budget_paths(anchors, near.toPandas(), {"chunk"}).collect()
    assert [r["path"] for r in exact] == [["drug", "api", "mfg", "chunk"]] and not exact[0]["truncated"]
    assert graph.exact_budget_paths(anchors, near.toPandas(), {"chunk"}, states=1).count() == 0


def test_ancestors(spark):
    got = graph.ancestors(edges(spark, [("r", "PARENT_OF", "a"), ("a", "PARENT_OF", "b")]), spark)
    assert {(r["node"], r["ancestor"], r["distance"]) for r in got.collect()} == {("r", "r", 0), ("a", "a", 0), ("b", "b", 0), ("a", "r", 1), ("b", "a", 1), ("b", "r", 2)}


def test_chains(spark):
    rows = [("drug:a", "CONTAINS_API", "api:a", True), ("api:a", "SUPPLIED_BY", "mfg:x", True), ("api:a", "SUPPLIED_BY", "mfg:y", False), ("drug:a", "BELONGS_TO_AREA", "api:a", False)]
    g = spark.createDataFrame(rows, "source string, relation string, target string, proven boolean")
    anchors = spark.createDataFrame([(1, "drug:a"), (1, "mfg:x"), (2, "nowhere")], "query_id int, node string")
    only = chains.chain_candidates(anchors.where("node = 'drug:a'"), g, 3)
    assert {n: only.where(f"size = {n}").count() for n in (1, 2, 3)} == {1: 2, 2: 5, 3: 4}
    assert {r["orientation"] for r in only.collect()} == {1.0}
    found = chains.chain_candidates(anchors, g, 3)
    assert {r["query_id"] for r in found.collect()} == {1} and found.count() == found.select("signature").distinct().count()
    assert chains.chain_candidates(anchors, g, 3, most_attempts=5).count() == 0
    assert chains.chain_candidates(anchors, g, 3, most_candidates=3).count() == 3
    question = spark.createDataFrame([(1, "Which suppliers, supplied by api a, replaced mfg x?")], "query_id int, question string")
    cues = chains.relation_cues(question)
    assert cues.first()["cues"] == ["SUPPLIED_BY"]
    words = spark.createDataFrame([("mfg:x", ["mfg", "x"]), ("mfg:y", ["mfg", "y"]), ("api:a", ["api", "a"])], "node string, tokens array<string>")
    asked = question.select("query_id", F.array(F.lit("api"), F.lit("a"), F.lit("mfg"), F.lit("x")).alias("tokens")).join(cues, "query_id")
    best = {r["method"]: r for r in chains.chain_rankings(found, asked, words).where("rank = 1").collect()}
    assert set(best) == {"b0", "m0", "cue_off", "direction_off", "r1"} and best["b0"]["score"] is None
    assert best["m0"]["score"] <= 1.1 < best["r1"]["score"]


def test_longest_spans(spark):
    hits = spark.createDataFrame([(1, 0, 1, "acme"), (1, 0, 2, "acme pharma"), (1, 4, 1, "x"), (1, 1, 2, "pharma co")], "id int, start int, n_words int, alias string")
    assert {r["alias"] for r in graph.longest_spans(hits).collect()} == {"acme pharma", "x"}
