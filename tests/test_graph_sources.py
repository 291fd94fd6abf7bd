"""Graphs from shortage, recall and table records."""

import json

from pyspark.sql import functions as F

from quillgraph.operators import graph_sources as gs
from quillgraph.plans import service_queries
from quillgraph.sources import readers, services, sinks


def test_shortages(spark):
    page = json.dumps({"results": [
        {"package_ndc": "1-2-3", "generic_name": "Example", "company_name": "Acme", "status": "Current", "initial_posting_date": "01/02/2026", "openfda": {"substance_name": ["EXAMPLE DRUG"]}},
        {"generic_name": "Other"},
    ]}).encode()
    pages = readers.paged_snapshot(spark, 1, 1, lambda skip, n: page)
    records = readers.read_shortages(readers.verified_pages(pages, pages))
    drugs = spark.createDataFrame([("drug:1", "Example drug")], "id string, name string")
    nodes, edges = gs.shortage_graph(records, drugs)
    assert {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()} == {
        "FDA_DrugShortageEvent": 2, "FDANDCProduct": 1, "FDAManufacturer": 1, "FDAActiveIngredient": 1}
    assert {r["relation"] for r in edges.collect()} == {"AFFECTS_NDC_PRODUCT", "REPORTED_BY", "HAS_ACTIVE_INGREDIENT", "SAME_AS_CANDIDATE"}
    event = nodes.where("name = 'Example' AND label = 'FDA_DrugShortageEvent'").first()["id"]
    queries = spark.createDataFrame([(1, ["example", "current"], ["123"])], "query_id int, terms array<string>, codes array<string>")
    found = gs.event_evidence(queries, spark.createDataFrame([(1, event)], "query_id int, node string"), nodes, edges).first()
    assert (found["event"], found["score"], found["rank"]) == (event, 102, 1)


def test_changed_page_is_an_error(spark):
    pages = readers.paged_snapshot(spark, 1, 1, lambda skip, n: b"x")
    other = spark.createDataFrame([(0, "no")], "skip long, sha256 string")
    try:
        readers.verified_pages(pages, other).collect()
        raise AssertionError("no error")
    except Exception as error:
        assert "manifest" in str(error)


def test_graph_round_trip_and_walks(spark, tmp_path):
    nodes = spark.createDataFrame([(x, "L", x, "{}") for x in "abc"], "id string, label string, name string, properties string")
    edges = spark.createDataFrame([("a", "b", "NEXT", "{}"), ("b", "c", "NEXT", "{}")], "source string, target string, relation string, properties string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    back, linked = readers.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == 3 and linked.count() == 2
    starts = spark.createDataFrame([(1, "a")], "query_id int, node string")
    assert gs.hashed_walk(starts, edges).first()["path"] == ["a", "b", "c"]
    assert gs.one_hop(starts, edges).count() == 1
    paths = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c"]), (3, ["a"])], "path_id int, path array<string>")
    assert [r["path_id"] for r in gs.broken_paths(paths, edges).collect()] == [2]
    assert gs.ambiguous_edges(edges.limit(0), edges).count() == 0
    assert sinks.cypher_script(nodes, edges).count() == 5


def test_recalls_and_tables(spark):
    drugs = spark.createDataFrame([("drug:1", "Example drug")], "id string, name string")
    recalls = spark.createDataFrame([("R1", "example DRUG", "Acme", "x"), ("", "y", "z", "w"), ("R2", "unknown", None, "x")], "recall_number string, product string, firm string, reason string")
    nodes, edges = gs.recall_graph(recalls, drugs)
    assert nodes.count() == 3 and {r["relation"] for r in edges.collect()} == {"WAS_RECALLED", "RECALLED_BY"}
    tables = spark.createDataFrame([("c1", "t", "s"), ("c9", "t", "s")], "chunk_id string, table string, table_summary string")
    made, has, lost = gs.table_graph(tables, spark.createDataFrame([("c1",)], "chunk_id string"))
    assert (made.count(), has.count(), [r["chunk_id"] for r in lost.collect()]) == (1, 1, ["c9"])
    rules = spark.createDataFrame([(None, "ich_q7"), ("USA", "cgmp")], "country string, regulation string")
    makers = spark.createDataFrame([("m1", "USA"), ("m2", "India")], "id string, country string")
    assert gs.regulation_edges(makers, rules).count() == 3


def test_saved_pages_stay_small(spark, monkeypatch):
    """A search with many recalls has many pages, none of more records than a service gives; no record is lost."""
    seen, made = [], services.enforcement_reports
    monkeypatch.setattr(services, "enforcement_reports", lambda pages: seen.append(pages) or made(pages))
    assert service_queries.enforcement_reports(spark, "/root/testdata/sf0.01").count() == 50
    sizes = seen[0].select("key", F.size(F.from_json(F.col("body").cast("string"), "results array<struct<recall_number: string>>")["results"]).alias("n")).toPandas()
    assert sizes["n"].max() <= 1000 and sizes.groupby("key")["n"].sum().max() > 1000
    assert sizes["n"].sum() == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
