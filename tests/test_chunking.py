"""Chunking and enrichment on small texts."""

from pyspark.sql import functions as F

from quillgraph.operators import chunking, enrichment

TEXT = """# Guide
Running Head Line
Some words that break
off here. More text.
12

Running Head Line
## 1.1 Scope
| Name | Col2 | Limit |
|---|---|---|
| a | b | c |
After the table [3].
Running Head Line
# Annex
Last words.
"""


def test_cleaning():
    out = chunking.clean(TEXT)
    assert "Running Head Line" not in out and "\n12\n" not in out and "break off here" in out
    assert chunking.rejoin(["Ends.", "lower"]) == ["Ends.", "lower"] and chunking.promote("2.3 Risk review") == "## 2.3 Risk review"


def test_chunks(spark):
    rows = chunking.chunk_documents(spark.createDataFrame([("d", TEXT), ("e", None)], "doc_id string, text string"))
    got = rows.orderBy("seq").collect()
    assert [(r["heading"], r["level"], r["parents_context"]) for r in got] == [("Guide", 1, ""), ("1.1 Scope", 2, "Guide"), ("Annex", 1, "")]
    assert got[1]["has_table"] and len(got[1]["table_refs"]) == 1 and "[表: Name, Limit]" in got[1]["content"]
    assert "[3]" not in got[1]["search_text"]
    linked = {r["seq"]: r for r in chunking.linked_chunks(rows).collect()}
    assert linked[1]["children_count"] == 1 and linked[2]["prev_chunk_id"] == got[0]["chunk_id"] and linked[3]["next_chunk_id"] is None


def test_splitting_loses_nothing():
    text = ". ".join(f"sentence {i} with a few words" for i in range(300))
    parts = chunking.split_text(text, 500)
    assert max(map(len, parts)) <= 500 and ". ".join(parts) == text
    assert "".join(chunking.force_split("x" * 1200, 500)) == "x" * 1200
    assert len(chunking.with_overlap(parts)) == len(parts)


def test_question_guards(spark):
    chunks = spark.createDataFrame([("c", "Risk", "", "ICH Q9 says much about risk")], "chunk_id string, heading string, parents_context string, content string")
    raw = "1. What does ICH Q9 say about the risk?\n2. Why?\n3. What does the FDA say about the risk here?\n4. 风险是什么呢 what about risk and more?"
    answers = spark.createDataFrame([("c", raw)], "key string, answer string")
    r = enrichment.guarded_questions(chunks, answers).first()
    assert r["hyde_questions"] == ["What does ICH Q9 say about the risk?"]
    assert (r["malformed_filtered"], r["cjk_filtered"], r["unsupported_reference_filtered"]) == (1, 1, 1)


def test_cached_calls_are_not_made(spark):
    prompts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "known")], "key string, answer string")
    got = {r["key"]: r["answer"] for r in enrichment.complete(prompts, lambda ps: [p.upper() for p in ps], cache).collect()}
    assert got == {"a": "known", "b": "Y"}


def test_table_summary(spark):
    html = "<table><tr><th>Name</th><th>Max <b>dose</b></th></tr><tr><td>a</td><td>1</td></tr></table>"
    got = spark.range(1).select(enrichment.html_table_summary(F.lit(html)).alias("s")).first()["s"]
    assert got == "Table with 1 rows and columns: Name, Max dose"


def test_hierarchy_budget(spark):
    chunks = spark.createDataFrame([("p", 1, 1, "head"), ("x", 2, 2, "a" * 50), ("y", 3, 2, "b" * 80), ("z", 4, 2, "c" * 30)], "chunk_id string, seq int, level int, content string")
    parents = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "p"), ("p", None)], "chunk_id string, parent string")
    assert enrichment.hierarchy_units(chunks, parents, 100).first()["depends_on"] == ["x", "z"]
