"""Queries of sources, sinks, identifiers, text functions, reviews and locks, over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import ids, text, vectors
from quillgraph.operators import dense, enrichment, fusion, graph, integrity, metrics, sampling
from quillgraph.plans import graph_queries as gq
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import _STOPS, TOKENS
from quillgraph.scratch import fresh_path
from quillgraph.sources import readers, sinks

# --- sources and sinks -------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents")
def jsonl_documents(spark, sf_dir):
    """1.3, 1.4, 2.1: all documents written as JSON lines in order and read back."""
    path = fresh_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    sinks.write_jsonl(docs, path, ["doc_id"])
    back = readers.read_jsonl(spark, path, docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def csv_suppliers(spark, sf_dir):
    """1.10, 2.4: all suppliers written as CSV and read back as strings."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name", "s_nationkey"])
    return readers.read_csv_strings(spark, path)


@query(f"WITH {gq._EDGES} SELECT relation, count(*) AS edges, count(DISTINCT source) AS sources, 1::BIGINT AS provenances FROM edges WHERE relation IN ('LOCATED_IN', 'BELONGS_TO_AREA') GROUP BY relation")
def graph_snapshot(spark, sf_dir):
    """1.5, 1.6, 13.1: the supply graph written as a snapshot, read with its checks and projected to two relations."""
    folder = fresh_path(spark, "graph")
    sinks.write_graph(gq._nodes(spark, sf_dir), gq._edges(spark, sf_dir), folder)
    _, edges = readers.read_graph(spark, folder)
    kept = readers.projected_graph(edges, ["LOCATED_IN", "BELONGS_TO_AREA"])
    return kept.groupBy("relation").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.max(F.size("provenance")).cast("long").alias("provenances")
    )


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def second_parents(spark, sf_dir):
    """1.5: parts that hang under more than one supplier."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("PARENT_OF").alias("relation"))
    return readers.second_parents(edges).select(F.col("target").alias("part"), "parents")


@query("SELECT skip, sha256('page ' || skip || ' of 500') AS sha256 FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer), 500)) AS skip)")
def paged_scan(spark, sf_dir):
    """1.12, 1.13, 1.14, 20.2: a paged service read through an injected fetcher that fails once, and checked against its manifest."""

    def fetch(skip: int, page: int) -> bytes:
        tried: list[int] = []

        def once(url: str) -> bytes:
            tried.append(1)
            if len(tried) == 1:
                raise OSError(url)
            return f"page {skip} of {page}".encode()

        return readers.retrying(once, wait=lambda s: None)(f"skip={skip}")

    total = table(spark, sf_dir, "customer").count()
    pages = readers.paged_snapshot(spark, total, 500, fetch)
    return readers.verified_pages(pages, pages.select("skip", "sha256")).select("skip", "sha256")


def _shortage_pages(spark, sf_dir):
    """Raw pages of a shortage service, one per nation, made from the suppliers."""
    record = F.struct(
        F.format_string("%05d-%03d-%02d", "s_suppkey", F.lit(12), F.lit(3)).alias("package_ndc"),
        F.col("s_name").alias("generic_name"),
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("Company "), F.col("s_nationkey").cast("string"))).alias("company_name"),
        F.when(F.col("s_acctbal") < 0, "Demand increase").when(F.col("s_acctbal") < 5000, "Shortage of ingredient").alias("shortage_reason"),
        F.struct(F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat(F.lit("Ingredient "), (F.col("s_suppkey") % 7).cast("string")))).alias("substance_name")).alias("openfda"),
    )
    grouped = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(record).alias("results"))
    return grouped.select(F.to_json(F.struct("results")).cast("binary").alias("body"))


@query(
    """SELECT CASE WHEN s_acctbal < 0 THEN 'Demand increase' WHEN s_acctbal < 5000 THEN 'Shortage of ingredient' ELSE '' END AS shortage_reason,
    count(*) AS n, count_if(s_suppkey % 3 = 0)::BIGINT AS with_ingredient, count_if(s_suppkey % 5 = 0)::BIGINT AS without_company FROM supplier GROUP BY 1"""
)
def shortage_reasons(spark, sf_dir):
    """1.15: shortage records out of raw pages, with the histogram of their reasons."""
    rows = readers.read_shortages(_shortage_pages(spark, sf_dir))
    return rows.groupBy("shortage_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("ingredients") > 0).alias("with_ingredient"), F.count_if(F.col("company_name") == "").alias("without_company")
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 != 0")
def resumed_rows(spark, sf_dir):
    """2.3: what a resumable job has left to do once a third is done."""
    path = fresh_path(spark, "done")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    sinks.append_done(customers.where("c_custkey % 3 = 0"), path)
    return sinks.checkpointed(customers, "c_custkey", path)


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part")
def upserted_parts(spark, sf_dir):
    """2.5, 2.6: rows put in place of those with the same key."""
    base = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return sinks.upsert(base, base.where("p_partkey % 10 = 0").withColumn("p_name", F.upper("p_name")), ["p_partkey"])


@query(
    f"""WITH {gq._NODES}, {gq._EDGES} SELECT 'MERGE (n:' || label || ' {{id: ''' || id || '''}}) SET n.name = ''' || name || ''';' AS statement FROM nodes
    UNION ALL SELECT 'MATCH (a {{id: ''' || source || '''}}), (b {{id: ''' || target || '''}}) MERGE (a)-[:' || relation || ']->(b);' FROM edges"""
)
def cypher_lines(spark, sf_dir):
    """2.7: the supply graph as statements for a graph database."""
    return sinks.cypher_script(gq._nodes(spark, sf_dir), gq._edges(spark, sf_dir)).select("statement")


@query(
    """SELECT 'doc' || l_suppkey || '_C' || l_linenumber AS chunk_id, 'doc' || l_suppkey AS doc_id, 'heading ' || l_linenumber AS heading, count(*) AS tables
    FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0 GROUP BY ALL"""
)
def referenced_tables(spark, sf_dir):
    """1.7: table records that have a summary and whose chunk is known."""
    items = table(spark, sf_dir, "lineitem").withColumn("chunk_id", F.format_string("doc%d_C%d", "l_suppkey", "l_linenumber"))
    tables = items.select("chunk_id", F.when(F.col("l_returnflag") == "R", F.lit("a summary")).otherwise(" ").alias("table_summary"))
    chunks = items.where("l_suppkey % 2 = 0").select("chunk_id", F.concat(F.lit("heading "), F.col("l_linenumber").cast("string")).alias("heading")).distinct()
    return readers.table_records(tables, chunks).groupBy("chunk_id", "doc_id", "heading").agg(F.count(F.lit(1)).alias("tables"))


@query("SELECT source, count(*) AS chunks, max(doc_id) AS last_id FROM documents WHERE source IS NOT NULL GROUP BY source")
def chunk_document_map(spark, sf_dir):
    """1.24, 1.25: ids and the document of every chunk, with the contract that ids are there."""
    docs = readers.must(table(spark, sf_dir, "documents"), F.col("doc_id").isNull(), "a document has no id")
    return docs.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("doc_id").alias("last_id"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(text) != ''")
def runnable_queries(spark, sf_dir):
    """1.29, 18.8: the queries of a bundle that may be run; blank ones go, a prohibited bundle would stop the job."""
    bundle = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("query", F.col("text")).withColumn("prohibited_for_formal_evaluation", F.lit(False))
    return readers.prohibited(bundle).select("conv_id", "turn")


# --- text and identifiers ----------------------------------------------------

_NDC = "lpad(p_partkey::VARCHAR, 5, '0') || '-' || lpad((p_size)::VARCHAR, 3, '0') || '-01'"


@query(
    rf"""WITH t AS (SELECT p_partkey, 'What of the ICH Q' || (p_partkey % 12) || ' in ' || p_name || ' by ' || p_brand || ' NDC ' || {_NDC} AS t FROM part),
    k AS (SELECT p_partkey, t, [lower(x) FOR x IN list_concat(regexp_extract_all(t, '\b[A-Z]{{1,5}}\s*[A-Za-z]?\d+[A-Za-z0-9]*'), regexp_extract_all(t, '[A-Za-z]{{3,}}')) IF NOT list_contains({_STOPS}, lower(x))] AS raw FROM t)
    SELECT p_partkey, array_to_string([x FOR x, i IN raw IF list_position(raw, x) = i], ' ') AS keywords,
           array_to_string([x FOR x IN {TOKENS.format("t")} IF len(x) >= 3 AND NOT list_contains({_STOPS}, x)][:6], ' ') AS first_words,
           replace({_NDC.replace("p_partkey", "k.p_partkey")}, '-', '') AS codes
    FROM k JOIN part USING (p_partkey)"""
)
def text_keywords(spark, sf_dir):
    """5.7, 5.8, 5.9: codes, words and package codes of texts made from the parts."""
    made = F.concat(
        F.lit("What of the ICH Q"), (F.col("p_partkey") % 12).cast("string"), F.lit(" in "), "p_name", F.lit(" by "), "p_brand",
        F.lit(" NDC "), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("-01"),
    )
    rows = table(spark, sf_dir, "part").withColumn("t", made)
    return rows.select(
        "p_partkey", F.array_join(text.keywords("t"), " ").alias("keywords"), F.array_join(text.first_keywords("t"), " ").alias("first_words"),
        F.array_join(text.ndc_codes("t"), " ").alias("codes"),
    )


@query(
    f"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(['ich_q', 'EMA-GMP-Annex-', 'fda cGMP ', 'WHO TRS '][1 + p_partkey % 4] || (p_partkey % 40)), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
    f AS (SELECT p_partkey, [b, regexp_extract(b, '^(?:ich|ema|fda|who) (.+)$', 1), regexp_extract(b, '^ema gmp (annex [a-z0-9]+)', 1),
            CASE WHEN regexp_matches(b, '^fda cgmp( |$)') THEN 'fda cgmp' ELSE '' END, CASE WHEN regexp_matches(b, '^fda cgmp( |$)') THEN 'cgmp guidance' ELSE '' END,
            CASE WHEN regexp_extract(b, '^ich ([a-z0-9]+)', 1) != '' THEN 'ich ' || regexp_extract(b, '^ich ([a-z0-9]+)', 1) ELSE '' END, regexp_extract(b, '^ich ([a-z0-9]+)', 1)] AS forms FROM n)
    SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN forms IF len(x) >= 2])), '|') AS aliases FROM f"""
)
def document_alias_sets(spark, sf_dir):
    """5.11: the names that document ids answer to."""
    kinds = F.array(F.lit("ich_q"), F.lit("EMA-GMP-Annex-"), F.lit("fda cGMP "), F.lit("WHO TRS "))
    doc = F.concat(F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")), (F.col("p_partkey") % 40).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.document_aliases(doc)), "|").alias("aliases"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations),
    w AS (SELECT conv_id, turn, list_distinct([t FOR t IN {TOKENS.format("text")} IF len(t) > 1 AND NOT list_contains({_STOPS}, t)]) AS q,
                 list_distinct([t FOR t IN {TOKENS.format("heading")} IF len(t) > 1 AND NOT list_contains({_STOPS}, t)]) AS h FROM s)
    SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, h)) / len(q)::DOUBLE END, 6) AS overlap FROM w"""
)
def heading_overlaps(spark, sf_dir):
    """5.16: the share of each turn's words in the turn before, read as its heading."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("heading", before)
    return rows.select("conv_id", "turn", F.round(text.heading_overlap("text", "heading"), 6).alias("overlap"))


@query(
    """SELECT p_partkey, p_name || chr(10) || p_brand AS parts, left(p_name || chr(10) || p_brand, 12) AS cut,
    'a' || p_size || '|b' AS ids, left(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_]+', '_', 'g'), 60) AS safe,
    array_to_string(list_sort([trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))]), '|') AS forms FROM part"""
)
def text_parts(spark, sf_dir):
    """5.21, 5.22, 5.23, 5.27: joined parts, id lists, safe ids and the forms of names with parentheses."""
    listed = F.concat(F.lit(" a"), F.col("p_size").cast("string"), F.lit("; b;;\na"), F.col("p_size").cast("string"))
    named = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.join_parts("p_name", F.lit("  "), F.lit(None).cast("string"), "p_brand").alias("parts"), text.join_parts("p_name", "p_brand", limit=12).alias("cut"),
        F.array_join(text.parse_ids(listed), "|").alias("ids"), text.safe_id(F.concat_ws("/", "p_name", "p_brand")).alias("safe"),
        F.array_join(F.array_sort(text.alias_forms(named)), "|").alias("forms"),
    )


@query(
    f"""SELECT p_partkey, sha256('{{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}}') AS row_hash, ('0x' || substr(sha256(p_name), 9, 8))::BIGINT AS seed,
    round(1.0 / (60 + p_size), 9) AS rrf, '{{"version":"v1","source_file":"part","locator":"' || p_partkey || '","derivation":"table"}}' AS provenance, array_to_string({TOKENS.format("p_name")}, ' ') AS question_key FROM part"""
)
def row_identifiers(spark, sf_dir):
    """6.1, 6.7, 6.10, 6.12, 6.13, 6.15: hashes, seeds, rank terms, provenance and question keys."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", ids.canonical_json_hash(F.struct("p_partkey", "p_name")).alias("row_hash"), ids.stable_seed("p_name").alias("seed"),
        F.round(ids.reciprocal_rank("p_size"), 9).alias("rrf"), F.to_json(ids.provenance("v1", F.lit("part"), F.col("p_partkey").cast("string"), "table")).alias("provenance"),
        text.normalize("p_name").alias("question_key"),
    )


@query(
    """SELECT c_custkey, c_custkey % 5 AS n, CASE WHEN c_custkey % 2 = 0 THEN 'Is it ' || c_mktsegment || '?' END AS revised,
    CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'a|b' ELSE '' END AS allowed FROM customer"""
)
def model_answers(spark, sf_dir):
    """6.9, 6.17, 17.8: fields, revised questions and allowed ids out of the answers of a model."""
    raw = F.concat(F.lit("Sure.\n```json\n{\"n\": "), (F.col("c_custkey") % 5).cast("string"), F.lit(", \"x\": [1]}\n``` done"))
    note = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Note: revised: Is it "), "c_mktsegment", F.lit("? yes"))).otherwise("no question")
    asked = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a"), F.lit("z"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("q")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.try_variant_get(ids.model_json(raw), "$.n", "long").alias("n"), text.revised_question(note).alias("revised"),
        F.array_join(ids.allowed_ids(asked, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), "|").alias("allowed"),
    )


@query("SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 5) AS norm, 1.0 AS unit FROM embeddings")
def unit_vectors(spark, sf_dir):
    """12.5: every embedding brought to length one."""
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(size("embedding"), 5).alias("norm"), F.round(size(vectors.l2_normalized(F.col("embedding"))), 5).alias("unit"))


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS spaces FROM documents")
def injected_embedder(spark, sf_dir):
    """12.4, 20.1: vectors of whole texts from an injected function of a list of texts."""

    def count(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts], np.float32)

    made = dense.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", count)
    return made.select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("spaces"))


# --- enrichment ----------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 != 0 AND trim(left(coalesce(text, ''), 30)) != '' THEN 'S ' || trim(left(text, 30)) END AS summary FROM documents"""
)
def document_summaries(spark, sf_dir):
    """4.2, 4.3, 4.23, 20.4: summaries of an injected model, some from a cache, some that find the source irrelevant."""
    head = F.trim(F.left(F.coalesce("text", F.lit("")), F.lit(30)))
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("parents_context"), F.lit("").alias("heading"), F.col("text").alias("content"), F.lit("").alias("search_text"), head.alias("head"), "doc_id"
    )
    prompt = F.when(F.col("doc_id") % 4 == 0, "skip").otherwise(F.col("head"))
    prompts = chunks.select(F.col("chunk_id").alias("key"), prompt.alias("prompt"))
    known = chunks.where("doc_id % 8 = 1 AND head != ''").select(F.col("chunk_id").alias("key"), F.concat(F.lit("S "), "head").alias("answer"))
    irrelevant = enrichment.IRRELEVANT
    answers = enrichment.complete(prompts, lambda ps: [irrelevant if p == "skip" else f"S {p}" if p else "" for p in ps], known)
    return enrichment.with_summaries(chunks.drop("head", "doc_id"), answers).select(F.col("chunk_id").cast("long").alias("doc_id"), "summary")


@query(
    """WITH q AS (SELECT doc_id, length(coalesce(text, '')) AS n, unnest(['How long is text ' || doc_id || '?', 'Who wrote text ' || doc_id || '?', 'Why was text ' || doc_id || ' written?']) AS question FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['How', 'Who', 'Why'], left(question, 3))) AS place FROM q)
    SELECT doc_id || '_' || left(md5(question), 8) AS pair_id, doc_id::VARCHAR AS chunk_id, question FROM r WHERE place <= CASE WHEN n >= 500 THEN 3 ELSE 1 END AND doc_id % 9 != 0"""
)
def question_answer_pairs(spark, sf_dir):
    """4.13: question pairs of long and short texts, those of finished ones left out."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"))
    lines = F.concat(F.lit("1. How long is text "), "chunk_id", F.lit("?\n\n2) Who wrote text "), "chunk_id", F.lit("?\n- no?\n* Why was text "), "chunk_id", F.lit(" written?"))
    answers = chunks.select(F.col("chunk_id").alias("key"), lines.alias("answer"))
    made = enrichment.question_pairs(chunks, answers)
    done = made.where(F.col("chunk_id").cast("long") % 9 == 0)
    return enrichment.question_pairs(chunks, answers, done).select("pair_id", "chunk_id", "question")


@query("SELECT n_regionkey, 'Table with ' || count(*) || ' rows and columns: Name, Key' AS summary FROM nation WHERE n_regionkey IS NOT NULL GROUP BY n_regionkey")
def html_table_summaries(spark, sf_dir):
    """4.8: a sentence on the HTML table of each region's nations."""
    cells = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    tables = table(spark, sf_dir, "nation").where("n_regionkey IS NOT NULL").groupBy("n_regionkey").agg(
        F.concat(F.lit('<table border="1"><tr><th> Name</th><th><b>Key</b></th></tr>'), F.array_join(F.collect_list(cells), "\n"), F.lit("</table>")).alias("html")
    )
    return tables.select("n_regionkey", enrichment.html_table_summary(F.col("html")).alias("summary"))


# --- sets, ranks and windows ---------------------------------------------------


@query(f"WITH {gq._EDGES} SELECT DISTINCT source, relation, target FROM edges")
def appended_edges(spark, sf_dir):
    """7.30, 7.32, 11.7: edges that are missing are appended, known ones are not."""
    edges = gq._edges(spark, sf_dir)
    known = edges.where("relation != 'SUPPLIED_BY' OR substring(target, 14) % 2 = 0")
    return graph.append_missing(known, edges).select("source", "relation", "target")


@query(f"WITH {gq._NODES} SELECT id, label, name FROM nodes WHERE label != 'API'")
def extended_nodes(spark, sf_dir):
    """11.5, 13.11, 13.19: two partial node tables as one; rows that both have count once."""
    nodes = gq._nodes(spark, sf_dir)
    return graph.extend(nodes.where("label IN ('Region', 'Country')"), nodes.where("label IN ('Country', 'Manufacturer')")).select("id", "label", "name")


@query("SELECT 'api:' || p_partkey AS id, 2::BIGINT AS versions FROM part WHERE p_partkey % 13 = 0 AND p_name != upper(p_name)")
def conflicting_nodes(spark, sf_dir):
    """11.4: ids that come with two contents."""
    parts = gq._nodes(spark, sf_dir).where("label = 'API'")
    other = parts.where("substring(id, 5) % 13 = 0").withColumn("name", F.upper("name"))
    return graph.node_conflicts(parts.unionByName(other))


@query(
    """WITH h AS (SELECT o_custkey AS query_id, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), item) AS rank FROM h GROUP BY query_id, item"""
)
def first_appearances(spark, sf_dir):
    """9.1, 11.1, 11.2: repeated hits of a ranking as one rank per item, in the order they first appear."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("item"), F.row_number().over(order).alias("rank"))
    return dense.dedupe_ranking(hits, "item").select("query_id", "item", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def shared_customers(spark, sf_dir):
    """11.6: keys that two sets share."""
    orders = table(spark, sf_dir, "orders")
    return integrity.overlap(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '5-LOW'"), "o_custkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS n, coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"""
)
def running_allocation(spark, sf_dir):
    """9.6: what the lines before have taken of each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    before = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("n"), F.coalesce(before, F.lit(0.0)).alias("before")
    )


@query(
    """WITH r AS (SELECT conv_id * 1000 + turn AS item, conv_id, turn FROM conversations), h AS (SELECT item, conv_id, turn, 1.0 / (turn + 1) AS score FROM r WHERE turn % 7 = 3)
    SELECT r.item, round(max(h.score) * 0.7, 9) AS score FROM r JOIN h ON r.conv_id = h.conv_id AND r.turn BETWEEN h.turn - 2 AND h.turn + 2
    WHERE r.item NOT IN (SELECT item FROM h) GROUP BY r.item"""
)
def neighbour_scores(spark, sf_dir):
    """9.4: turns within two places of a hit, at a factor of its score."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "conv_id", "turn")
    hits = rows.where("turn % 7 = 3").select("item", (1.0 / (F.col("turn") + 1)).alias("score"))
    near = graph.neighbours_in_order(hits, rows, "conv_id", "turn", "item")
    return near.select("item", F.round("score", 9).alias("score"))


@query(
    """WITH l AS (SELECT o_custkey AS query_id, o_orderpriority AS item, (o_orderkey % 2)::INT AS list, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS rank FROM orders),
    f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS score, min({'list': list, 'rank': rank}) AS first FROM l GROUP BY ALL)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f"""
)
def first_list_ties(spark, sf_dir):
    """9.3, 12.17: fusion with ties broken by the first list that holds an item."""
    order = Window.partitionBy("o_custkey", F.col("o_orderkey") % 2).orderBy("o_orderkey")
    lists = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("item"), (F.col("o_orderkey") % 2).cast("int").alias("list"), F.row_number().over(order).alias("rank"))
    return fusion.rrf(lists, ties="list").select("query_id", "item", F.col("rank").cast("long").alias("rank"))


# --- graphs -----------------------------------------------------------------


_ALIASES = """SELECT DISTINCT 'api:' || p_partkey AS id, unnest([
    trim(regexp_replace(lower(regexp_replace(n, '\\([^)]*\\)', '', 'g')), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))]) AS alias
    FROM (SELECT *, p_name || ' (' || p_brand || ')' AS n FROM part)"""


@query(f"SELECT alias, array_to_string(list_sort(list(id)), ' ') AS nodes, len(string_split(alias, ' '))::INT AS n_words FROM ({_ALIASES}) WHERE length(alias) >= 3 GROUP BY alias")
def alias_rows(spark, sf_dir):
    """7.28: names and their forms with the nodes they may mean."""
    nodes = table(spark, sf_dir, "part").select(gq._id("api:", "p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name"))
    return graph.alias_index(nodes).select("alias", F.array_join("node_ids", " ").alias("nodes"), "n_words")


_CITING = "SELECT p_partkey, 'See ICH Q' || (p_partkey % 9) || CASE WHEN p_partkey % 3 = 0 THEN '(R1)' ELSE '' END || ' and ich  Q' || (p_partkey % 4) || '.' AS t FROM part"


@query(
    rf"""WITH t AS ({_CITING}), c(code, doc) AS (VALUES ('ICHQ0(R1)', '0'), ('ICHQ1', '1'), ('ICHQ2(R1)', 'q2'), ('ICHQ2(R2)', 'q2'), ('ICHQ3(R1)', 'a'), ('ICHQ3(R2)', 'b')),
    known AS (SELECT code, doc FROM c UNION SELECT base, min(doc) FROM (SELECT regexp_replace(code, '\(R\d+\)|R\d+$', '', 'g') AS base, doc FROM c) GROUP BY base HAVING count(DISTINCT doc) = 1 AND base NOT IN (SELECT code FROM c)),
    f AS (SELECT DISTINCT p_partkey, upper(regexp_replace(x, '\s+', '', 'g')) AS code FROM (SELECT p_partkey, unnest(regexp_extract_all(t, '(?i)\bICH\s+Q\d+[A-Z]?(?:\(R\d+\))?')) AS x FROM t))
    SELECT DISTINCT p_partkey::VARCHAR AS source, CASE WHEN doc IS NOT NULL THEN 'regdoc:' || doc ELSE 'regref:' || trim(regexp_replace(regexp_replace(lower(code), '\([^)]*\)', '', 'g'), '[^a-z0-9]+', ' ', 'g')) END AS target
    FROM f LEFT JOIN known USING (code) WHERE doc IS NULL OR doc != p_partkey::VARCHAR"""
)
def citation_edges(spark, sf_dir):
    """13.6, 13.7: references to guidelines, by code, by base code where one document owns it, or to a named stand-in."""
    cited = F.concat(
        F.lit("See ICH Q"), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "(R1)").otherwise(""),
        F.lit(" and ich  Q"), (F.col("p_partkey") % 4).cast("string"), F.lit("."),
    )
    texts = table(spark, sf_dir, "part").select("p_partkey", cited.alias("t"))
    codes = [("ICHQ0(R1)", "0"), ("ICHQ1", "1"), ("ICHQ2(R1)", "q2"), ("ICHQ2(R2)", "q2"), ("ICHQ3(R1)", "a"), ("ICHQ3(R2)", "b")]
    return graph.citations(texts, spark.createDataFrame(codes, "code string, doc string"), "p_partkey", "t").select("source", "target").distinct()


_RULES = [("r1", 0, "COMPLEMENTS", "x", "the [a-z]+"), ("r2", 1, "INTERPRETS", "y", "zzzz"), ("r3", -1, "SUPERSEDES", "z", "a"), ("r4", 2, "COVERS_TOPIC", "w", "[a-z]{5,}")]


@query(
    f"""WITH r(rule_id, source_doc_id, relation, target_value, evidence_pattern) AS (VALUES {", ".join(f"('{a}', {b}, '{c}', '{d}', '{e}')" for a, b, c, d, e in _RULES)})
    SELECT rule_id, relation, target_value, nullif(regexp_extract(text, '(?is)' || evidence_pattern), '') AS evidence,
           CASE WHEN text IS NULL THEN 'rejected_source_missing' WHEN regexp_extract(text, '(?is)' || evidence_pattern) = '' THEN 'rejected_evidence_not_found' ELSE 'accepted' END AS status
    FROM r LEFT JOIN documents ON doc_id = source_doc_id"""
)
def rule_edges(spark, sf_dir):
    """13.9: relations that rules find in their documents, or why not."""
    rules = spark.createDataFrame(_RULES, "rule_id string, source_doc_id long, relation string, target_value string, evidence_pattern string")
    return graph.rule_relations(table(spark, sf_dir, "documents"), rules, "doc_id", "text").select("rule_id", "relation", "target_value", "evidence", "status")


@query(
    """SELECT p_partkey, round(greatest(0.0, least(1.0, (CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0.0 END + 0.3 + 0.1 + CASE WHEN p_size % 3 = 0 THEN 0.1 ELSE 0.0 END)
    * CASE WHEN 1 + p_size % 5 > 2 THEN 1 - 0.1 * (1 + p_size % 5 - 2) ELSE 1.0 END)), 9) AS risk FROM part"""
)
def risk_scores(spark, sf_dir):
    """14.10: the risk of paths by what they touch and how long they are."""
    labels = F.array(F.when(F.col("p_size") % 2 == 0, "ShortageEvent"), F.lit("Country"), F.when(F.col("p_size") % 3 == 0, "Manufacturer"))
    relations = F.array_repeat(F.lit("SUPPLIED_BY"), 1 + F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(graph.risk_score(labels, relations), 9).alias("risk"))


@query(
    """WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS path, arg_min(l_partkey, {'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS head FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, len(path) > 1 AS pair_found, len(path) > 2 AND path[1] = path[2] AND path[3] = path[2] AS twice_found FROM o"""
)
def path_success(spark, sf_dir):
    """14.16: whether a chain of nodes occurs as a run in a path."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_partkey"]).alias("path"))
    last_two = F.slice("path", F.greatest(F.lit(1), F.size("path") - 1), 2)
    first = F.get("path", F.lit(0))
    return orders.select(
        "l_orderkey", (metrics.contiguous(last_two, F.col("path")) & (F.size(last_two) == 2)).alias("pair_found"),
        (metrics.contiguous(F.array(first, first, first), F.slice("path", 1, 3))).alias("twice_found"),
    )


# --- reviews and locks --------------------------------------------------------


@query(
    f"""WITH u AS (SELECT *, array_to_string({TOKENS.format("text")}, ' ') AS k FROM conversations WHERE role = 'user')
    SELECT md5(k) AS question_md5, min(conv_id || ':' || turn) AS annotation_id, array_to_string(list_sort(list_distinct(flatten(list(['c' || conv_id % 5, 't' || turn % 3])))), ',') AS candidates,
           array_to_string(list_sort(list_distinct(list('f' || conv_id % 3))), ';') AS sources, max(CASE WHEN turn = 0 THEN 'seen' END) AS exclusion_reason FROM u GROUP BY k"""
)
def merged_questions(spark, sf_dir):
    """7.26, 11.8, 17.9, 17.15: rows of one normalised question as one."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = asked.select(
        text.normalize("text").alias("question_key"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("annotation_id"), F.col("text").alias("query"),
        F.array(F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("candidates"),
        F.concat(F.lit("f"), (F.col("conv_id") % 3).cast("string")).alias("source_file"), F.when(F.col("turn") == 0, "seen").alias("exclusion_reason"),
    )
    merged = sampling.merge_candidates(rows)
    return merged.select(F.md5("question_key").alias("question_md5"), "annotation_id", F.array_join("candidates", ",").alias("candidates"), "sources", "exclusion_reason")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 4 = 1 AND doc_id % 5 = 0 THEN 'invalid_gold' WHEN doc_id % 4 = 1 THEN 'reviewed' WHEN doc_id % 4 = 2 THEN 'missing_gold' ELSE 'excluded' END AS review_status,
    doc_id % 4 = 1 AND doc_id % 5 != 0 AS eligible FROM documents"""
)
def review_decisions(spark, sf_dir):
    """17.11: decisions of a reviewer applied to a pack; unknown gold ids make a row invalid."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("annotation_id"))
    gold = F.when(F.col("annotation_id") % 4 == 1, F.array(F.when(F.col("annotation_id") % 5 == 0, "nowhere").otherwise("known"))).otherwise(F.array().cast("array<string>"))
    decisions = docs.where("annotation_id % 4 != 0").select(
        "annotation_id", F.when(F.col("annotation_id") % 4 == 3, "reject").otherwise("accept").alias("decision"), gold.alias("gold"), F.lit("").alias("reason")
    )
    done = sampling.apply_decisions(docs, decisions, spark.createDataFrame([("known",)], "id string"))
    return done.select(F.col("annotation_id").alias("doc_id"), "review_status", "eligible")


@query(
    """SELECT doc_id, 0 AS passage_id, CASE WHEN quality IS NOT DISTINCT FROM toxic THEN quality WHEN doc_id % 3 = 0 THEN 7 END AS label,
    CASE WHEN quality IS NOT DISTINCT FROM toxic THEN 'consensus' WHEN doc_id % 3 = 0 THEN 'adjudicated' ELSE 'open' END AS origin FROM labels"""
)
def adjudicated_labels(spark, sf_dir):
    """7.24, 7.25, 17.12: two reviewers' labels as one, adjudicated where they differ."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.lit(0).alias("passage_id"), "quality", "toxic")
    label = lambda c: rows.select("query_id", "passage_id", F.col(c).alias("label"))
    third = rows.where("query_id % 3 = 0").select("query_id", "passage_id", F.lit(7).alias("label"))
    return sampling.finalize(label("quality"), label("toxic"), third).withColumnRenamed("query_id", "doc_id")


_PLAIN = " AND ".join(f"NOT contains(lower(source || ' ' || text), '{t}')" for t in sampling.BOILERPLATE)


@query(f"SELECT doc_id FROM documents WHERE length(text) BETWEEN 220 AND 2400 AND trim(source) != '' AND {_PLAIN}")
def useful_documents(spark, sf_dir):
    """17.3: texts of a useful length with a heading and no boilerplate."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("heading"), F.col("text").alias("content"))
    return sampling.useful_chunks(chunks).select("doc_id")


@query(
    """SELECT * FROM (SELECT unnest(['duplicate_ids', 'not_reviewed', 'without_gold', 'not_eligible']) AS problem,
      unnest([count(*) - count(DISTINCT c_nationkey), count_if(c_custkey % 2 = 0), count_if(c_custkey % 3 = 0), count_if(c_custkey % 5 = 0)])::BIGINT AS n FROM customer) WHERE n > 0"""
)
def pack_problems(spark, sf_dir):
    """18.1: what keeps a pack made of the customers from use."""
    pack = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("annotation_id"), F.when(F.col("c_custkey") % 2 == 0, "pending").otherwise("reviewed").alias("review_status"),
        F.when(F.col("c_custkey") % 3 == 0, F.array()).otherwise(F.array(F.lit("x"))).cast("array<string>").alias("gold_evidence_chunk_ids"), (F.col("c_custkey") % 5 != 0).alias("eligible_for_formal_evaluation"),
    )
    return integrity.pack_problems(pack)


@query(
    """SELECT p_partkey::VARCHAR AS path, sha256(p_name) AS locked, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE sha256(p_name || '!') END AS found FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0"""
)
def changed_inputs(spark, sf_dir):
    """18.2, 18.10: locked inputs that are missing or differ."""
    lock = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256"), "p_partkey", "p_name")
    now = lock.where("p_partkey % 17 != 0").withColumn("sha256", F.when(F.col("p_partkey") % 19 == 0, F.sha2(F.concat("p_name", F.lit("!")), 256)).otherwise(F.col("sha256")))
    return integrity.changed_inputs(lock, now)


@query("SELECT n_nationkey AS nation FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def recomputed_differences(spark, sf_dir):
    """18.4: stored sums that a new computation does not give again."""
    again = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    stored = again.withColumn("total", F.when(F.col("nation") % 4 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return integrity.recomputed_differences(stored, again, ["nation"], ["total"], 1e-6).select("nation")
