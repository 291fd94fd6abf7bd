"""Queries of saved service answers, foreign formats, model fallbacks and legacy retrieval variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import dense, enrichment, fusion, metrics, records
from quillgraph.plans import evidence_queries as eq
from quillgraph.plans import retrieval_queries as rq
from quillgraph.plans.registry import query, table
from quillgraph.scratch import staged
from quillgraph.sources import readers, services


def _bodies(df, key, field, record):
    """Saved answers: one body a key, with its records as a JSON list."""
    grouped = df.groupBy(key.alias("key")).agg(F.collect_list(record).alias(field))
    return grouped.select("key", F.to_json(F.struct(field)).cast("binary").alias("body"))


#: records of a saved page at most, as the service gives them
PAGE = 1000


def _pages(df, key, field, columns, record):
    """Saved answers in pages of ``PAGE`` records at most, each made of neighbouring rows; ``record`` of a row with ``columns``.

    Rows are gathered as they are and become records in their page, so the
    records' texts are never shuffled and a page never grows with the table.
    """
    rows = df.select(key.alias("key"), F.struct(*columns).alias("r")).withColumn("page", F.expr(f"monotonically_increasing_id() div {PAGE}"))
    grouped = rows.groupBy("key", "page").agg(F.collect_list("r").alias("r"))
    return grouped.select("key", F.to_json(F.struct(F.transform("r", record).alias(field))).cast("binary").alias("body"))


@query(
    """SELECT o_orderpriority AS key, 'D-' || o_orderkey AS recall_number, strftime(o_orderdate, '%Y%m%d') AS report_date, 'Firm ' || o_custkey AS recalling_firm, 500 AS reason_chars,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y%m%d') DESC, 'D-' || o_orderkey) AS place FROM orders QUALIFY place <= 10"""
)
def enforcement_reports(spark, sf_dir):
    """1.16: the ten newest recalls of each search, out of saved answers."""
    record = lambda r: F.struct(
        F.concat(F.lit("D-"), r["o_orderkey"].cast("string")).alias("recall_number"), F.lit("p").alias("product_description"), F.repeat(F.lit("reason "), F.lit(100)).alias("reason_for_recall"),
        F.date_format(r["o_orderdate"], "yyyyMMdd").alias("report_date"), F.concat(F.lit("Firm "), r["o_custkey"].cast("string")).alias("recalling_firm"),
    )
    pages = _pages(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), "results", ["o_orderkey", "o_orderdate", "o_custkey"], record)
    found = services.enforcement_reports(pages)
    return found.select("key", "recall_number", "report_date", "recalling_firm", F.length("reason_for_recall").alias("reason_chars"), F.col("place").cast("long").alias("place"))


@query(
    """SELECT c_nationkey AS key, c_custkey::VARCHAR AS safetyreportid, array_to_string(['r' || i FOR i IN range(0, least(5, c_custkey % 8))], ',') AS reactions FROM customer"""
)
def adverse_events(spark, sf_dir):
    """1.16: safety reports with their first five reactions."""
    reactions = F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: i < F.col("c_custkey") % 8), lambda i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("reactionmeddrapt")))
    record = F.struct(F.col("c_custkey").cast("string").alias("safetyreportid"), F.lit("1").alias("serious"), F.struct(reactions.alias("reaction")).alias("patient"))
    found = services.adverse_events(_bodies(table(spark, sf_dir, "customer"), F.col("c_nationkey"), "results", record))
    return found.select("key", "safetyreportid", F.array_join("reactions", ",").alias("reactions"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey WHEN p_partkey % 3 = 1 THEN 'a' || p_partkey END AS rxcui FROM part")
def drug_identifiers(spark, sf_dir):
    """1.17: ids of drugs by exact name, else by the nearest."""
    parts = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit(c), F.col("p_partkey").cast("string"))
    exact = F.when(F.col("p_partkey") % 3 == 0, F.struct(F.struct(F.array(name("x")).alias("rxnormId")).alias("idGroup"))).otherwise(F.struct(F.struct(F.lit(None).cast("array<string>").alias("rxnormId")).alias("idGroup")))
    near = F.struct(F.struct(F.array(F.struct(name("a").alias("rxcui")), F.struct(F.lit("other").alias("rxcui"))).alias("candidate")).alias("approximateGroup"))
    body = lambda s: F.to_json(s).cast("binary").alias("body")
    return services.drug_identifiers(
        parts.select(F.col("p_partkey").alias("key"), body(exact)), parts.where("p_partkey % 3 != 2").select(F.col("p_partkey").alias("key"), body(near))
    )


@query("SELECT r_regionkey AS key, 'BN' AS tty, n_nationkey::VARCHAR AS rxcui, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 'IN', '0', r_name FROM region")
def related_concepts(spark, sf_dir):
    """1.17: nested concept groups of the wanted kinds."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("rxcui"), F.col("n_name").alias("name"))).alias("n")
    )
    rows = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    group = lambda tty, props: F.struct(F.lit(tty).alias("tty"), props.alias("conceptProperties"))
    own = F.array(F.struct(F.lit("0").alias("rxcui"), F.col("r_name").alias("name")))
    body = F.to_json(F.struct(F.struct(F.array(group("BN", F.col("n")), group("IN", own), group("DF", own)).alias("conceptGroup")).alias("relatedGroup")))
    return services.related_concepts(rows.select(F.col("r_regionkey").alias("key"), body.cast("binary").alias("body")))


@query(
    """WITH h AS (SELECT p_brand AS key, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part)
    SELECT 'the ' || key AS key, arg_min('M' || p_partkey, {'m': CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END, 'p': place}) AS molecule FROM h WHERE place <= 5 GROUP BY key"""
)
def molecule_search(spark, sf_dir):
    """1.18: the molecule that a search means."""
    hit = F.struct(F.col("p_partkey").alias("order"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("molecule_chembl_id"), F.when(F.col("p_partkey") % 4 == 3, F.col("p_brand")).otherwise("zzz").alias("pref_name"))
    grouped = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("the "), "p_brand").alias("key")).agg(F.array_sort(F.collect_list(hit)).alias("molecules"))
    pages = grouped.select("key", F.to_json(F.struct("molecules")).cast("binary").alias("body"))
    return services.molecules(pages).select("key", "molecule")


@query(
    """WITH m AS (SELECT 'M' || l_partkey AS molecule, 'inhibitor' || CASE WHEN l_suppkey % 2 = 0 THEN ' of ' || s_name ELSE '' END AS x FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1),
    i AS (SELECT 'M' || l_partkey AS molecule, 'use ' || l_returnflag AS x FROM lineitem WHERE l_linenumber = 2)
    SELECT molecule, coalesce(a.n, 0) AS mechanisms, coalesce(b.x, '') AS indications FROM (SELECT molecule, count(DISTINCT x) AS n FROM m GROUP BY molecule) a
    FULL JOIN (SELECT molecule, array_to_string(list_sort(list(DISTINCT x)), ',') AS x FROM i GROUP BY molecule) b USING (molecule)"""
)
def molecule_facts(spark, sf_dir):
    """1.18, 1.19: mechanisms and indications by molecule out of bulk pages, targets joined."""
    items = table(spark, sf_dir, "lineitem")
    page = F.expr("l_orderkey div 1000")
    molecule = F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("molecule_chembl_id")
    does = _bodies(items.where("l_linenumber = 1"), page, "mechanisms", F.struct(molecule, F.lit("inhibitor").alias("mechanism_of_action"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("target_chembl_id")))
    used = _bodies(items.where("l_linenumber = 2"), page, "drug_indications", F.struct(molecule, F.concat(F.lit("use "), "l_returnflag").alias("mesh_heading")))
    targets = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("target"), F.col("s_name").alias("target_name"))
    facts = services.molecule_facts(does, used, targets)
    return facts.select("molecule", F.size("mechanisms").cast("long").alias("mechanisms"), F.array_join("indications", ",").alias("indications"))


@query(
    """SELECT 'maker_' || s_suppkey AS chunk_id, 'region_' || n_regionkey AS doc_id, r_name || ' > ' || n_name AS parents_context,
    lag('maker_' || s_suppkey) OVER w AS prev_chunk_id, lead('maker_' || s_suppkey) OVER w AS next_chunk_id
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WINDOW w AS (PARTITION BY n_regionkey ORDER BY s_suppkey)"""
)
def foreign_chunks(spark, sf_dir):
    """1.22, 1.26: chunks of another format: ids, breadcrumbs along the parents, links."""
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(ident("Region-", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), ident("R ", "r_regionkey").alias("doc"), F.lit(0).cast("long").alias("seq"), F.col("r_name").alias("title"), F.lit("").alias("body"))
    nations = table(spark, sf_dir, "nation").select(ident("Nation-", "n_nationkey").alias("id"), ident("Region-", "n_regionkey").alias("parent_id"), ident("N ", "n_nationkey").alias("doc"), F.lit(0).cast("long").alias("seq"), F.col("n_name").alias("title"), F.lit("").alias("body"))
    makers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        ident("Maker ", "s_suppkey").alias("id"), ident("Nation-", "n_nationkey").alias("parent_id"), ident("Region ", "n_regionkey").alias("doc"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("title"), F.lit("x").alias("body")
    )
    found = services.foreign_chunks(regions.unionByName(nations).unionByName(makers))
    return found.where("content = 'x'").select("chunk_id", "doc_id", "parents_context", "prev_chunk_id", "next_chunk_id")


@query("SELECT n_regionkey, n_nationkey::VARCHAR AS id, n_name AS decision, '' AS reason FROM nation WHERE n_regionkey IS NOT NULL")
def review_tables(spark, sf_dir):
    """1.23: decisions out of the pipe tables of a Markdown review."""
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" | |"))
    texts = table(spark, sf_dir, "nation").where("n_regionkey IS NOT NULL").groupBy("n_regionkey").agg(
        F.concat(F.lit("# Review\n\n| id | decision | reason |\n|----|:---|---|\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n\nend")).alias("t")
    )
    rows = texts.select("n_regionkey", F.explode(services.markdown_rows(F.col("t"), ["id", "decision", "reason"])).alias("r"))
    return rows.select("n_regionkey", "r.*")


@query("SELECT unnest(['nation.parquet', 'region.parquet', 'supplier.parquet']) AS name, true AS valid, 16 AS digits")
def file_registry(spark, sf_dir):
    """1.20, 1.28, 18.9: files with their short hash and whether they begin as they should."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{n}.parquet" for n in ("nation", "region", "supplier")])
    found = readers.magic_checked(files, b"PAR1")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "valid", F.length("hash").alias("digits"))


# --- models with fallbacks ----------------------------------------------------


@query("SELECT doc_id, md5(CASE WHEN length(coalesce(text, '')) < 50 OR doc_id % 3 = 0 THEN coalesce(text, '') ELSE 'clean ' || left(text, 20) END) AS cleaned_md5 FROM documents")
def cleaned_contents(spark, sf_dir):
    """4.22: texts cleaned by an injected model; short ones and those it gives nothing for stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    prompt = F.when(F.col("doc_id") % 3 != 0, F.left("content", F.lit(20))).otherwise("")
    asked = docs.where(F.length("content") >= 50).select(F.col("doc_id").cast("string").alias("key"), prompt.alias("prompt"))
    answers = enrichment.complete(asked, lambda ps: [f"clean {p}" if p else "" for p in ps])
    joined = docs.join(answers.select(F.col("key").cast("long").alias("doc_id"), "answer"), "doc_id", "left")
    return joined.select("doc_id", F.md5(F.coalesce("answer", "content")).alias("cleaned_md5"))


@query(
    """SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'The model says ' || n_regionkey ELSE 'Table with ' || count(*) || ' rows and columns: Name' END AS summary, count(*) - 1 AS rows_before FROM nation WHERE n_regionkey IS NOT NULL GROUP BY n_regionkey"""
)
def model_table_summaries(spark, sf_dir):
    """4.7, 4.9, 4.25: a model's sentence on a table, else the rule's; tables are known by their hash."""
    cells = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td></tr>"))
    tables = table(spark, sf_dir, "nation").where("n_regionkey IS NOT NULL").groupBy("n_regionkey").agg(
        F.concat(F.lit("<table><tr><th>Name</th></tr>"), F.array_join(F.collect_list(cells), ""), F.lit("</table>")).alias("html"), F.count(F.lit(1)).alias("n")
    )
    keyed = staged(tables.withColumn("key", F.left(F.sha2("html", 256), F.lit(16))), "tables")
    asked = keyed.where("n_regionkey % 2 = 0").select("key", F.col("n_regionkey").cast("string").alias("prompt"))
    said = enrichment.complete(asked, lambda ps: [f"The model says {p}" for p in ps])
    return keyed.join(said, "key", "left").select("n_regionkey", F.coalesce("answer", enrichment.html_table_summary(F.col("html"))).alias("summary"), (F.col("n") - 1).alias("rows_before"))


@query(
    """SELECT item_id, count(d.doc_id) AS chunks, md5(coalesce(string_agg(d.doc_id || ':' || left(coalesce(d.text, ''), 1600), '|' ORDER BY place), '')) AS prompt_md5
    FROM (SELECT item_id, unnest([item_id * 3 + i FOR i IN range(0, 8)]) AS c, unnest(range(0, 8)) AS place FROM benchmark) LEFT JOIN documents d ON d.doc_id = c AND c % 5 != 0 GROUP BY item_id"""
)
def review_prompts(spark, sf_dir):
    """4.26: the first eight candidates of an item that the store holds, as a prompt (1,600 characters each, as defined)."""
    listed = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.col("item_id") * 3 + i).alias("candidates"))
    first = listed.select("item_id", F.posexplode(F.slice("candidates", 1, 8)).alias("place", "doc_id"))
    store = table(spark, sf_dir, "documents").where("doc_id % 5 != 0").select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.left(F.coalesce("text", F.lit("")), F.lit(1600))).alias("part"))
    found = first.join(store, "doc_id", "left").groupBy("item_id").agg(
        F.count("part").alias("chunks"), F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("place", "part")))), lambda x: x["part"]).alias("parts")
    )
    return found.select("item_id", "chunks", F.md5(F.array_join("parts", "|")).alias("prompt_md5"))


@query(
    """SELECT doc_id, sha256(nfc_normalize(coalesce(nullif(trim(concat_ws(' | ', source, lang)), ''), 'untitled'))) AS title_sha256, sha256(nfc_normalize(coalesce(text, ''))) AS body_sha256 FROM documents"""
)
def article_pairs(spark, sf_dir):
    """4.27: a title from the parents and the composed text."""
    title = F.coalesce(F.nullif(F.trim(F.concat_ws(" | ", "source", "lang")), F.lit("")), F.lit("untitled"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(records.nfc(title), 256).alias("title_sha256"), F.sha2(records.nfc(F.coalesce("text", F.lit(""))), 256).alias("body_sha256")
    )


@query("SELECT source, doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2') QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) <= 7")
def pilot_corpus(spark, sf_dir):
    """4.28: seven chunks of each chosen document, the longest first."""
    order = Window.partitionBy("source").orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), "doc_id")
    rows = table(spark, sf_dir, "documents").where("source IN ('src0', 'src1', 'src2')").withColumn("n", F.row_number().over(order))
    return rows.where("n <= 7").select("source", "doc_id")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations QUALIFY role = 'assistant'"""
)
def preceding_headings(spark, sf_dir):
    """4.10: the last heading before each table, as an as-of look-up by position."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("heading", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "heading")


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, turn, turn // 3 AS up, length(text) AS n FROM conversations), d(conv_id, turn, top, n) AS (SELECT conv_id, turn, turn, n FROM s UNION ALL
      SELECT d.conv_id, d.turn, s.up, d.n FROM d JOIN s ON s.conv_id = d.conv_id AND s.turn = d.top WHERE d.top > 0)
    SELECT conv_id, top AS turn, sum(n)::BIGINT AS chars FROM d GROUP BY ALL"""
)
def bottom_up_summaries(spark, sf_dir):
    """4.15: what each section's generated summary covers, made level by level from its children's."""
    rows = staged(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.expr("turn div 3")).alias("up"), F.length("text").cast("long").alias("own")), "sections")
    # turn n hangs under n div 3, so its level is its number of digits to base three; the deepest first
    level = F.when(F.col("turn") == 0, 0).otherwise(F.length(F.conv(F.col("turn").cast("string"), 10, 3)))
    marked = rows.withColumn("level", level)
    deepest = marked.agg(F.max("level")).first()[0]
    made, out = None, marked.select("conv_id", "turn", F.col("own").alias("chars")).where("false")
    for n in range(deepest if deepest is not None else -1, -1, -1):
        here = marked.where(F.col("level") == n)
        if made is None:
            here = here.withColumn("below", F.lit(0).cast("long"))
        else:
            here = here.join(made.groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("chars").alias("below")), ["conv_id", "turn"], "left")
        made = staged(here.select("conv_id", "turn", "up", (F.col("own") + F.coalesce("below", F.lit(0))).alias("chars")), "summaries")
        out = out.unionByName(made.drop("up"))
    return out


# --- legacy retrieval -----------------------------------------------------------

_VARIANTS = {"A": ("bottom_up",), "B": ("bottom_up", "top_down"), "C": ("bottom_up", "top_down", "graph_path")}


@query(
    f"""WITH RECURSIVE {eq._ROUTES}, v(variant, route) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, rs in _VARIANTS.items() for r in rs)}),
    f AS (SELECT variant, query_id, item, sum(1.0 / (60 + rank)) AS score, min(rank) AS first FROM routes JOIN v USING (route) GROUP BY ALL)
    SELECT variant, query_id, item, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f QUALIFY rank <= 5"""
)
def stage_variants(spark, sf_dir):
    """12.29, 12.30: the stages of retrieval switched on one after the other, each variant fused and cut to five."""
    pairs = spark.createDataFrame([(v, r) for v, rs in _VARIANTS.items() for r in rs], "variant string, route string")
    spread = eq._three_routes(spark, sf_dir).join(F.broadcast(pairs), "route")  # six rows of parameters
    fused = fusion.rrf(spread.select(F.struct("variant", "query_id").alias("query_id"), "item", "rank"), limit=5)
    return fused.select("query_id.variant", "query_id.query_id", "item", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id // 2 AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
      FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), item) AS rank FROM s GROUP BY query_id, item"""
)
def question_nodes(spark, sf_dir):
    """13.20, 14.15: the nearest question vectors, then the chunk that each belongs to; two questions a chunk."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = dense.dense_top_k_blocked(vectors, queries, 20).select("query_id", F.expr("vec_id div 2").alias("item"), "rank")
    return dense.dedupe_ranking(hits, "item").select("query_id", "item", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {rq._FULL}, {rq._GOLD}, {rq._METRICS} SELECT query_id, hit5, round(mrr, 6) AS mrr FROM m")
def injected_retrieval(spark, sf_dir):
    """15.8, 20.3: metrics of an injected retrieval function."""
    items = table(spark, sf_dir, "benchmark")
    found = metrics.evaluate_method(items, lambda queries, k: rq._bm25(spark, sf_dir, k), rq._gold(spark, sf_dir), "bm25")
    return found.select("query_id", "hit5", F.round("mrr", 6).alias("mrr"))


@query(
    """WITH l AS (SELECT doc_id, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents) WHERE trim(line) != ''),
    m AS (SELECT *, regexp_matches(CASE WHEN i % 7 < 4 THEN line || ' ... ' || i ELSE line END, '[.]{3} [0-9]+$') AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
    g AS (SELECT doc_id, i, n - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m WHERE hit)
    SELECT doc_id, min(i) AS first_line, count(*) AS lines FROM g GROUP BY doc_id, run HAVING count(*) >= 3"""
)
def contents_runs(spark, sf_dir):
    """3.7: runs of three lines and more that look like contents, blank ones passed over, as gaps and islands.

    The documents have no tables of contents, so four of every seven lines get a page number first.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("line", F.trim("line")).where("line != ''")
    order = Window.partitionBy("doc_id").orderBy("i")
    numbered = F.when(F.col("i") % 7 < 4, F.concat_ws(" ... ", "line", F.col("i").cast("string"))).otherwise(F.col("line"))
    marked = lines.withColumn("n", F.row_number().over(order)).where(numbered.rlike(r"[.]{3} [0-9]+$"))
    runs = marked.withColumn("run", F.col("n") - F.row_number().over(order)).groupBy("doc_id", "run").agg(F.min("i").cast("long").alias("first_line"), F.count(F.lit(1)).alias("lines"))
    return runs.where("lines >= 3").select("doc_id", "first_line", "lines")
