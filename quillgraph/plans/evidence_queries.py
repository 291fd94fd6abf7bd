"""Queries of evidence routes, alignment, record graphs and annotation steps, over whole tables.

Chunks are documents, a chunk's document is its ``source``; where a tree is
needed, document n hangs under document n div 8.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import dense, enrichment, evidence, fusion, graph, graph_sources, lexical, records
from quillgraph.plans import graph_queries as gq
from quillgraph.plans import retrieval_queries as rq
from quillgraph.plans.contract_queries import _shortage_pages
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import _STOPS, TOKENS
from quillgraph.scratch import staged
from quillgraph.sources import readers

_T = TOKENS.format("text")


def _ranked(df, *columns):
    return df.select("query_id", "item", *columns, F.col("rank").cast("long").alias("rank"))


# --- routes --------------------------------------------------------------------

_ROUTES = f"""{rq._FULL}, vhits AS (
        SELECT q.vec_id AS query_id, v.vec_id AS item, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
        FROM embeddings v, embeddings q JOIN benchmark ON item_id = q.vec_id),
    r1 AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM vhits QUALIFY rank <= 240),
    r2 AS (SELECT query_id, item, score, source AS doc, rank FROM r1 JOIN documents ON doc_id = item),
    b AS (SELECT query_id, item, rank FROM full_text WHERE rank <= 5),
    votes AS (SELECT query_id, doc FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / rank), 9) DESC, min(rank), doc) AS p FROM r2 GROUP BY query_id, doc) WHERE p <= 2),
    seeds AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, item) AS seed FROM r2 JOIN votes USING (query_id, doc) QUALIFY seed <= 5),
    up(item, ancestor, distance) AS (SELECT doc_id, doc_id, 0 FROM documents UNION ALL SELECT item, ancestor // 8, distance + 1 FROM up WHERE ancestor > 0),
    kids AS (SELECT s.query_id, d.doc_id AS item, {{'kind': 1, 'seed': s.seed, 'distance': u.distance}} AS first, s.score * 0.55 AS score
             FROM seeds s JOIN up u USING (item) JOIN documents d ON d.doc_id > 0 AND d.doc_id // 8 = u.ancestor),
    both_kinds AS (SELECT query_id, item, min({{'first': first, 'score': score}}) AS b FROM (
             SELECT query_id, item, {{'kind': 0, 'seed': seed, 'distance': 0}} AS first, score FROM seeds UNION ALL SELECT * FROM kids) GROUP BY ALL),
    t AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 9) DESC, b.first, item) AS rank FROM both_kinds QUALIFY rank <= 5),
    same_label AS (SELECT q.vec_id AS query_id, v.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS n
             FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings v ON v.label = q.label AND v.vec_id != q.vec_id QUALIFY n <= 24),
    reached AS (SELECT query_id, item, source AS doc FROM same_label JOIN documents ON doc_id = item),
    filled AS (SELECT query_id, item, max(score) AS score FROM (
             SELECT query_id, item, score FROM r2 JOIN (SELECT DISTINCT query_id, doc FROM reached) USING (query_id, doc) UNION ALL SELECT query_id, item, 0.0 FROM reached) GROUP BY ALL),
    g AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM filled QUALIFY rank <= 5),
    routes AS (SELECT *, 'bottom_up' AS route FROM b UNION ALL SELECT *, 'top_down' FROM t UNION ALL SELECT *, 'graph_path' FROM g)"""


def _tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id > 0").select("doc_id")
    return graph.edges_of(docs, F.expr("doc_id div 8"), "PARENT_OF", F.col("doc_id"))


def _three_routes(spark, sf_dir):
    """The three routes of every benchmark item, five rows each: lexical, top-down by vectors and along the graph."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("doc"))
    vectors = table(spark, sf_dir, "embeddings")
    hits = staged(rq._dense(spark, sf_dir, 240).join(docs, "item"), "route-hits")
    lexical_hits = rq._bm25(spark, sf_dir)
    up = evidence.bottom_up(lexical_hits, docs)
    down = evidence.top_down(hits, hits, _tree(spark, sf_dir))
    # a query's anchor is its vector's label; its neighbours are the vectors of that label, 24 at most
    labels = vectors.select(F.col("vec_id").alias("item"), "label")
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(labels.withColumnRenamed("item", "query_id"), "query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("item"))
    near = anchors.join(labels, "label").where("item != query_id").withColumn("n", nth).where("n <= 24").select("query_id", "item")
    along = evidence.reachable_backfill(near.join(docs, "item"), hits)
    route = lambda df, name: df.select("query_id", "item", "rank", F.lit(name).alias("route"))
    return staged(route(up, "bottom_up").unionByName(route(down, "top_down")).unionByName(route(along, "graph_path")), "three-routes")


@query(f"WITH RECURSIVE {_ROUTES} SELECT route, query_id, item, rank FROM routes")
def three_paths(spark, sf_dir):
    """12.13, 12.14, 14.4: what each of the three routes finds for every item."""
    return _ranked(_three_routes(spark, sf_dir), "route")


@query(
    f"""WITH RECURSIVE {_ROUTES}, f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS score, min(rank) AS first, array_to_string(list_sort(list(route)), '+') AS routes FROM routes GROUP BY ALL)
    SELECT query_id, item, round(score, 9) AS score, routes, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f QUALIFY rank <= 5"""
)
def three_path_evidence(spark, sf_dir):
    """12.16, 3.1: question to evidence: three routes, fused, the first five chunks with the routes they came from."""
    routes = _three_routes(spark, sf_dir)
    fused = fusion.rrf(routes, limit=5)
    came = routes.groupBy("query_id", "item").agg(F.array_join(F.array_sort(F.collect_set("route")), "+").alias("routes"))
    return _ranked(fused.join(came, ["query_id", "item"]), F.round("score", 9).alias("score"), "routes")


@query(
    f"""WITH {rq._DENSE}, k AS (SELECT h.*, source FROM vector_hits h JOIN documents ON doc_id = item WHERE rank <= 15 AND score >= 0.3)
    SELECT query_id, source, arg_max(item, {{'s': score, 'r': -rank}}) AS item, round(max(score), 6) AS score FROM k GROUP BY query_id, source"""
)
def threshold_search(spark, sf_dir):
    """12.11, 20.3: the first fifteen vectors above a threshold, the best of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    found = evidence.threshold_hits(rq._dense(spark, sf_dir).join(docs, "item"), 0.3, 15, "source")
    return found.select("query_id", "source", "item", F.round("score", 6).alias("score"))


@query(
    f"""WITH {rq._DENSE}, k AS (SELECT query_id, source, min(rank) AS first FROM vector_hits JOIN documents ON doc_id = item WHERE rank <= 40 GROUP BY ALL)
    SELECT query_id, source AS item, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank FROM k QUALIFY rank <= 10"""
)
def overfetched_search(spark, sf_dir):
    """12.12: four times as many hits as wanted, then one per document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    hits = rq._dense(spark, sf_dir, 40).join(docs, "item").select("query_id", F.col("source").alias("item"), "rank")
    return _ranked(dense.dedupe_ranking(hits, "item", 10))


@query(
    """WITH k AS (SELECT doc_id, coalesce(text, '') AS t, source, unnest(CASE WHEN doc_id % 3 = 0 THEN ['raw', 'question', 'table'] ELSE ['raw', 'question'] END) AS kind FROM documents),
    v AS (SELECT *, unnest(['R1', 'R2', 'R3', 'R4']) AS variant FROM k)
    SELECT variant, kind, count(*) AS n, sum(length(t) + CASE WHEN kind = 'raw' AND variant != 'R1' THEN 1 + length(coalesce(source, '')) ELSE 0 END)::BIGINT AS chars
    FROM v WHERE kind = 'raw' OR kind = 'question' AND variant IN ('R3', 'R4') OR kind = 'table' AND variant = 'R4' GROUP BY ALL"""
)
def index_variants(spark, sf_dir):
    """12.7, 12.8, 12.9: the rows of four cumulative indexes: raw texts, with summaries, with questions, with tables."""
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("t"), F.coalesce("source", F.lit("")).alias("summary"))
    rows = lambda df, kind, content: df.select("doc_id", F.lit(kind).alias("kind"), content.alias("content"))
    raw, summed = rows(docs, "raw", F.col("t")), rows(docs, "raw", F.concat_ws("\n", "summary", "t"))
    asked, tables = rows(docs, "question", F.col("t")), rows(docs.where("doc_id % 3 = 0"), "table", F.col("t"))
    made = None
    for variant, parts in {"R1": [raw], "R2": [summed], "R3": [summed, asked], "R4": [summed, asked, tables]}.items():
        for part in parts:
            tagged = part.withColumn("variant", F.lit(variant))
            made = tagged if made is None else made.unionByName(tagged)
    return made.groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {rq._bm25_sql('full_text', 'text', 50)} SELECT query_id, item, rank, sha256(nfc_normalize(coalesce(text, ''))) AS passage_sha256 FROM full_text JOIN documents ON doc_id = item")
def frozen_candidates(spark, sf_dir):
    """12.26: the first fifty BM25 candidates of every item with their composed passages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.coalesce("text", F.lit("")).alias("passage"))
    found = rq._bm25(spark, sf_dir, 50).join(docs, "item")
    return _ranked(found, F.sha2(records.nfc("passage"), 256).alias("passage_sha256"))


@query(
    f"""WITH {rq._bm25_sql('full_text', 'text', 50)}, p AS (SELECT f.query_id, item, rank AS bm25_rank, 1 / (1 + exp((length(b.text) % 7) / 2.0 - (length(coalesce(d.text, '')) % 11) / 3.0)) AS score
      FROM full_text f JOIN documents d ON d.doc_id = item JOIN benchmark b ON b.item_id = f.query_id)
    SELECT query_id, item, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, bm25_rank, item) AS rank FROM p"""
)
def model_rerank(spark, sf_dir):
    """12.27: candidates ranked by an injected model's probability of yes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.coalesce("text", F.lit("")).alias("passage"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = rq._bm25(spark, sf_dir, 50).join(docs, "item").join(items, "query_id").withColumnRenamed("rank", "bm25_rank")
    ranked = evidence.rescored(found, lambda qs, ps: [((len(p) % 11) / 3.0, (len(q) % 7) / 2.0) for q, p in zip(qs, ps, strict=True)])
    return _ranked(ranked, F.round("score", 6).alias("score"))


_WORDS = f"SELECT item_id AS query_id, unnest([x FOR x IN {_T} IF len(x) >= 3 AND NOT list_contains({_STOPS}, x)][:6]) AS term FROM benchmark"


@query(
    f"""WITH k AS (SELECT DISTINCT * FROM ({_WORDS})), t AS (SELECT DISTINCT doc_id, unnest({_T}) AS term FROM documents),
    h AS (SELECT query_id, doc_id AS item, count(*) AS hits FROM k JOIN t USING (term) GROUP BY ALL HAVING count(*) >= 2)
    SELECT query_id, item, round(0.35 + 0.05 * least(hits, 5), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY least(hits, 5) DESC, item) AS rank FROM h QUALIFY rank <= 8"""
)
def keyword_top8(spark, sf_dir):
    """10.3: the first eight documents that hold two or more of an item's keywords."""
    keywords = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.first_keywords("text")).alias("term"))
    terms = lexical.build_index(table(spark, sf_dir, "documents")).terms
    found = evidence.keyword_recall(keywords, terms.select("doc", "term"))
    return found.select("query_id", F.col("doc").alias("item"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity FROM lineitem), n AS (SELECT s_suppkey AS query_id, unnest([s_suppkey, s_suppkey + 100, s_suppkey + 200]) AS entity FROM supplier)
    SELECT query_id, chunk, count(*) AS entities, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk) AS rank FROM m JOIN n USING (entity) GROUP BY query_id, chunk QUALIFY rank <= 5"""
)
def entity_text_search(spark, sf_dir):
    """10.4: orders by how many of three named parts they mention."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") + 100, F.col("s_suppkey") + 200)).alias("entity"))
    found = evidence.entity_recall(names, _mentions(spark, sf_dir))
    return found.select("query_id", "chunk", "entities", F.col("rank").cast("long").alias("rank"))


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")).distinct()


@query(
    f"""WITH {rq._bm25_sql('full_text', 'text', 15)}, h AS (SELECT query_id, item, source AS doc, lang AS section FROM full_text JOIN documents ON doc_id = item),
    m AS (SELECT query_id, doc, count(*) AS n FROM h GROUP BY query_id, doc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc) = 1 AND count(*) >= 3),
    s AS (SELECT query_id, doc, n, section FROM h JOIN m USING (query_id, doc) GROUP BY query_id, doc, n, section QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, section) = 1)
    SELECT s.query_id, d.doc_id AS item, s.n FROM s JOIN documents d ON d.source = s.doc AND d.lang = s.section WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = s.query_id AND h.item = d.doc_id)
    QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY d.doc_id) <= 10"""
)
def chapter_reading(spark, sf_dir):
    """8.8, 14.13: where an item's hits concentrate, the other chunks of that section."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("doc"), F.col("lang").alias("section"))
    hits = staged(rq._bm25(spark, sf_dir, 15).join(docs, "item"), "chapter-hits")
    found = evidence.concentration(hits, "doc", "section")
    return evidence.chapter_read(found, docs, hits, "doc", "section").join(found.select("query_id", "n"), "query_id").select("query_id", "item", "n")


@query(
    f"""WITH {rq._FULL}, {rq._GOLD}, c(c) AS (VALUES (10), (60), (100)), {rq._DENSE.strip()},
    lists AS (SELECT query_id, item, rank FROM full_text UNION ALL SELECT query_id, item, rank FROM vector_hits),
    s AS (SELECT c, query_id, item, sum(1.0 / (c + rank)) AS score, min(rank) AS first FROM lists, c GROUP BY c, query_id, item),
    f AS (SELECT c, query_id, item, row_number() OVER (PARTITION BY c, query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM s),
    m AS (SELECT c, query_id, coalesce(max(CASE WHEN g.item IS NOT NULL THEN 1.0 / rank END), 0) AS mrr, coalesce(max(CASE WHEN g.item IS NOT NULL AND rank <= 5 THEN 1.0 END), 0) AS hit5
          FROM f LEFT JOIN gold g USING (query_id, item) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL)
    SELECT c AS constant, round(avg(hit5), 6) AS hit5, round(avg(mrr), 6) AS mrr FROM m GROUP BY c ORDER BY round(avg(hit5), 9) DESC, round(avg(mrr), 9) DESC, c LIMIT 1"""
)
def grid_selection(spark, sf_dir):
    """10.2, 12.31: the fusion constant that does best: hit rate, then MRR, then the smaller constant."""
    lists = rq._two_lists(spark, sf_dir).select("query_id", "item", "rank")
    grid = spark.createDataFrame([(10,), (60,), (100,)], "constant int")
    spread = lists.crossJoin(F.broadcast(grid))  # three rows of parameters
    fused = spread.groupBy("constant", "query_id", "item").agg(F.sum(1.0 / (F.col("constant") + F.col("rank"))).alias("score"), F.min("rank").alias("first"))
    order = Window.partitionBy("constant", "query_id").orderBy(F.round("score", 9).desc(), "first", "item")
    gold = staged(rq._gold(spark, sf_dir), "grid-gold").withColumn("is_gold", F.lit(True))
    judged = fused.withColumn("rank", F.row_number().over(order)).join(gold.select("query_id").distinct(), "query_id", "left_semi").join(gold, ["query_id", "item"], "left")
    per = judged.groupBy("constant", "query_id").agg(
        F.coalesce(F.max(F.when(F.col("is_gold"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.max(F.when(F.col("is_gold") & (F.col("rank") <= 5), 1.0)), F.lit(0.0)).alias("hit5"),
    )
    means = per.groupBy("constant").agg(F.avg("hit5").alias("h"), F.avg("mrr").alias("m"))
    key = F.struct((-F.round("h", 9)).alias("h"), (-F.round("m", 9)).alias("m"), "constant")
    best = means.agg(F.min_by(F.struct("constant", "h", "m"), key).alias("b"))
    return best.where("b IS NOT NULL").select("b.constant", F.round("b.h", 6).alias("hit5"), F.round("b.m", 6).alias("mrr"))


# --- alignment and joins -----------------------------------------------------------


@query(
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier (X) #' || lpad((c_custkey % 200)::VARCHAR, 9, '0') ELSE c_name END AS name FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 200 IN (SELECT s_suppkey FROM supplier) THEN 'manufacturer:' || (c_custkey % 200) ELSE 'entity:' || left(sha256(name), 20) END AS entity FROM r"""
)
def resolved_entities(spark, sf_dir):
    """7.10: names resolved to known makers, others to hashed entities."""
    made = F.concat(F.lit("Supplier (X) #"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, made).otherwise(F.col("c_name")).alias("name"))
    known = table(spark, sf_dir, "supplier").select(gq._id("manufacturer:", "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.resolved_entities(rows, known, "name", "entity").select("c_custkey", "entity")


@query(
    """WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part)
    SELECT name, arg_min('api:' || p_partkey, p_partkey) AS id FROM n JOIN part ON contains(lower(p_name), lower(name)) GROUP BY name"""
)
def fuzzy_names(spark, sf_dir):
    """7.6, 7.11: the first part whose name holds a given name."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.element_at(F.split("p_name", " "), 2).alias("name")).distinct()
    return records.first_name_match(names, parts.select(gq._id("api:", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))


@query(
    """SELECT s_suppkey AS maker, regulation FROM supplier JOIN nation ON s_nationkey = n_nationkey,
      (VALUES (NULL, 'ICH Q7'), ('NATION_1', 'EU GMP'), ('NATION_2', 'CFR 211'), ('NATION_2', 'CFR 210')) r(country, regulation) WHERE country IS NULL OR country = n_name"""
)
def regulation_rules(spark, sf_dir):
    """7.12, 7.13: makers joined to their country by name and to the regulations of their country and of all."""
    countries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    makers = table(spark, sf_dir, "supplier").join(F.broadcast(countries), "s_nationkey").select(F.col("s_suppkey").cast("string").alias("id"), "country")
    rules = spark.createDataFrame([(None, "ICH Q7"), ("NATION_1", "EU GMP"), ("NATION_2", "CFR 211"), ("NATION_2", "CFR 210")], "country string, regulation string")
    edges = graph_sources.regulation_edges(makers, rules)
    return edges.select(F.col("source").cast("long").alias("maker"), F.col("target").alias("regulation"))


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, count(e.event_id) AS before_it FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts AND e.event_id != p.event_id GROUP BY p.event_id"""
)
def events_in_range(spark, sf_dir):
    """7.17: how many events of a user lie in the two hours up to each purchase: a window over time in place of a join."""
    span = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-2 * 3600 * 1_000_000, 0)
    counted = table(spark, sf_dir, "events").withColumn("n", F.count(F.lit(1)).over(span))
    return counted.where("event_type = 'purchase'").select("event_id", (F.col("n") - 1).alias("before_it"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, role, list_distinct([x FOR x IN {_T} IF len(x) > 2]) AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn AS old, b.turn AS new, CASE WHEN len(a.w) + len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END AS score
          FROM s a JOIN s b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant')
    SELECT conv_id, old, new, round(score, 6) AS score, row_number() OVER (PARTITION BY conv_id, old ORDER BY round(score, 9) DESC, new) AS place FROM p QUALIFY place <= 3"""
)
def label_alignment(spark, sf_dir):
    """7.21: the three answers of a conversation that share most words with each question."""
    turns = table(spark, sf_dir, "conversations")
    old = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("old"), F.col("text").alias("old_text"))
    new = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("new"), F.col("text").alias("new_text"))
    score = text.jaccard(text.significant_words("old_text"), text.significant_words("new_text"))
    found = records.aligned_candidates(old, new, "conv_id", score)
    return found.select("conv_id", "old", "new", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS item, q.label AS a, v.label AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
      FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 240)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM s WHERE a = b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 12"""
)
def semantic_alignment(spark, sf_dir):
    """7.22: of the 240 nearest vectors those with the same label, the first twelve."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    labels = vectors.select("vec_id", "label")
    hits = dense.dense_top_k_blocked(vectors, queries, 240).join(labels, "vec_id")
    same = hits.join(labels.select(F.col("vec_id").alias("query_id"), "label"), ["query_id", "label"])
    return _ranked(dense.dedupe_ranking(same.withColumnRenamed("vec_id", "item"), "item", 12))


@query(
    f"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN w = 0 THEN 0.0 ELSE s END AS score FROM (
      SELECT p_partkey, p_size, 1 AS w, round(3.0 * CASE WHEN contains(' ' || lower(p_name) || ' ', ' ring ') THEN 1 ELSE 0 END + 0.35 * len(list_distinct([x FOR x IN {TOKENS.format("p_name")} IF len(x) > 2])) + 0.1, 4) AS s FROM part) WHERE p_size % 4 != 0
    UNION ALL SELECT p_partkey, round(3.0 * CASE WHEN contains(' ' || lower(p_name) || ' ', ' ring ') THEN 1 ELSE 0 END + 0.35 * len(list_distinct([x FOR x IN {TOKENS.format("p_name")} IF len(x) > 2])), 4) FROM part WHERE p_size % 4 = 0"""
)
def table_scores(spark, sf_dir):
    """5.19: the lexical score of a table's title against a question of the same words."""
    question = F.concat(F.lit("Of: "), "p_name")
    summary = F.when(F.col("p_size") % 4 != 0, "a summary")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", records.table_score(question, F.col("p_name"), F.array(F.lit("ring"), F.lit("nothing")), summary).alias("score"))


@query(
    """SELECT r_name || CASE WHEN r_regionkey % 2 = 0 THEN ' zone' ELSE '' END AS name, 'store ' || r_regionkey AS seen, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) ELSE lower(r_name) END AS doc_id FROM region
    UNION ALL SELECT 'Some Other Name', 'x', 'some_other_name'"""
)
def store_names(spark, sf_dir):
    """5.24: names brought to the ids of a store: equal, partial, or snake case."""
    regions = table(spark, sf_dir, "region")
    made = F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" zone"))).otherwise(F.col("r_name"))
    names = regions.select(made.alias("name"), F.concat(F.lit("store "), F.col("r_regionkey").cast("string")).alias("seen"))
    names = names.unionByName(spark.createDataFrame([("Some Other Name", "x")], "name string, seen string"))
    found = records.store_names(names, regions.select(F.lower("r_name").alias("doc_id")))
    return names.join(found, "name")


@query(
    """SELECT source AS doc_id, CASE WHEN source LIKE '%1' AND min(doc_id) FILTER (WHERE doc_id % 5 = 0) IS NOT NULL THEN 'Title of ' || min(doc_id) FILTER (WHERE doc_id % 5 = 0) WHEN source LIKE '%2' THEN 'a long heading ' || min(doc_id) ELSE replace(source, '_', ' ') END AS title FROM documents WHERE source IS NOT NULL GROUP BY source"""
)
def display_titles(spark, sf_dir):
    """5.25: the title a document shows."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    chunks = docs.select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("seq"),
        F.when(F.col("source").endswith("1") & (F.col("doc_id") % 5 == 0), F.concat(F.lit("Title of "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("source").endswith("2"), F.concat(F.lit("a long heading "), F.col("doc_id").cast("string"))).otherwise("short").alias("heading"),
    )
    return records.display_titles(chunks)


@query(
    """SELECT 'manufacturer:' || s_suppkey AS id, s_name || ' is a manufacturer' || CASE WHEN n_name IS NULL THEN '' ELSE ', located in ' || n_name END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', rated good' END || '.' AS description
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0
    UNION ALL SELECT 'api:' || p_partkey, p_name || ' is an active ingredient, of kind ' || p_type || '.' FROM part"""
)
def entity_descriptions(spark, sf_dir):
    """5.26, 12.8: sentences on makers and parts, unknown clauses left out."""
    countries = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    makers = table(spark, sf_dir, "supplier").join(countries, "s_nationkey", "left").select(
        gq._id("manufacturer:", "s_suppkey").alias("id"), F.lit("Manufacturer").alias("label"), F.col("s_name").alias("name"), "country", F.when(F.col("s_suppkey") % 3 != 0, "good").alias("detail")
    )
    parts = table(spark, sf_dir, "part").select(
        gq._id("api:", "p_partkey").alias("id"), F.lit("API").alias("label"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("country"), F.col("p_type").alias("detail")
    )
    both = makers.unionByName(parts)
    return both.select("id", records.entity_text(F.col("label"), F.col("name"), F.col("country"), F.col("detail")).alias("description"))


@query(
    """SELECT doc_id, md5('### [' || source || '] ' || CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' ELSE '' END || 'heading' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'the summary' ELSE left(text, 800) END) AS block_md5
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"""
)
def context_blocks(spark, sf_dir):
    """5.28: chunks as blocks of an answer's context."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    block = records.context_block(
        F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "), F.lit("heading"), F.when(F.col("doc_id") % 3 == 0, "the summary"), F.col("text")
    )
    return docs.select("doc_id", F.md5(block).alias("block_md5"))


@query("SELECT event_id, array_to_string(list_sort([k FOR k IN json_keys(props) IF k IN ('ref', 'k')]), '|') AS paths FROM events WHERE json_valid(props)")
def forbidden_keys(spark, sf_dir):
    """6.8: forbidden keys in the properties of events."""
    found = records.forbidden_paths(["ref", "k"])
    rows = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    return rows.select("event_id", F.array_join(found("props"), "|").alias("paths"))


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(['is it ' || p_name, 'why ' || p_name])), '|') AS questions FROM part"""
)
def harvested_questions(spark, sf_dir):
    """6.16: questions at any depth of JSON texts."""
    raw = F.to_json(
        F.struct(
            F.concat(F.lit("Is it "), "p_name", F.lit("?")).alias("query"), F.lit("no").alias("answer"),
            F.array(F.struct(F.concat(F.lit("WHY "), "p_name").alias("question"), F.struct(F.concat(F.lit("is it: "), "p_name").alias("original_query")).alias("inner"))).alias("list"),
        )
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.harvested_questions(raw), "|").alias("questions"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS posted FROM orders")
def date_texts(spark, sf_dir):
    """6.11: dates kept as text, those that are none as null."""
    said = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(F.try_to_timestamp(said, F.lit("yyyyMMdd"))).cast("string").alias("posted"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(100 * (avg(value) - (SELECT avg(value) FROM events WHERE event_type = 'view')), 4) AS delta FROM events GROUP BY event_type"""
)
def mean_and_std(spark, sf_dir):
    """8.10, 8.16: means, population deviations and the distance to a baseline, in hundredths."""
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    base = per.where("event_type = 'view'").agg(F.max("m").alias("base"))  # one row
    return per.crossJoin(F.broadcast(base)).select("event_type", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round(100 * (F.col("m") - F.col("base")), 4).alias("delta"))


# --- chunk hierarchy and enrichment -----------------------------------------------


def _turns(spark, sf_dir):
    """Conversations read as documents with headings: the first turn is the scope, questions are sections."""
    rows = table(spark, sf_dir, "conversations")
    heading = F.when(F.col("turn") == 0, F.concat(F.lit("Scope of "), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("part "), (F.col("turn") % 4).cast("string")))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.expr("turn div 4")).alias("parent"), heading.alias("heading"), F.col("text").alias("content"),
        F.when(F.col("turn") == 0, 1).otherwise(F.when(F.col("role") == "user", 2).otherwise(3)).alias("level"),
    )


_TURNS = """turns AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS doc_id, turn AS seq, CASE WHEN turn > 0 THEN conv_id * 1000 + turn // 4 END AS parent,
    CASE WHEN turn = 0 THEN 'Scope of ' || conv_id ELSE 'part ' || turn % 4 END AS heading, text AS content, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS level FROM conversations)"""


@query(
    f"""WITH {_TURNS}, k AS (SELECT parent, list(content ORDER BY seq)[:2] AS c FROM turns WHERE parent IS NOT NULL GROUP BY parent)
    SELECT t.chunk_id, md5(s.content) AS scope, md5(lag(t.content) OVER w) AS prev, md5(lead(t.content) OVER w) AS next, coalesce(len(c), 0) AS children, md5(c[1]) AS first_child
    FROM turns t LEFT JOIN turns s ON s.doc_id = t.doc_id AND s.seq = 0 LEFT JOIN k ON k.parent = t.chunk_id WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.seq)"""
)
def c2_contexts(spark, sf_dir):
    """4.4: what the questions of each chunk may read."""
    found = records.c2_context(_turns(spark, sf_dir))
    return found.select(
        "chunk_id", F.md5("scope").alias("scope"), F.md5("prev_content").alias("prev"), F.md5("next_content").alias("next"), F.size("child_contents").alias("children"),
        F.md5(F.get("child_contents", F.lit(0))).alias("first_child"),
    )


@query(
    f"""WITH {_TURNS}, w AS (SELECT chunk_id AS section_id, doc_id, CASE WHEN seq % 3 = 0 THEN heading WHEN seq % 3 = 1 THEN 'the ' || heading || ' again' ELSE 'nothing' END AS section FROM turns)
    SELECT section_id, arg_min(chunk_id, {{'p': CASE WHEN heading = section THEN 0 WHEN contains(heading, section) OR contains(section, heading) THEN 1 WHEN level = 1 THEN 2 ELSE 3 END, 'l': level, 'h': heading, 'c': chunk_id}}) AS chunk_id
    FROM w JOIN turns USING (doc_id) GROUP BY section_id"""
)
def best_parents(spark, sf_dir):
    """4.11, 7.31: the chunk of a document that a section heading belongs to."""
    turns = _turns(spark, sf_dir)
    said = F.when(F.col("seq") % 3 == 0, F.col("heading")).when(F.col("seq") % 3 == 1, F.concat(F.lit("the "), "heading", F.lit(" again"))).otherwise("nothing")
    return records.best_parents(turns.select(F.col("chunk_id").alias("section_id"), "doc_id", said.alias("section")), turns.select("chunk_id", "doc_id", "level", "heading"))


@query(
    """SELECT CASE WHEN grouping(source) = 1 THEN NULL ELSE source END AS source, grouping(source)::INT AS total, count(*) AS chunks, count_if(doc_id % 3 = 0)::BIGINT AS summaries, sum(doc_id % 4)::BIGINT AS questions,
    round(count_if(doc_id % 3 = 0) / count(*)::DOUBLE, 4) AS coverage FROM documents GROUP BY ROLLUP (source)"""
)
def enrichment_quality(spark, sf_dir):
    """4.19: counters of the enrichment, per document and in total."""
    chunks = table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "s").otherwise(" ").alias("summary"), F.array_repeat(F.lit("q?"), (F.col("doc_id") % 4).cast("int")).alias("questions")
    )
    return records.quality_report(chunks).select(F.col("doc_id").alias("source"), F.col("total").cast("int").alias("total"), "chunks", "summaries", "questions", "coverage")


@query(
    f"""WITH {_TURNS}, u AS (SELECT parent AS section FROM turns WHERE parent IS NOT NULL GROUP BY parent)
    SELECT 'chunk:' || section AS source, 'HAS_SECTION_SUMMARY' AS relation, 'summary:' || section AS target FROM u
    UNION ALL SELECT 'summary:' || parent, 'SUMMARIZES', 'chunk:' || chunk_id FROM turns WHERE parent IS NOT NULL"""
)
def summary_edges(spark, sf_dir):
    """4.14, 4.16: sections, what their summaries read, and the edges that hang the summaries in."""
    turns = _turns(spark, sf_dir)
    named = turns.withColumns({"chunk_id": F.col("chunk_id").cast("string"), "parent": F.col("parent").cast("string")})
    units = enrichment.hierarchy_units(named.drop("parent"), named.select("chunk_id", "parent"), 10_000_000)
    return records.summary_graph(units.withColumn("text", F.lit("[INSUFFICIENT_SOURCE]")))[1]


# --- record graphs -------------------------------------------------------------------


def _shortages(spark, sf_dir):
    drugs = spark.createDataFrame([("drug:1", "Ingredient 1"), ("drug:2", "INGREDIENT  2"), ("drug:9", "other")], "id string, name string")
    return graph_sources.shortage_graph(readers.read_shortages(_shortage_pages(spark, sf_dir)), drugs)


@query(
    """SELECT relation, count(*) AS n, count(DISTINCT target) AS targets FROM (
      SELECT 'AFFECTS_NDC_PRODUCT' AS relation, s_suppkey::VARCHAR AS source, s_suppkey::VARCHAR AS target FROM supplier
      UNION ALL SELECT 'REPORTED_BY', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_suppkey % 5 != 0
      UNION ALL SELECT 'HAS_ACTIVE_INGREDIENT', s_suppkey::VARCHAR, (s_suppkey % 7)::VARCHAR FROM supplier WHERE s_suppkey % 3 = 0
      UNION ALL SELECT DISTINCT 'SAME_AS_CANDIDATE', (s_suppkey % 7)::VARCHAR, (s_suppkey % 7)::VARCHAR FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 7 IN (1, 2)) GROUP BY relation"""
)
def shortage_graph(spark, sf_dir):
    """13.4, 13.10: events, products, companies and ingredients of shortage records, linked to known drugs."""
    _, edges = _shortages(spark, sf_dir)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


@query(
    """WITH q AS (SELECT s_suppkey AS query_id, format('{:05d}-012-03', s_suppkey) AS product FROM supplier WHERE s_suppkey % 4 = 0)
    SELECT query_id, 'ndc:' || product AS product, 101::BIGINT AS score FROM q"""
)
def shortage_evidence(spark, sf_dir):
    """14.5: the shortage event of a question that names a package, found over the package's node."""
    nodes, edges = _shortages(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0")
    code = F.format_string("%05d-%03d-%02d", "s_suppkey", F.lit(12), F.lit(3))
    queries = asked.select(F.col("s_suppkey").alias("query_id"), F.array(F.lower("s_name")).alias("terms"), F.array(F.replace(code, F.lit("-"), F.lit(""))).alias("codes"))
    anchors = asked.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("ndc:"), code).alias("node"))
    found = graph_sources.event_evidence(queries, anchors, nodes, edges)
    return found.where("rank = 1").select("query_id", "product", F.col("score").cast("long").alias("score"))


@query(
    """SELECT 'WAS_RECALLED' AS relation, 'api:' || p_partkey AS source, 'recall:d-' || o_orderkey AS target FROM orders JOIN part ON p_partkey = o_orderkey % 50 WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0
    UNION ALL SELECT 'RECALLED_BY', 'recall:d-' || o_orderkey, 'firm:firm-' || o_custkey % 7 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0"""
)
def recall_graph(spark, sf_dir):
    """13.5: recalls of known drugs and the firms behind them; blank numbers are skipped."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    recalls = orders.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("D-"), F.col("o_orderkey").cast("string"))).otherwise(" ").alias("recall_number"),
        F.concat(F.lit("Drug No. "), (F.col("o_orderkey") % 50).cast("string")).alias("product"), F.concat(F.lit("Firm "), (F.col("o_custkey") % 7).cast("string")).alias("firm"), F.lit("r").alias("reason"),
    )
    drugs = table(spark, sf_dir, "part").select(gq._id("api:", "p_partkey").alias("id"), F.concat(F.lit("drug no "), F.col("p_partkey").cast("string")).alias("name"))
    _, edges = graph_sources.recall_graph(recalls, drugs)
    return edges.select("relation", "source", "target")


@query(
    """WITH t AS (SELECT DISTINCT 'c' || l_suppkey AS chunk_id, l_partkey AS t FROM lineitem WHERE l_orderkey % 10 = 0),
    n AS (SELECT *, 'table:' || chunk_id || ':' || lpad((row_number() OVER (PARTITION BY chunk_id ORDER BY t))::VARCHAR, 3, '0') AS id FROM t)
    SELECT id, 'chunk:' || chunk_id AS chunk, chunk_id IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AS known FROM n"""
)
def table_graph(spark, sf_dir):
    """13.8, 13.15: tables hung under known chunks, others listed for an audit."""
    items = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0")
    tables = items.select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("chunk_id"), F.col("l_partkey").alias("table"), F.lit("s").alias("table_summary")).distinct()
    chunks = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("chunk_id"))
    _, edges, lost = graph_sources.table_graph(tables, chunks)
    known = edges.select(F.col("target").alias("id"), F.col("source").alias("chunk"), F.lit(True).alias("known"))
    return known.unionByName(lost.select("id", F.concat(F.lit("chunk:"), "chunk_id").alias("chunk"), F.lit(False).alias("known")))


@query(
    """WITH c AS (SELECT p_partkey, unnest([substr('ABCDXYZNRS', 1 + p_size % 10, 1), substr('abcdefghij', 1 + p_size % 7, 1)]) AS l FROM part)
    SELECT DISTINCT 'api:' || p_partkey AS source, 'atc:' || upper(l) AS target FROM c WHERE upper(l) IN ('A','B','C','D','G','H','J','L','M','N','P','R','S','V')"""
)
def drug_classes(spark, sf_dir):
    """13.13: parts to the classes of their codes' first letters."""
    codes = F.concat(F.substr(F.lit("ABCDXYZNRS"), F.col("p_size") % 10 + 1, F.lit(1)), F.lit("01|"), F.substr(F.lit("abcdefghij"), F.col("p_size") % 7 + 1, F.lit(1)), F.lit("9"))
    drugs = table(spark, sf_dir, "part").select(gq._id("api:", "p_partkey").alias("id"), codes.alias("codes"))
    return evidence.class_edges(drugs).select("source", "target")


@query(
    f"""WITH {_TURNS}, h AS (SELECT doc_id, heading, arg_min(chunk_id, seq) AS parent FROM turns GROUP BY ALL),
    c AS (SELECT chunk_id, doc_id, unnest(['part ' || (seq + 1) % 4, 'elsewhere', 'Scope of ' || doc_id]) AS heading, unnest([0, 1, 2]) AS up FROM turns)
    SELECT c.chunk_id, arg_min(h.parent, c.up) AS parent FROM c JOIN h USING (doc_id, heading) WHERE h.parent != c.chunk_id GROUP BY c.chunk_id"""
)
def breadcrumb_parents(spark, sf_dir):
    """13.14, 1.22: parents out of breadcrumbs: the nearest part that is a heading of the document."""
    crumbs = F.concat(F.lit("Scope of "), F.col("doc_id").cast("string"), F.lit(" > elsewhere > part "), ((F.col("seq") + 1) % 4).cast("string"))
    return evidence.breadcrumb_parents(_turns(spark, sf_dir).withColumn("parents_context", crumbs))


@query(
    f"""WITH {gq._EDGES}, c AS (SELECT a.source AS head, a.source || '>' || a.target || '>' || b.target || '>' || c.target AS nodes FROM edges a JOIN edges b ON a.target = b.source AND b.relation = 'LOCATED_IN' JOIN edges c ON b.target = c.source AND c.relation = 'BELONGS_TO_AREA' WHERE a.relation = 'SUPPLIED_BY')
    SELECT head, md5(nodes) AS nodes_md5, count(*) OVER (PARTITION BY head) AS chains FROM c QUALIFY count(*) OVER (PARTITION BY head) >= 25"""
)
def multihop_gold(spark, sf_dir):
    """13.16: chains from parts to regions, of parts that start 25 or more."""
    found = evidence.chain_gold(gq._edges(spark, sf_dir), ["SUPPLIED_BY", "LOCATED_IN", "BELONGS_TO_AREA"], 25)
    return found.select("head", F.md5(F.array_join("nodes", ">")).alias("nodes_md5"), "chains")


# --- paths -----------------------------------------------------------------------------

_WALKABLE = f"{gq._EDGES}, und AS (SELECT source AS here, target AS too, source || '|' || relation || '|' || target AS e FROM edges WHERE relation != 'SUPPLIED_BY' UNION ALL SELECT target, source, source || '|' || relation || '|' || target FROM edges WHERE relation != 'SUPPLIED_BY')"


@query(
    f"""WITH RECURSIVE {_WALKABLE}, p(start, path, used, depth) AS (
      SELECT 'region:' || r_regionkey, ['region:' || r_regionkey], []::VARCHAR[], 0 FROM region
      UNION ALL SELECT start, list_append(path, too), list_append(used, e), depth + 1 FROM p JOIN und ON here = path[-1] WHERE depth < 3 AND NOT list_contains(used, e))
    SELECT start, array_to_string(path, '>') AS path, depth, row_number() OVER (PARTITION BY start ORDER BY depth, path, used) AS rank FROM p WHERE depth > 0 QUALIFY rank <= 10"""
)
def variable_paths(spark, sf_dir):
    """14.9: undirected paths of one to three edges from every region, the first ten."""
    starts = table(spark, sf_dir, "region").select(gq._id("region:", "r_regionkey").alias("node"))
    found = evidence.short_paths(starts, gq._edges(spark, sf_dir).where("relation != 'SUPPLIED_BY'"))
    return found.select("start", F.array_join("path", ">").alias("path"), "depth", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {gq._EDGES}, a AS (SELECT s_suppkey AS query_id, 'manufacturer:' || s_suppkey AS node FROM supplier),
    s AS (SELECT query_id, source, relation, target, 'out' AS side FROM a JOIN edges ON node = source UNION ALL SELECT query_id, source, relation, target, 'in' FROM a JOIN edges ON node = target)
    SELECT DISTINCT query_id, source, relation, target FROM (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY relation, source, target) AS n FROM s) WHERE n <= 100"""
)
def one_hop_relations(spark, sf_dir):
    """14.11: the edges around every maker, a hundred of either side."""
    anchors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), gq._id("manufacturer:", "s_suppkey").alias("node"))
    return graph_sources.one_hop(anchors, gq._edges(spark, sf_dir))


@query(
    """SELECT query_id, chunk FROM (SELECT DISTINCT p_partkey AS query_id, l_orderkey AS chunk FROM part JOIN lineitem ON l_partkey = p_partkey OR l_partkey = p_partkey + 1 WHERE p_partkey % 5 = 0)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk) <= 10"""
)
def reverse_mentions(spark, sf_dir):
    """14.12: the first ten orders that mention one of two parts."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    entities = parts.select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).alias("entity"))
    return evidence.mentioning_chunks(entities, _mentions(spark, sf_dir)).select("query_id", "chunk")


def _walk_sql(step: int) -> str:
    return f"""w{step + 1} AS (SELECT s, CASE WHEN n IS NULL THEN path ELSE list_append(path, n) END AS path FROM (
        SELECT w.s, w.path, arg_min(too, {{'h': sha256('42:{step}:' || too), 't': too}}) FILTER (WHERE too IS NOT NULL AND NOT list_contains(w.path, too)) AS n FROM w{step} w LEFT JOIN (SELECT DISTINCT here, too FROM und) u ON u.here = w.path[-1] GROUP BY w.s, w.path))"""


@query(
    f"""WITH {_WALKABLE}, w0 AS (SELECT n_nationkey AS s, ['country:' || n_nationkey] AS path FROM nation), {_walk_sql(0)}, {_walk_sql(1)}, {_walk_sql(2)}
    SELECT s AS query_id, array_to_string(path, '>') AS path FROM w3"""
)
def seeded_walks(spark, sf_dir):
    """14.14: one walk of three steps from every country, each to the neighbour with the least hash."""
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), gq._id("country:", "n_nationkey").alias("node"))
    walks = graph_sources.hashed_walk(starts, gq._edges(spark, sf_dir).where("relation != 'SUPPLIED_BY'"))
    return walks.select("query_id", F.array_join("path", ">").alias("path"))


@query("SELECT s_suppkey AS path_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0 AND n_regionkey != s_suppkey % 5 OR s_suppkey % 4 = 1")
def broken_paths(spark, sf_dir):
    """14.17: paths with a step that no edge joins in that direction."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    maker, country = gq._id("manufacturer:", "s_suppkey"), gq._id("country:", "n_nationkey")
    area = F.concat(F.lit("region:"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey") % 5).otherwise(F.col("n_regionkey")).cast("string"))
    path = F.when(F.col("s_suppkey") % 4 == 1, F.array(country, maker)).otherwise(F.array(maker, country, area))
    return graph_sources.broken_paths(rows.select(F.col("s_suppkey").alias("path_id"), path.alias("path")), gq._edges(spark, sf_dir))


@query(
    f"""WITH {gq._EDGES}, g AS (SELECT source, relation, min(target) AS target FROM edges WHERE relation = 'SUPPLIED_BY' AND source LIKE '%7' GROUP BY ALL)
    SELECT e.source, e.relation, e.target FROM edges e JOIN g ON g.source = e.source AND g.relation = e.relation AND g.target != e.target"""
)
def ambiguous_edges(spark, sf_dir):
    """14.18: edges that share source and relation with a gold edge and lead elsewhere."""
    edges = gq._edges(spark, sf_dir)
    gold = edges.where("relation = 'SUPPLIED_BY' AND source LIKE '%7'").groupBy("source", "relation").agg(F.min("target").alias("target"))
    return graph_sources.ambiguous_edges(gold, edges)


# --- annotation ------------------------------------------------------------------------


@query(
    f"""WITH q AS (SELECT conv_id, turn, trim(text) || CASE WHEN turn % 3 = 0 THEN '?' ELSE '' END AS question FROM conversations WHERE role = 'user'),
    h AS (SELECT array_to_string({TOKENS.format("question")}, ' ') AS k FROM q WHERE conv_id % 5 = 0)
    SELECT conv_id, turn FROM q WHERE rtrim(question) LIKE '%?' AND len(string_split_regex(trim(question), '\\s+')) <= 55 AND array_to_string({TOKENS.format("question")}, ' ') NOT IN (SELECT k FROM h)"""
)
def valid_questions(spark, sf_dir):
    """17.8: questions that keep the contract and were never asked before."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = asked.select("conv_id", "turn", F.concat(F.trim("text"), F.when(F.col("turn") % 3 == 0, "?").otherwise("")).alias("question"))
    return records.valid_questions(rows, rows.where("conv_id % 5 = 0")).select("conv_id", "turn")


@query(
    f"""WITH {_TURNS}, c AS (SELECT chunk_id, doc_id, seq, parent, level, sha256('pool:' || chunk_id) AS h FROM turns), s AS (SELECT doc_id AS query_id, * FROM c WHERE seq = 2),
    k AS (SELECT query_id, chunk_id, 0 AS p, 'seed' AS kind FROM s
      UNION ALL SELECT s.query_id, c.chunk_id, 1, 'neighbour' FROM s JOIN c ON c.doc_id = s.doc_id AND abs(c.seq - s.seq) = 1
      UNION ALL SELECT * FROM (SELECT s.query_id, c.chunk_id, 2, 'sibling' FROM s JOIN c ON c.doc_id = s.doc_id AND c.parent = s.parent AND c.level = s.level AND c.chunk_id != s.chunk_id QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY c.h, c.chunk_id) <= 8)
      UNION ALL SELECT * FROM (SELECT s.query_id, c.chunk_id, 3, 'distractor' FROM s JOIN c ON c.doc_id != s.doc_id AND c.h > s.h QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY c.h, c.chunk_id) <= 4))
    SELECT query_id, chunk_id, arg_min(kind, p) AS kind FROM k GROUP BY ALL"""
)
def confirmatory_pool(spark, sf_dir):
    """17.6: seeds with their neighbours, siblings and distractors."""
    turns = _turns(spark, sf_dir)
    return records.confirmatory_pool(turns.where("seq = 2").withColumn("query_id", F.col("doc_id")), turns)


@query("SELECT DISTINCT query_id, chunk_id FROM (SELECT item_id AS query_id, unnest([item_id, item_id * 2, item_id + 1000000]) AS chunk_id FROM benchmark) WHERE chunk_id IN (SELECT doc_id FROM documents)")
def ground_truth(spark, sf_dir):
    """17.10: annotated ids that the corpus holds."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.col("item_id"), F.col("item_id") * 2, F.col("item_id") + 1000000).alias("annotated"))
    return records.ground_truth(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'multi_hop' WHEN 1 THEN 'table' WHEN 2 THEN 'structured_event' WHEN 3 THEN 'hierarchy' ELSE 'semantic' END AS slice FROM part"""
)
def gap_slices(spark, sf_dir):
    """17.14: slices by what a capability's description says."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("Multi-hop reasoning", "a TABLE of limits", "drug shortage", "which section", "plain words")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", records.gap_slice(F.concat(said, F.lit(" of "), "p_name")).alias("slice"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing FROM events")
def event_projection(spark, sf_dir):
    """17.16: named properties of events, blank where absent."""
    return table(spark, sf_dir, "events").select("event_id", records.event_projection(F.col("props"), ["page", "k", "missing"]).alias("p")).select("event_id", "p.*")


@query(
    f"""SELECT doc_id, regexp_matches(array_to_string({TOKENS.format("source")}, ' '), '(^| )tables?( |$)') OR contains(coalesce(text, ''), '[表:') OR {" OR ".join(f"contains(' ' || array_to_string({TOKENS.format('left(text, 800)')}, ' ') || ' ', ' {t} ')" for t in text.TABLE_TERMS)} AS is_table FROM documents"""
)
def table_evidence(spark, sf_dir):
    """5.14: whether a document shows a table."""
    return table(spark, sf_dir, "documents").select("doc_id", records.is_table_evidence(F.col("source"), F.col("text"), F.col("doc_id")).alias("is_table"))


@query()
def content_similarities(spark, sf_dir):
    """5.18: how alike neighbouring turns are, by containment, words or matching blocks."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(records.content_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))::INT AS tokens FROM documents")
def folded_tokens(spark, sf_dir):
    """5.4: compatibility-normalised tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(records.normalized_tokens("text")).alias("tokens"))
