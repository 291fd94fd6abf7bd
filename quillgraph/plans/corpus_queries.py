"""Queries of corpus scans, spans, representative rows and document-level metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import chains, chunking, evidence, graph, metrics, stats
from quillgraph.plans import graph_queries as gq
from quillgraph.plans import retrieval_queries as rq
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import TOKENS
from quillgraph.scratch import fresh_path
from quillgraph.sources import readers, sinks


@query(
    """SELECT source AS doc_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS corpus_pos FROM documents WHERE source IS NOT NULL"""
)
def chunk_corpus(spark, sf_dir):
    """1.1, 1.2: a corpus of JSON array files, one document each, read with its checks and its order."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    chunk = F.struct("id", F.col("id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit(1).alias("level"), F.col("text").alias("content"))
    arrays = docs.withColumnRenamed("doc_id", "id").groupBy("source").agg(F.to_json(F.array_sort(F.collect_list(chunk))).alias("value"))
    place = arrays.withColumn("file", F.row_number().over(Window.orderBy("source")) - 1)  # one row per document of the corpus
    path = fresh_path(spark, "corpus")
    place.repartitionById(max(1, place.count()), F.col("file")).select("value").write.text(path)
    found = readers.corpus_position(readers.read_chunks(spark, f"{path}/*.txt"))
    return found.select("doc_id", "chunk_id", "corpus_pos")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, CASE WHEN vec_id % 2 = 0 THEN 'v' || vec_id ELSE 'legacy:' || (row_number() OVER (ORDER BY vec_id) - 1) END AS item, len(embedding) AS dims FROM embeddings")
def vector_positions(spark, sf_dir):
    """1.8, 1.9: vectors by position, with the id of a map and a legacy name where the map has none."""
    vectors = table(spark, sf_dir, "embeddings")
    placed = vectors.withColumn("position", F.row_number().over(Window.orderBy("vec_id")) - 1)  # the position is the order of a flat index
    known = placed.where("vec_id % 2 = 0").select("position", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("known"))
    found = placed.join(known, "position", "left")
    return found.select(F.col("position").cast("long").alias("position"), F.coalesce("known", F.concat(F.lit("legacy:"), F.col("position").cast("string"))).alias("item"), F.size("embedding").cast("long").alias("dims"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in evidence.ATC_CLASSES.items()) + ") AS t(letter, name)")
def fixed_tables(spark, sf_dir):
    """1.11: a static reference table."""
    return spark.createDataFrame(list(evidence.ATC_CLASSES.items()), "letter string, name string")


@query("SELECT r_regionkey, r_name, true AS refused FROM region")
def written_once(spark, sf_dir):
    """2.2: a table written to a path that must be free; the second write is refused."""
    path = fresh_path(spark, "once")
    regions = table(spark, sf_dir, "region")
    sinks.write_once(regions, path)
    refused = False
    try:
        sinks.write_once(regions, path)
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query(
    """SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS chunk_id, doc_id, length(text) AS chars FROM documents WHERE trim(text) != ''
    QUALIFY row_number() OVER (PARTITION BY coalesce(source, '') || '/' || coalesce(lang, '') ORDER BY length(text) DESC, doc_id) = 1"""
)
def longest_contents(spark, sf_dir):
    """3.27: of chunks with one id the longest content, blank ones left out."""
    chunk = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(chunk.alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), F.col("text").alias("content"))
    return chunking.longest_contents(rows).select("chunk_id", "doc_id", F.length("content").cast("long").alias("chars"))


@query(
    f"""WITH m AS (SELECT s_suppkey, s_name || ' sells the ' || a.p_name || ', not ' || b.p_name || '.' AS text FROM supplier JOIN part a ON a.p_partkey = s_suppkey * 2 JOIN part b ON b.p_partkey = s_suppkey),
    w AS (SELECT s_suppkey, {TOKENS.format("text")} AS w FROM m), names AS (SELECT DISTINCT lower(p_name) AS alias FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) FROM part),
    h AS (SELECT s_suppkey, i AS start, n AS n_words, array_to_string(w[i + 1 : i + n], ' ') AS alias FROM w, (SELECT unnest([1, 2]) AS n), unnest(range(0, len(w))) AS t(i) WHERE i + n <= len(w)),
    k AS (SELECT s_suppkey AS id, list({{'w': -n_words, 'c': -length(alias), 's': start, 'a': alias, 'n': n_words}} ORDER BY -n_words, -length(alias), start, alias) AS hits FROM h JOIN names USING (alias) GROUP BY s_suppkey),
    r AS (WITH RECURSIVE r(id, hits, k, kept) AS (SELECT id, hits, 1, hits[1:0] FROM k
      UNION ALL SELECT id, hits, k + 1, CASE WHEN len([t FOR t IN kept IF hits[k].s < t.s + t.n AND t.s < hits[k].s + hits[k].n]) = 0 THEN list_append(kept, hits[k]) ELSE kept END FROM r WHERE k <= len(hits)) SELECT * FROM r)
    SELECT id, x.s::BIGINT AS start, x.a AS alias FROM (SELECT id, unnest(kept) AS x FROM r WHERE k = len(hits) + 1)"""
)
def longest_spans(spark, sf_dir):
    """7.8, 7.9: of overlapping mentions the longest, none over another."""
    parts = table(spark, sf_dir, "part")
    name = lambda key, alias: parts.select(F.col("p_partkey").alias(key), F.col("p_name").alias(alias))
    makers = table(spark, sf_dir, "supplier").withColumn("two", F.col("s_suppkey") * 2)
    said = makers.join(name("two", "a"), "two").join(name("s_suppkey", "b"), "s_suppkey").select(
        "s_suppkey", F.concat("s_name", F.lit(" sells the "), "a", F.lit(", not "), "b", F.lit(".")).alias("text")
    )
    nodes = parts.select(gq._id("api:", "p_partkey").alias("id"), F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), 2))).alias("name"))
    found = graph.longest_spans(graph.phrase_hits(said, graph.alias_index(nodes), "s_suppkey", "text"))
    return found.select("id", F.col("start").cast("long").alias("start"), "alias")


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n, count(*) OVER (PARTITION BY source) AS k FROM documents WHERE source IS NOT NULL)
    SELECT source, doc_id, CASE WHEN n = 1 THEN 'least' WHEN n = k THEN 'most' ELSE 'middle' END AS place FROM r WHERE n IN (1, k, (k + 1) // 2)"""
)
def representative_rows(spark, sf_dir):
    """10.6: the shortest, the middle and the longest chunk of each document."""
    order = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(
        "doc_id", "source", F.row_number().over(order).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("k")
    )
    picked = rows.where("n IN (1, k, (k + 1) div 2)")
    return picked.select("source", "doc_id", F.when(F.col("n") == 1, "least").when(F.col("n") == F.col("k"), "most").otherwise("middle").alias("place"))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS k FROM documents WHERE source IS NOT NULL),
    c AS (SELECT source, doc_id, {'phase': 0, 'n': s} AS why FROM r WHERE s <= 3 UNION ALL SELECT source, doc_id, {'phase': 1, 'n': i} FROM r, (SELECT unnest(range(0, 6)) AS i) WHERE p = round_even(i * (k - 1) / 5.0, 0)
      UNION ALL SELECT source, doc_id, {'phase': 2, 'n': s} FROM r)
    SELECT source, doc_id FROM (SELECT source, doc_id, min(why) AS why FROM c GROUP BY source, doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY why) <= 6"""
)
def coverage_sample(spark, sf_dir):
    """10.7: six chunks of each document: three by size, the rest evenly spaced, filled up by size."""
    by_size = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(
        "doc_id", "source", F.row_number().over(by_size).alias("s"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("p"),
        F.count(F.lit(1)).over(Window.partitionBy("source")).alias("k"),
    )
    spaced = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.alias("i"), F.bround(i * (F.col("k") - 1) / 5.0, 0).cast("long").alias("at")))
    even = F.array_min(F.transform(F.filter(spaced, lambda x: x["at"] == F.col("p")), lambda x: x["i"]))
    why = (
        F.when(F.col("s") <= 3, F.struct(F.lit(0).alias("phase"), F.col("s").alias("n")))
        .when(even.isNotNull(), F.struct(F.lit(1).alias("phase"), even.alias("n")))
        .otherwise(F.struct(F.lit(2).alias("phase"), F.col("s").alias("n")))
    )
    nth = F.row_number().over(Window.partitionBy("source").orderBy("why"))
    return rows.withColumn("why", why).withColumn("nth", nth).where("nth <= 6").select("source", "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, source, lang, length(text) AS n, len([x FOR x IN {TOKENS.format("text")} IF x IN ('the', 'de', 'der', 'la')]) AS hits FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
    b AS (SELECT lang, source, doc_id, hits, n FROM t QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY hits DESC, n DESC, doc_id) = 1)
    SELECT lang, source, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hits DESC, n DESC, doc_id) <= 2"""
)
def topic_pick(spark, sf_dir):
    """10.5: the best chunk of two documents for each topic, by its terms, its length and its id."""
    words = F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "source", "lang", F.length("text").alias("n"), F.size(F.filter(words, lambda x: x.isin("the", "de", "der", "la"))).alias("hits")
    )
    order = (F.desc("hits"), F.desc("n"), F.col("doc_id"))
    best = rows.withColumn("a", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where("a = 1")
    return best.withColumn("b", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where("b <= 2").select("lang", "source", "doc_id")


@query(
    f"""WITH {rq._FULL}, {rq._DENSE.strip()}, {rq._GOLD}, l AS (SELECT 'bm25' AS method, query_id, item, rank FROM full_text UNION ALL SELECT 'dense', query_id, item, rank FROM vector_hits),
    d AS (SELECT method, query_id, source, row_number() OVER (PARTITION BY method, query_id ORDER BY min(rank), source) AS rank FROM l JOIN documents ON doc_id = item GROUP BY method, query_id, source),
    g AS (SELECT DISTINCT query_id, source FROM gold JOIN documents ON doc_id = item),
    j AS (SELECT d.method, d.query_id, d.rank, g.source IS NOT NULL AS hit FROM d LEFT JOIN g USING (query_id, source) WHERE query_id IN (SELECT query_id FROM g)),
    p AS (SELECT m.method, q.query_id, coalesce(max(CASE WHEN hit AND rank <= 5 THEN 1.0 END), 0) AS hit5, coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS mrr
      FROM (SELECT DISTINCT query_id FROM g) q CROSS JOIN (VALUES ('bm25'), ('dense')) m(method) LEFT JOIN j ON j.method = m.method AND j.query_id = q.query_id GROUP BY ALL)
    SELECT method, count(*) AS n, round(avg(hit5), 6) AS hit5, round(avg(mrr), 6) AS mrr FROM p GROUP BY method"""
)
def document_metrics(spark, sf_dir):
    """1.30, 15.6, 15.7: metrics of two routes with chunks read as their documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("doc"))
    route = lambda df, name: df.select(F.lit(name).alias("method"), "query_id", "item", "rank")
    lists = route(rq._bm25(spark, sf_dir), "bm25").unionByName(route(rq._dense(spark, sf_dir), "dense")).join(docs, "item")
    ranked = metrics.dedupe_ranks(lists.select("method", "query_id", F.col("doc").alias("item"), "rank"))
    gold = rq._gold(spark, sf_dir).join(docs, "item").select("query_id", F.col("doc").alias("item"))
    per = metrics.query_metrics(ranked, gold)
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit5"), 6).alias("hit5"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query(
    f"""WITH n AS (SELECT p_partkey, [p_name, p_partkey::VARCHAR, p_type, CASE WHEN p_partkey % 100 = 0 THEN 'EMA GMP: Annex 11' END] AS said FROM part),
    a AS (SELECT p_partkey, array_to_string({TOKENS.format("x")}, ' ') AS alias FROM (SELECT p_partkey, unnest(said) AS x FROM n))
    SELECT DISTINCT p_partkey, alias FROM a WHERE length(replace(alias, ' ', '')) >= 3
    UNION SELECT p_partkey, unnest(['ema gmp annex 11', 'eu gmp annex 11', 'eudralex volume 4 annex 11']) FROM part WHERE p_partkey % 100 = 0"""
)
def node_alias_rows(spark, sf_dir):
    """7.29: what every part answers to: name, id, properties and their equivalents."""
    parts = table(spark, sf_dir, "part")
    bag = F.to_json(F.struct(F.col("p_type").alias("generic_name"), F.when(F.col("p_partkey") % 100 == 0, "EMA GMP: Annex 11").alias("topic_name"), F.lit("ignored").alias("other")))
    nodes = parts.select(gq._id("api:", "p_partkey").alias("id"), F.col("p_name").alias("name"), bag.alias("properties"))
    return chains.node_aliases(nodes).select(F.substring("id", 5, 20).cast("long").alias("p_partkey"), "alias")


@query("SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 1 AS named FROM part")
def explicit_documents(spark, sf_dir):
    """5.12: whether a question names a document, by its id or one of its names."""
    asked = F.element_at(F.array(*[F.lit(q) for q in ("What of ICH-Q9 here", "Is Q9 old", "What of q99", "plain words")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.names_document(asked, text.document_aliases(F.lit("ich_q9"))).alias("named"))


@query()
def stratified_intervals(spark, sf_dir):
    """16.4: intervals of balances by region, resampled inside nations."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stratum"), F.col("n_regionkey").alias("label"))
    values = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stratum"), F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("value")).join(regions, "stratum")
    return stats.stratified_bootstrap(values)


@query()
def cluster_intervals(spark, sf_dir):
    """16.2, 16.5, 20.6: intervals of order values by segment, whole customers resampled; a segment's exact draw beside it."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = orders.select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("unit"), F.col("o_totalprice").alias("value"))
    drawn = stats.cluster_bootstrap(values, iterations=200)
    exact = stats.bootstrap_exact(values.groupBy("label", "unit").agg(F.avg("value").alias("value")), iterations=200)
    return drawn.join(exact.select("label", F.col("low").alias("exact_low"), F.col("high").alias("exact_high")), "label")
