"""Queries of chunking, enrichment, sampling, integrity, as-of joins and remaining fusion forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import chunking, dense, enrichment, fusion, integrity, metrics, sampling, stats
from quillgraph.plans import retrieval_queries as rq
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import _STOPS, TOKENS, _any


@query()
def chunk_documents(spark, sf_dir):
    """3.1 to 3.26, 20.5: all documents as linked chunks."""
    chunks = chunking.linked_chunks(chunking.chunk_documents(table(spark, sf_dir, "documents")))
    return chunks.select("doc_id", "seq", "chunk_id", "level", "char_count", "line_count", "prev_chunk_id", "next_chunk_id", "children_count")


@query()
def chunk_summary(spark, sf_dir):
    """3.28: chunks and levels per document."""
    return chunking.corpus_summary(chunking.chunk_documents(table(spark, sf_dir, "documents")))


def _as_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit("").alias("heading"), F.lit("").alias("parents_context"),
        body.alias("content"), F.lit(1).alias("level"), F.length(body).alias("char_count"), F.size(F.split(body, "\n")).alias("line_count"),
    )


@query(
    """WITH c AS (SELECT length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents)
    SELECT count_if(lines >= 20 OR chars >= 1500)::BIGINT AS summaries, count_if(chars >= 100)::BIGINT AS questions FROM c"""
)
def enrichment_calls(spark, sf_dir):
    """4.1, 4.18: how many model calls enriching all documents would take."""
    return enrichment.call_volume(_as_chunks(spark, sf_dir))


@query(
    """SELECT count(DISTINCT source) AS documents, count(*) AS chunks, count(DISTINCT doc_id) AS chunk_ids, max(length(coalesce(text, '')))::BIGINT AS max_chars,
    count_if(trim(coalesce(text, '')) = '')::BIGINT AS empty_chunks, count_if(source = 'src1')::BIGINT AS excluded_rows FROM documents"""
)
def enrichment_inventory(spark, sf_dir):
    """3.30, 4.17: what an enriched corpus holds, with a source read as excluded."""
    found = enrichment.inventory(_as_chunks(spark, sf_dir), ["src1"])
    return found.withColumn("max_chars", F.col("max_chars").cast("long"))


@query()
def guarded_questions(spark, sf_dir):
    """4.5, 4.6, 4.24: questions of a stand-in model through the guards."""
    chunks = _as_chunks(spark, sf_dir)
    prompts = chunks.select(F.col("chunk_id").alias("key"), F.left("content", F.lit(200)).alias("prompt"))
    answers = enrichment.complete(prompts, lambda ps: [f"1. What does it say about {p[:40]}?\n2. Why?\n- Does FDA agree with {p[:30]}?" for p in ps])
    return enrichment.guarded_questions(chunks, answers)


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents WHERE lang IS NOT NULL),
    k AS (SELECT count(DISTINCT lang) AS kinds FROM documents)
    SELECT doc_id, lang FROM r, k WHERE n <= floor(40 / kinds)"""
)
def balanced_sample(spark, sf_dir):
    """17.1: forty documents spread evenly over languages."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    kinds = rows.select("lang").distinct()
    return sampling.balanced(rows, "lang", "doc_id", 40).join(kinds, "lang").select("doc_id", "lang")


@query(
    f"""WITH {rq._LISTS}, m AS (SELECT query_id, item, min({{'list': list, 'rank': rank}}) AS best, array_to_string(list_sort(list(DISTINCT route)), '+') AS sources FROM lists GROUP BY ALL)
    SELECT query_id, item, sources, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, item) AS place FROM m) WHERE place <= 12"""
)
def candidate_pool(spark, sf_dir):
    """17.5: candidates of every item with where they came from."""
    lists = rq._two_lists(spark, sf_dir).select("query_id", "item", F.col("route").alias("source"), F.col("list").alias("priority"), "rank")
    pool = sampling.candidate_pool(lists)
    return pool.select("query_id", "item", F.array_join("sources", "+").alias("sources"), F.col("place").cast("long").alias("place"))


@query(
    """SELECT item_id, slice, CASE WHEN n <= 5 THEN 1 WHEN n <= 15 THEN 2 END AS batch FROM (
      SELECT item_id, item_id % 3 AS slice, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS n FROM benchmark)"""
)
def batch_assignment(spark, sf_dir):
    """17.7: five, then ten items of each slice."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("slice"))
    return sampling.batches(rows, "slice", "item_id", [5, 10])


@query("SELECT source, 60 AS least, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY source HAVING count(*) < 60")
def quota_check(spark, sf_dir):
    """8.19, 17.13, 18.3: sources below their quota."""
    return integrity.quota_problems(table(spark, sf_dir, "documents"), "source", {"src0": 60, "src1": 60, "src2": 60})


@query("SELECT doc_id, quality::VARCHAR AS label FROM labels WHERE quality IS NULL OR quality NOT IN (1)")
def label_domain(spark, sf_dir):
    """8.18: labels outside a domain."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return integrity.label_problems(rows, ["1"])


@query(
    """SELECT count(*) AS rows, coalesce(sum(('0x' || left(sha256(concat_ws('|', coalesce('=' || doc_id, '-'), coalesce('=' || lang, '-'), coalesce('=' || n_chars, '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))), 12))::BIGINT), 0)::VARCHAR AS hash_sum FROM documents"""
)
def table_fingerprints(spark, sf_dir):
    """18.5: row counts and order-free hashes of the documents."""
    return integrity.table_fingerprint(table(spark, sf_dir, "documents"))


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def last_view_before_purchase(spark, sf_dir):
    """7.16: an as-of join as a union and a running last value."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    is_view = F.col("event_type") == "view"
    order = Window.partitionBy("user_id").orderBy("ts", is_view.desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("view_id", F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(order))
    return marked.where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


@query(
    f"""WITH {rq._FULL}, d AS (SELECT f.*, source FROM full_text f JOIN documents ON doc_id = item),
    i AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, rank) AS r FROM d),
    f AS (SELECT query_id, item, sum(1.0 / (60 + r)) AS score, min(rank) AS first FROM i GROUP BY ALL)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f"""
)
def source_group_rrf(spark, sf_dir):
    """12.19: fusion of each source's own order."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    scored = rq._bm25(spark, sf_dir).join(sources, "item").withColumnRenamed("rank", "position")
    return fusion.source_group_rrf(scored).select("query_id", "item", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {rq._LISTS}, b AS (SELECT query_id, item, max(score) AS score, min(CASE WHEN true THEN rank END) AS r FROM lists GROUP BY ALL),
    x AS (SELECT query_id, item, max({{'score': score, 'r': -rank}}) AS best FROM lists GROUP BY ALL)
    SELECT query_id, item, round(best.score, 6) AS score FROM x"""
)
def best_scores(spark, sf_dir):
    """8.7, 12.10: the better of two scores of each document."""
    best = dense.best_per_item(rq._two_lists(spark, sf_dir), "item")
    return best.select("query_id", "item", F.round("score", 6).alias("score"))


@query(
    f"""WITH {rq._LISTS}, {rq._GOLD}, f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS score, min(rank) AS first FROM lists GROUP BY ALL),
    fused AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f),
    q AS (SELECT DISTINCT query_id FROM gold),
    h AS (SELECT q.query_id,
            EXISTS (SELECT 1 FROM fused x JOIN gold g USING (query_id, item) WHERE x.query_id = q.query_id AND rank <= 5) AS fh,
            EXISTS (SELECT 1 FROM lists x JOIN gold g USING (query_id, item) WHERE x.query_id = q.query_id AND rank <= 5) AS ph,
            EXISTS (SELECT 1 FROM fused x JOIN documents d ON d.doc_id = x.item JOIN gold g ON g.query_id = x.query_id JOIN documents e ON e.doc_id = g.item AND e.source = d.source
                    WHERE x.query_id = q.query_id AND rank <= 5) AS near FROM q)
    SELECT query_id, CASE WHEN fh THEN 'hit' WHEN ph THEN 'fusion_dilution' WHEN near THEN 'within_document_miss' ELSE 'routing_miss' END AS failure FROM h"""
)
def failure_taxonomy(spark, sf_dir):
    """15.9: why the fused ranking misses, sources read as documents."""
    lists = rq._two_lists(spark, sf_dir)
    fused = fusion.rrf(lists)
    ranked = lists.select(F.col("route").alias("method"), "query_id", "item", "rank").unionByName(
        fused.select(F.lit("fused").alias("method"), "query_id", "item", "rank")
    )
    gold = rq._gold(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("doc"))
    docs = lambda rows: rows.join(sources, "item").select("query_id", "doc")
    return metrics.failure_taxonomy(
        metrics.query_metrics(ranked, gold), "fused", ["bottom_up", "top_down"], docs(gold), docs(fused.where("rank <= 5"))
    )


_HEAD = "left(coalesce(text, ''), 80)"


@query(
    f"""WITH {rq._LISTS}, i AS (SELECT item_id AS query_id, text AS q, list_distinct([t FOR t IN {TOKENS.format("text")} IF len(t) > 1 AND NOT list_contains({_STOPS}, t)]) AS w, {_any("text", text.TABLE_TERMS)} AS asks FROM benchmark),
    h AS (SELECT doc_id AS item, list_distinct([t FOR t IN {TOKENS.format(_HEAD)} IF len(t) > 1 AND NOT list_contains({_STOPS}, t)]) AS w, {_any(_HEAD, text.TABLE_TERMS)} AS shows FROM documents),
    f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS base, min(rank) AS first, max(rank <= 1) AS required FROM lists WHERE rank <= 10 GROUP BY ALL),
    s AS (SELECT f.*, base + CASE WHEN asks AND shows THEN 0.004 ELSE 0 END + 0.003 * CASE WHEN len(i.w) = 0 OR h.w IS NULL THEN 0 ELSE len(list_intersect(i.w, h.w)) / len(i.w)::DOUBLE END AS score FROM f JOIN i USING (query_id) LEFT JOIN h USING (item)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, item) AS rank FROM s),
    k AS (SELECT *, CASE WHEN rank <= 5 AND NOT required THEN 'spare' WHEN rank > 5 AND required THEN 'want' ELSE 'stay' END AS kind FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY CASE WHEN kind = 'spare' THEN round(score, 12) ELSE rank END, item) AS nth,
                 least(count(*) FILTER (WHERE kind = 'spare') OVER (PARTITION BY query_id), count(*) FILTER (WHERE kind = 'want') OVER (PARTITION BY query_id)) AS swaps FROM k),
    m AS (SELECT a.*, a.kind != 'stay' AND a.nth <= a.swaps AS moves, b.rank AS gap FROM n a LEFT JOIN n b ON b.query_id = a.query_id AND b.nth = a.nth AND b.kind = 'spare' AND b.nth <= b.swaps)
    SELECT query_id, item, round(score, 9) AS score, moves AND kind = 'want' AS retained,
           row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 5 AND NOT moves OR moves AND kind = 'want' THEN 0 WHEN moves THEN 1 ELSE 2 END,
                              CASE WHEN moves AND kind = 'want' THEN gap WHEN moves THEN -nth ELSE rank END) AS rank FROM m"""
)
def adaptive_fusion(spark, sf_dir):
    """12.21 to 12.23: gated fusion with boosts and kept text routes; sources give the graph route."""
    lists = rq._two_lists(spark, sf_dir).select("query_id", "item", "route", "rank").where("rank <= 10")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    gates = items.select("query_id", text.wants_graph("query").alias("graph_on"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.left("text", F.lit(80)).alias("heading"))
    boosts = lists.select("query_id", "item").distinct().join(items, "query_id").join(docs, "item").select(
        "query_id", "item", F.lit(False).alias("explicit_document"), (text.has_any_term("query") & text.has_any_term("heading")).alias("table_match"),
        text.heading_overlap("query", "heading").alias("overlap"),
    )
    ranked = fusion.adaptive_rank(lists, gates, boosts)
    return ranked.select("query_id", "item", F.round("score", 9).alias("score"), "retained", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH w AS (SELECT conv_id, list_distinct(flatten(list({TOKENS.format('text')}) FILTER (role = 'user'))) AS a,
                          list_distinct(flatten(list({TOKENS.format('text')}) FILTER (role = 'assistant'))) AS b FROM conversations GROUP BY conv_id)
    SELECT conv_id AS query_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0)::DOUBLE, 6) AS jaccard,
           round(2.0 * len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(coalesce(a, [])) + len(coalesce(b, [])), 0), 6) AS f1 FROM w"""
)
def set_agreement(spark, sf_dir):
    """16.11: agreement of the words that two roles use."""
    words = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "user", text.tokenize("text")))))
    other = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "assistant", text.tokenize("text")))))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(words.alias("a"), other.alias("b"))
    return stats.set_agreement(rows).select("query_id", F.round("jaccard", 6).alias("jaccard"), F.round("f1", 6).alias("f1"))
