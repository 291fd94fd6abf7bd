"""Queries of lexical and dense retrieval, fusion, metrics and agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import dense, fusion, lexical, metrics, stats
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import TOKENS, _any
from quillgraph.scratch import staged

_T = TOKENS.format("text")


def _bm25_sql(name: str, source: str, limit: int) -> str:
    """CTEs that end in ``name(query_id, item, score, rank)``."""
    tokens = TOKENS.format(source)
    return f"""
    {name}_tok AS (SELECT doc_id AS doc, {tokens} AS toks FROM documents),
    {name}_len AS (SELECT doc, len(toks) AS len FROM {name}_tok),
    {name}_tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {name}_len),
    {name}_post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM {name}_tok) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
    {name}_q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY ALL),
    {name}_s AS (
        SELECT query_id, doc AS item,
               sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS score
        FROM {name}_q JOIN {name}_post USING (term) JOIN {name}_df USING (term) JOIN {name}_len USING (doc), {name}_tot
        GROUP BY ALL),
    {name} AS (
        SELECT * FROM (SELECT query_id, item, score,
                              row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM {name}_s)
        WHERE rank <= {limit})"""


_FULL = _bm25_sql("full_text", "text", 60)
_DENSE = """
    vector_hits AS (
        SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank
        FROM (SELECT q.vec_id AS query_id, v.vec_id AS item, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
              FROM embeddings v, embeddings q JOIN benchmark ON item_id = q.vec_id)
        QUALIFY rank <= 60)"""


def _bm25(spark, sf_dir, limit=60, max_chars=None):
    index = lexical.build_index(table(spark, sf_dir, "documents"), max_chars=max_chars)
    ranked = lexical.bm25_rank(index, table(spark, sf_dir, "benchmark"), limit, id_col="item_id", text_col="text")
    return ranked.select("query_id", F.col("doc").alias("item"), "score", "rank")


def _dense(spark, sf_dir, limit=60):
    """The nearest vectors of every item; an item and a document have the vector of their own number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    queries = vectors.join(items, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    ranked = dense.dense_top_k_blocked(vectors, queries, limit)
    return ranked.select("query_id", F.col("vec_id").alias("item"), "score", "rank")


KEY_WORDS = 8


def _gold(spark, sf_dir):
    """Documents that hold a whole item, as a substring.

    An item's words but the first and the last stand in such a document as
    whole words, so the first eight of those, hashed, find the candidates by an
    equi join with the runs of words of the documents; the candidates are then
    compared with the whole item. Items of fewer words have shorter keys.
    """
    space = r"[\s\p{Z}]+"
    items = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("item_text"))
    words = F.split("item_text", space)
    keyed = items.withColumn("n", F.greatest(F.lit(0), F.least(F.lit(KEY_WORDS), F.size(words) - 2))).withColumn(
        "key", F.when(F.col("n") > 0, F.xxhash64(F.array_join(F.slice(words, F.lit(2), F.greatest(F.lit(1), "n")), " ")))
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")
    split = docs.where("text IS NOT NULL").select("item", F.split("text", space).alias("words"))
    wanted = staged(keyed, "gold-items")
    sizes = [r["n"] for r in wanted.select("n").distinct().collect()]  # nine values at most
    candidates = wanted.where("n = 0").select("query_id").crossJoin(docs.select("item").distinct()) if 0 in sizes else None
    for n in sorted(s for s in sizes if s):
        runs = split.where(F.size("words") >= n).select(
            "item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " ")))).alias("key")  # noqa: B023
        )
        hits = runs.join(wanted.where(F.col("n") == n).select("query_id", "key"), "key").select("query_id", "item").distinct()
        candidates = hits if candidates is None else candidates.unionByName(hits)
    if candidates is None:
        return items.crossJoin(docs).where("false").select("query_id", "item")
    found = candidates.join(items, "query_id").join(docs, "item")
    return found.where(F.contains("text", "item_text")).select("query_id", "item").distinct()


_GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, doc_id AS item FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text))"


def bm25_top10(spark, sf_dir):
    """12.1, 12.2, 12.3: the ten best documents of every benchmark item."""
    found = _bm25(spark, sf_dir, 10)
    return found.select("query_id", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


query(f"WITH {_bm25_sql('full_text', 'text', 10)} SELECT query_id, item, round(score, 6) AS score, rank FROM full_text")(bm25_top10)


@query(
    f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY ALL) GROUP BY term"
)
def term_df(spark, sf_dir):
    """12.1: document and collection frequencies of all terms."""
    postings = lexical.build_index(table(spark, sf_dir, "documents")).postings
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_GOLD} SELECT * FROM gold")
def containment_gold(spark, sf_dir):
    """7.5: which documents hold which item."""
    return _gold(spark, sf_dir)


_METRICS = """
    per AS (
        SELECT s.query_id,
               max(CASE WHEN g.item IS NOT NULL AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS hit1,
               max(CASE WHEN g.item IS NOT NULL AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS hit3,
               max(CASE WHEN g.item IS NOT NULL AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS hit5,
               sum(CASE WHEN g.item IS NOT NULL AND rank <= 5 THEN 1 ELSE 0 END) AS found5,
               min(CASE WHEN g.item IS NOT NULL THEN rank END) AS first_gold,
               sum(CASE WHEN g.item IS NOT NULL AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain
        FROM (SELECT DISTINCT query_id FROM gold) s LEFT JOIN full_text f USING (query_id) LEFT JOIN gold g ON g.query_id = f.query_id AND g.item = f.item
        GROUP BY s.query_id),
    n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
    m AS (SELECT query_id, hit1, hit3, hit5, found5 / 5.0 AS precision5, found5 / n_gold::DOUBLE AS recall5, coalesce(1.0 / first_gold, 0) AS mrr,
                 gain / list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda i: 1 / log2(i + 1))) AS ndcg5
          FROM per JOIN n USING (query_id))"""


def _per_query(spark, sf_dir):
    ranked = _bm25(spark, sf_dir).select(F.lit("bm25").alias("method"), "query_id", "item", "rank")
    return metrics.query_metrics(ranked, _gold(spark, sf_dir))


@query(
    f"WITH {_FULL}, {_GOLD}, {_METRICS} SELECT query_id, hit1, hit3, hit5, round(precision5, 6) AS precision5, round(recall5, 6) AS recall5, round(mrr, 6) AS mrr, round(ndcg5, 6) AS ndcg5 FROM m"
)
def hit_mrr_ndcg(spark, sf_dir):
    """9.2, 15.1 to 15.5: metrics of BM25 for every item with gold."""
    rounded = [F.round(c, 6).alias(c) for c in ("precision5", "recall5", "mrr", "ndcg5")]
    return _per_query(spark, sf_dir).select("query_id", "hit1", "hit3", "hit5", *rounded)


@query(
    f"""WITH {_FULL}, {_GOLD}, {_METRICS}
    SELECT CASE WHEN grouping(slice) = 1 THEN 'overall' ELSE slice END AS slice, count(*) AS n, round(avg(hit5), 6) AS hit5, round(avg(mrr), 6) AS mrr, round(avg(ndcg5), 6) AS ndcg5
    FROM (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice FROM m) GROUP BY GROUPING SETS ((), (slice))"""
)
def metrics_by_slice(spark, sf_dir):
    """8.9, 8.11, 8.13, 8.17, 15.8: overall and per-slice means in one grouping."""
    per = _per_query(spark, sf_dir)
    slices = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("slice")
    )
    means = metrics.mean_metrics(per, ["hit5", "mrr", "ndcg5"], slices)
    return means.select(F.coalesce("slice", F.lit("overall")).alias("slice"), "n", "hit5", "mrr", "ndcg5")


def _two_lists(spark, sf_dir):
    """The lexical route over whole texts and the vector route."""
    full = _bm25(spark, sf_dir).select("query_id", "item", "score", "rank", F.lit("bottom_up").alias("route"), F.lit(0).alias("list"), F.lit(1.0).alias("weight"))
    near = _dense(spark, sf_dir).select("query_id", "item", "score", "rank", F.lit("top_down").alias("route"), F.lit(1).alias("list"), F.lit(0.85).alias("weight"))
    return staged(full.unionByName(near), "two-lists")


_LISTS = f"""{_FULL}, {_DENSE},
    lists AS (SELECT query_id, item, score, rank, 'bottom_up' AS route, 0 AS list, 1.0::DOUBLE AS weight FROM full_text
              UNION ALL SELECT query_id, item, score, rank, 'top_down', 1, 0.85::DOUBLE FROM vector_hits)"""


@query(
    f"""WITH {_LISTS}, f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) AS score, min(rank) AS first FROM lists GROUP BY ALL)
    SELECT query_id, item, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f"""
)
def rrf_text(spark, sf_dir):
    """11.9, 12.17: reciprocal-rank fusion of the lexical and the vector route, ties by best rank."""
    fused = fusion.rrf(_two_lists(spark, sf_dir))
    return fused.select("query_id", "item", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_LISTS}, f AS (SELECT query_id, item, sum(weight / (10 + rank)) AS score, min({{'list': list, 'rank': rank}}) AS first FROM lists GROUP BY ALL)
    SELECT query_id, item, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM f"""
)
def weighted_rrf(spark, sf_dir):
    """12.18: weighted fusion with constant 10, ties by (list, rank)."""
    fused = fusion.weighted_rrf(_two_lists(spark, sf_dir))
    return fused.select("query_id", "item", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_LISTS}, v(variant, route) AS (VALUES {', '.join(f"('{v}', '{r}')" for v, rs in fusion.ABLATIONS.items() for r in rs)}),
    f AS (SELECT variant, query_id, item, sum(1.0 / (60 + rank)) AS score, min(rank) AS first FROM lists JOIN v USING (route) GROUP BY ALL)
    SELECT variant, query_id, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 9) DESC, first, item) AS rank FROM f)"""
)
def ablation_variants(spark, sf_dir):
    """12.20: every subset of the routes fused in one pass."""
    return fusion.ablations(_two_lists(spark, sf_dir)).select("variant", "query_id", "item", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_FULL}, v AS (SELECT query_id, source, sum(1.0 / rank) AS votes, min(rank) AS first FROM full_text JOIN documents ON doc_id = item GROUP BY ALL)
    SELECT query_id, source, round(votes, 6) AS votes, place FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(votes, 9) DESC, first, source) AS place FROM v) WHERE place <= 2"""
)
def doc_votes(spark, sf_dir):
    """8.6, 12.14: sources by the votes of their documents."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    votes = dense.doc_votes(_bm25(spark, sf_dir).join(sources, "item"), "source")
    return votes.select("query_id", "source", F.round("votes", 6).alias("votes"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_LISTS}, d AS (SELECT l.*, source FROM lists l JOIN documents ON doc_id = item),
    s AS (SELECT query_id, source FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS place FROM d WHERE list = 1 GROUP BY query_id, source) WHERE place <= 3)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank, item) AS rank FROM d JOIN s USING (query_id, source) WHERE list = 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, item) <= 10"""
)
def two_stage(spark, sf_dir):
    """12.15: documents inside the first three sources that the other list reaches."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    lists = _two_lists(spark, sf_dir).join(sources, "item")
    found = dense.two_stage(lists.where("list = 1"), lists.where("list = 0"), "source", "item", 3, 10)
    return found.select("query_id", "item", F.col("rank").cast("long").alias("rank"))


_ROUTES = f"""routes AS (
    SELECT item_id AS query_id, CASE WHEN {_any("text", text.TABLE_TERMS)} THEN 'table' WHEN {_any("text", text.HIERARCHY_TERMS)} THEN 'hierarchy'
           WHEN item_id % 4 = 0 THEN 'lexical' ELSE 'semantic' END AS text_route FROM benchmark)"""


def _routes(spark, sf_dir):
    """Text routes of the items; every fourth counts as naming a document, for want of names in the items."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), text.route("text", F.col("item_id") % 4 == 0).alias("text_route")
    )


def _features(lists, docs):
    """What the reranker knows of a candidate: its source is the first hit's, it holds a number, its place among the source's hits."""
    known = lists.select("query_id", "item", "list", "rank").join(docs, "item")
    first = known.groupBy("query_id").agg(F.min_by("source", F.struct("list", "rank")).alias("first_source"))
    best = known.groupBy("query_id", "item", "source", "is_table").agg(F.min("rank").alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("best", "item"))
    return best.join(first, "query_id").select(
        "query_id", "item", (F.col("source") == F.col("first_source")).alias("explicit_document"), "is_table", place.alias("selected_rank")
    )


@query(
    f"""WITH {_LISTS}, {_ROUTES}, k AS (SELECT query_id, item, list, rank, source, regexp_matches(text, '[0-9]{{4}}') AS is_table FROM lists JOIN documents ON doc_id = item),
    first AS (SELECT query_id, arg_min(source, {{'list': list, 'rank': rank}}) AS source FROM k GROUP BY query_id),
    best AS (SELECT query_id, item, source, is_table, min(rank) AS best FROM k GROUP BY ALL),
    feat AS (SELECT b.query_id, item, b.source = f.source AS explicit, is_table, row_number() OVER (PARTITION BY b.query_id, b.source ORDER BY best, item) AS place FROM best b JOIN first f USING (query_id)),
    c AS (SELECT query_id, item, max(CASE WHEN list = 0 THEN rank END) AS b, max(CASE WHEN list = 1 THEN rank END) AS d FROM lists WHERE rank <= 30 GROUP BY ALL),
    s AS (SELECT c.*, text_route, CASE WHEN text_route = 'lexical' THEN 1.2 ELSE 1.0 END * coalesce(1.0 / (60 + b), 0) + CASE WHEN text_route = 'semantic' THEN 1.1 ELSE 1.0 END * coalesce(1.0 / (60 + d), 0)
            + 0.5 * coalesce(explicit::INT, 0) / 61.0 + CASE WHEN text_route = 'table' THEN 0.4 * coalesce(is_table::INT, 0) / 61.0 ELSE 0 END
            + CASE WHEN text_route = 'hierarchy' THEN 0.3 * coalesce(1.0 / (60 + place), 0) ELSE 0 END AS s
          FROM c LEFT JOIN routes USING (query_id) LEFT JOIN feat USING (query_id, item))
    SELECT query_id, item, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN text_route = 'lexical' AND b = 1 THEN 1 ELSE 0 END DESC, round(s, 12) DESC, b NULLS LAST, d NULLS LAST, item) AS rank FROM s"""
)
def global_rerank(spark, sf_dir):
    """12.24: the routed reranker with document, table and hierarchy terms; lexical queries keep their best BM25 row on top."""
    lists = _two_lists(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source", F.col("text").rlike("[0-9]{4}").alias("is_table"))
    weights = fusion.RerankWeights(lexical=1.2, semantic=1.1, document=0.5, table=0.4, hierarchy=0.3)
    ranked = fusion.routed_rerank(lists.where("list = 0"), lists.where("list = 1"), _routes(spark, sf_dir), _features(lists, docs), weights)
    return ranked.select("query_id", "item", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_LISTS}, {_ROUTES}, t AS (SELECT doc_id AS item FROM documents WHERE regexp_matches(text, '[0-9]{{4}}')),
    pool AS (SELECT DISTINCT query_id, item FROM lists WHERE rank <= 5),
    n AS (SELECT query_id, count(t.item) AS support FROM pool LEFT JOIN t USING (item) GROUP BY query_id),
    g AS (SELECT query_id, text_route = 'table' OR coalesce(support, 0) >= 2 AS enabled,
                 CASE WHEN text_route = 'table' THEN 'explicit_table_intent' WHEN coalesce(support, 0) >= 2 THEN 'candidate_table_support' ELSE 'insufficient_table_support' END AS reason
          FROM routes LEFT JOIN n USING (query_id)),
    c AS (SELECT query_id, item, max(CASE WHEN list = 0 THEN rank END) AS b, max(CASE WHEN list = 1 THEN rank END) AS d FROM lists WHERE rank <= 30 GROUP BY ALL),
    s AS (SELECT c.*, coalesce(1.0 / (60 + b), 0) + coalesce(1.0 / (60 + d), 0) + CASE WHEN t.item IS NULL THEN 0 ELSE 0.25 / 61 END AS s FROM c LEFT JOIN t USING (item))
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, b NULLS LAST, d NULLS LAST, item) AS rank, enabled, reason FROM s JOIN g USING (query_id) WHERE enabled
    UNION ALL SELECT query_id, item, rank, enabled, reason FROM full_text JOIN g USING (query_id) WHERE NOT enabled"""
)
def selective_gate(spark, sf_dir):
    """12.25: BM25 unless the query asks for tables or enough candidates hold figures."""
    lists = _two_lists(spark, sf_dir)
    tables = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{4}")).select(F.col("doc_id").alias("item"))
    ranked = fusion.selective_rerank(lists.where("list = 0"), lists.where("list = 1"), _routes(spark, sf_dir), tables)
    return ranked.select("query_id", "item", F.col("rank").cast("long").alias("rank"), "enabled", "reason")


@query(
    """
    WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
               FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """
)
def dense_top10(spark, sf_dir):
    """10.1, 12.6, 12.28: exact search; every row whose id is divisible by 20 is a query, taken in blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = dense.dense_top_k_blocked(vectors, queries, 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LABELS = "(SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels)"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))


@query(
    f"""
    WITH p AS (SELECT count(*) AS n, avg((a = b)::INT) AS e, avg((a = '0')::INT) AS a0, avg((a = '1')::INT) AS a1, avg((b = '0')::INT) AS b0, avg((b = '1')::INT) AS b1 FROM {_LABELS}),
         c AS (SELECT *, a0 * b0 + a1 * b1 AS k, (a0 + b0) / 2 * (1 - (a0 + b0) / 2) + (a1 + b1) / 2 * (1 - (a1 + b1) / 2) AS g FROM p)
    SELECT n, round(e, 6) AS exact, round((e - k) / (1 - k), 6) AS kappa, round((e - g) / (1 - g), 6) AS ac1 FROM c
    """
)
def kappa_ac1(spark, sf_dir):
    """16.9: agreement of two label columns read as two reviewers."""
    found = stats.agreement(_pairs(spark, sf_dir), ["0", "1"])
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("exact", "kappa", "ac1")])


@query(
    f"WITH c(v) AS (VALUES ('0'), ('1')) SELECT x.v AS a, y.v AS b, count(p.a) AS n FROM c x CROSS JOIN c y LEFT JOIN {_LABELS} p ON p.a = x.v AND p.b = y.v GROUP BY ALL"
)
def confusion(spark, sf_dir):
    """8.12: the confusion matrix, zeros included."""
    return stats.confusion(_pairs(spark, sf_dir), ["0", "1"])


@query(
    f"""
    WITH c AS (SELECT count_if(a = '1' AND b = '1') AS n_both, count_if(a = '1' AND b != '1') AS only_a, count_if(a != '1' AND b = '1') AS only_b, count_if(a != '1' AND b != '1') AS neither FROM {_LABELS})
    SELECT n_both::BIGINT AS n_both, only_a::BIGINT AS only_a, only_b::BIGINT AS only_b, neither::BIGINT AS neither,
           round(2.0 * n_both / nullif(2 * n_both + only_a + only_b, 0), 6) AS positive_agreement,
           round(2.0 * neither / nullif(2 * neither + only_a + only_b, 0), 6) AS negative_agreement FROM c
    """
)
def binary_agreement(spark, sf_dir):
    """16.10: the 2x2 table with positive and negative agreement."""
    found = stats.binary_agreement(_pairs(spark, sf_dir), "1")
    parts = [F.round(c, 6).alias(c) for c in ("positive_agreement", "negative_agreement")]
    return found.select(F.col("both").alias("n_both"), "only_a", "only_b", "neither", *parts)


def _user_pairs(spark, sf_dir):
    """Per event type: whether a user had one above 50 in the first and in the second half of a day."""
    half = F.hour("ts") >= 12
    high = F.col("value") > 50
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("label"), F.col("user_id").alias("unit"))
        .agg(
            F.max(F.when(half & high, 1).otherwise(0)).alias("treatment"),
            F.max(F.when(~half & high, 1).otherwise(0)).alias("baseline"),
            F.avg("value").alias("value"),
        )
    )


@query(
    """
    WITH u AS (SELECT event_type AS label, user_id, max(CASE WHEN hour(ts) >= 12 AND value > 50 THEN 1 ELSE 0 END) AS t, max(CASE WHEN hour(ts) < 12 AND value > 50 THEN 1 ELSE 0 END) AS b FROM events GROUP BY ALL),
         c AS (SELECT label, count_if(t > b)::BIGINT AS improvements, count_if(t < b)::BIGINT AS regressions FROM u GROUP BY label)
    SELECT label, improvements, regressions, improvements + regressions AS discordant,
           round(CASE WHEN improvements + regressions = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(improvements, regressions) + 1),
             lambda i: exp(lgamma(improvements + regressions + 1) - lgamma(i + 1) - lgamma(improvements + regressions - i + 1) - (improvements + regressions) * ln(2))))) END, 6) AS p_value
    FROM c
    """
)
def mcnemar_exact(spark, sf_dir):
    """16.6: the exact binomial test on discordant pairs."""
    found = stats.mcnemar(_user_pairs(spark, sf_dir))
    return found.select("label", "improvements", "regressions", "discordant", F.round("p_value", 6).alias("p_value"))


@query(
    """
    WITH t AS (SELECT 'nation' AS family, c_nationkey AS test, least(1.0, 1.0 / (1 + count(*) % 97)) AS p_value FROM customer GROUP BY c_nationkey),
         r AS (SELECT *, least(1.0, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, test) + 1)) AS raw FROM t)
    SELECT family, test, round(p_value, 6) AS p_value, round(max(raw) OVER (ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r
    """
)
def holm_correction(spark, sf_dir):
    """16.8: step-down correction inside a family."""
    tests = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("test")).agg(
        F.least(F.lit(1.0), 1.0 / (1 + F.count(F.lit(1)) % 97)).alias("p_value")
    ).withColumn("family", F.lit("nation"))
    found = stats.holm(tests)
    return found.select("family", "test", F.round("p_value", 6).alias("p_value"), F.round("p_holm", 6).alias("p_holm"))


@query()
def wilcoxon_signed_rank(spark, sf_dir):
    """16.7: tie-corrected signed-rank test of the two halves of the day."""
    return stats.wilcoxon(_user_pairs(spark, sf_dir))


@query()
def bootstrap_intervals(spark, sf_dir):
    """16.1, 16.3: hash-resampled intervals of per-nation balances."""
    values = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("value")
    )
    return stats.bootstrap_means(values, iterations=10_000)
