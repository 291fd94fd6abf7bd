"""Queries of the text and identifier functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import ids, text
from quillgraph.plans.registry import query, table

TOKENS = "regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[a-z0-9]+')"
_T = TOKENS.format("text")
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _norm(column: str) -> str:
    return f"array_to_string({TOKENS.format(column)}, ' ')"


def _any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(' ' || {_norm(column)} || ' ', ' {t} ')" for t in terms) + ")"


@query(f"SELECT doc_id, len({_T})::BIGINT AS n_tokens, md5(array_to_string({_T}, ' ')) AS tokens_md5 FROM documents")
def tokenize_stats(spark, sf_dir):
    """5.2, 5.3: tokens of every document."""
    tokens = text.tokenize("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


@query(
    "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\([^)]*\\)', '', 'g'),"
    " '[^a-z0-9]+', ' ', 'g'))) AS alias_md5 FROM documents"
)
def normalized_aliases(spark, sf_dir):
    """5.1: alias normalisation."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_alias("text")).alias("alias_md5"))


@query(
    f"SELECT doc_id, len(list_distinct(list_filter({_T}, lambda t: len(t) > 1 AND NOT list_contains({_STOPS}, t))))::BIGINT AS words,"
    f" len(list_distinct(list_filter({_T}, lambda t: len(t) > 2)))::BIGINT AS significant FROM documents"
)
def word_sets(spark, sf_dir):
    """5.5, 5.6: stop-worded and significant word sets."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(text.word_set("text")).cast("long").alias("words"),
        F.size(text.significant_words("text")).cast("long").alias("significant"),
    )


@query(
    f"SELECT item_id, CASE WHEN {_any('text', text.TABLE_TERMS)} THEN 'table'"
    f" WHEN {_any('text', text.HIERARCHY_TERMS)} THEN 'hierarchy' ELSE 'semantic' END AS text_route,"
    f" {_any('text', text.GRAPH_TERMS)} AS graph_enabled FROM benchmark"
)
def query_routes(spark, sf_dir):
    """5.13, 5.15: the route of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        "item_id", text.route("text").alias("text_route"), text.wants_graph("text").alias("graph_enabled")
    )


@query(
    f"""
    WITH s AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
         w AS (SELECT conv_id, turn,
                      list_distinct(list_filter({TOKENS.format('text')}, lambda t: len(t) > 2)) AS a,
                      list_distinct(list_filter({TOKENS.format('before')}, lambda t: len(t) > 2)) AS b FROM s WHERE before IS NOT NULL)
    SELECT conv_id, turn,
           CASE WHEN len(a) + len(b) = 0 THEN 0.0
                ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS jaccard,
           CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
                ELSE round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) END AS f1
    FROM w
    """
)
def turn_overlap(spark, sf_dir):
    """5.17, 5.20: overlap of each turn with the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    a, b = text.significant_words("text"), text.significant_words("before")
    return rows.select("conv_id", "turn", F.round(text.jaccard(a, b), 6).alias("jaccard"), F.round(text.set_f1(a, b), 6).alias("f1"))


@query(
    """
    WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
         b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM a),
         c AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM b),
         d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM c),
         e AS (SELECT page_id, trim(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t FROM d)
    SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM e
    """
)
def html_to_text(spark, sf_dir):
    """4.12: visible text of pages."""
    visible = text.html_text("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(visible).cast("long").alias("n_chars"), F.md5(visible).alias("text_md5")
    )


@query(
    """
    SELECT p_partkey,
           'api:' || CASE WHEN n <> '' THEN replace(n, ' ', '-') ELSE left(sha256(coalesce(p_name, '')), 20) END AS node_id,
           'P-' || upper(left(sha256('7:' || p_partkey || ':' || p_name), 8)) AS blind_id,
           left(sha256(p_name), 12) AS run_id
    FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(p_name, '')), '\\([^)]*\\)', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n FROM part)
    """
)
def stable_ids(spark, sf_dir):
    """6.2, 6.3, 6.4, 6.14: surrogate, blind and run ids."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        ids.surrogate_id("api", "p_name").alias("node_id"),
        ids.blind_id("7", "p_partkey", "p_name").alias("blind_id"),
        ids.run_id("p_name").alias("run_id"),
    )


@query(
    """
    SELECT item_id, row_number() OVER (ORDER BY sha256('review:' || item_id), item_id) AS place FROM benchmark
    """
)
def hash_shuffle(spark, sf_dir):
    """6.5: a reproducible shuffle; the benchmark is a fixed small list."""
    order = Window.orderBy(ids.hash_order("review", "item_id"), "item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", F.row_number().over(order).cast("long").alias("place"))


@query(
    """
    SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name
    FROM events, (SELECT unnest(['page', 'ref', 'k']) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL
    """
)
def event_properties(spark, sf_dir):
    """6.9: named JSON properties as rows."""
    names = F.array(*[F.lit(k) for k in ("page", "ref", "k")])
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(names).alias("name"), "props")
    value = F.coalesce(*[F.when(F.col("name") == k, F.get_json_object("props", f"$.{k}")) for k in ("page", "ref", "k")])
    return rows.select("event_id", value.alias("value"), "name").where("value IS NOT NULL")
