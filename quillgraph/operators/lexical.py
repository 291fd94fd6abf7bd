"""BM25 over a postings table (inventory 12.1 to 12.3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import tokenize
from quillgraph.scratch import spread, staged

K1, B = 1.2, 0.75


@dataclass
class Bm25Index:
    """Term occurrences ``doc, len, term``, postings with ``tf``, frequencies ``term, df`` and totals ``n, avg_len``."""

    terms: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def build_index(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int | None = None) -> Bm25Index:
    """The index of a corpus; ``max_chars`` cuts texts as one of the two known variants does.

    Texts are tokenised once, into a table of the shared folder that postings,
    lengths and totals are read from.
    """
    text = F.left(F.col(text_col), F.lit(max_chars)) if max_chars else F.col(text_col)
    tokens = staged(spread(chunks.select(F.col(id_col).alias("doc"), text.alias("text"))).select("doc", tokenize("text").alias("tokens")), "bm25-tokens")
    sized = tokens.withColumn("len", F.size("tokens"))
    terms = sized.select("doc", "len", F.explode("tokens").alias("term"))
    postings = terms.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return Bm25Index(terms, postings, frequencies, totals)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``query_id, term, times``: a term counts as often as the query has it."""
    return (
        queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(text_col)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def bm25_scores(index: Bm25Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc, score`` for every document that shares a term with the query.

    Occurrences are cut to the query terms before anything is counted, so only
    hits are shuffled; the postings that are left are staged, as their document
    frequencies and their scores both read them.
    """
    wanted = terms.select("term").distinct()
    hits = staged(
        index.terms.join(wanted, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "bm25-hits"
    )
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(index.totals))  # totals are one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / norm
    return hits.join(weights, "term").groupBy("query_id", "doc").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query_id", item: str = "doc", places: int | None = 9) -> DataFrame:
    """Adds ``rank`` (from 1) and keeps the first ``k`` of each query: score, then id.

    Scores are compared at ``places`` decimals, as sums of doubles may differ
    in the last bit with the order of addition.
    """
    value = F.round("score", places) if places is not None else F.col("score")
    order = Window.partitionBy(by).orderBy(value.desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_rank(index: Bm25Index, queries: DataFrame, limit: int = 60, **columns: str) -> DataFrame:
    """The best ``limit`` documents of each query with a positive score."""
    return top_k(bm25_scores(index, query_terms(queries, **columns)), limit).where("score > 0")
