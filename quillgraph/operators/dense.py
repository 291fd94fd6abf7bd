"""Exact dense search by inner product (inventory 12.5 to 12.15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot
from quillgraph.operators.lexical import top_k


def embed(df: DataFrame, text_col: str, embed_texts: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """Adds vectors from a function of a list of texts, called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embed_texts(texts.fillna("").tolist()), np.float32)))

    return df.withColumn(out, run(F.col(text_col)))


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of every pair; ``queries`` is a stated small set of (query_id, query_vector)."""
    return vectors.crossJoin(F.broadcast(queries)).select(
        "query_id", "vec_id", dot(F.col("embedding"), F.col("query_vector")).alias("score")
    )


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` vectors of each query; ties by id. Built-in functions only."""
    return top_k(dense_scores(vectors, queries), k, item="vec_id")


def dense_top_k_blocked(vectors: DataFrame, queries: DataFrame, k: int, chunk_rows: int = 65_536, block_rows: int = 4_096) -> DataFrame:
    """As ``dense_top_k`` for many queries (``query_id, query_vector``): blocks of queries meet chunks of vectors.

    Both sides are dealt by a hash of the id into groups of about ``chunk_rows``
    and ``block_rows``. Every chunk meets every block in a task of its own, as
    one matrix product, which leaves at most ``k`` candidates a query; the last
    step ranks them. Nothing is collected but two counts, and no task holds
    more than a chunk, a block and a strip of their product. Null vectors match
    nothing.
    """
    vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    queries = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector")
    chunks, blocks = -(-vectors.count() // chunk_rows) or 1, -(-queries.count() // block_rows) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))

    def meet(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if found.empty or wanted.empty:
            return out
        ids, data = found["vec_id"].to_numpy(), np.stack(found["embedding"].to_numpy()).astype(np.float64)
        parts = []
        for i in range(0, len(wanted), 256):  # a strip of the product at a time
            strip = wanted.iloc[i : i + 256]
            scores = np.stack(strip["query_vector"].to_numpy()).astype(np.float64) @ data.T
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.round(9)), axis=1)[:, :k]
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(strip["query_id"].to_numpy(), order.shape[1]),
                        "vec_id": ids[order].ravel(),
                        "score": np.take_along_axis(scores, order, 1).ravel(),
                    }
                )
            )
        return pd.concat(parts)

    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}"]
    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(meet, ", ".join([*kinds, "score double"]))
    return top_k(met, k, item="vec_id")


def dedupe_ranking(hits: DataFrame, item: str, limit: int | None = None) -> DataFrame:
    """Hits with repeated items (``query_id, item, rank``) to one rank per item, by first appearance."""
    first = hits.groupBy("query_id", item).agg(F.min("rank").alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", item))).drop("first")
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def best_per_item(hits: DataFrame, item: str) -> DataFrame:
    """The hit with the largest score of each item, the earlier on a tie; ranked by score, then old rank."""
    best = hits.groupBy("query_id", item).agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.col("best.score").desc(), F.col("best.r").desc(), item)
    return best.select("query_id", item, F.col("best.score").alias("score"), F.row_number().over(order).alias("rank"))


def doc_votes(hits: DataFrame, doc: str = "doc_id", budget: int = 2) -> DataFrame:
    """Documents by the sum of 1/rank over their hits; ties by first appearance."""
    votes = hits.groupBy("query_id", doc).agg(
        F.sum(1.0 / F.greatest(F.lit(1), F.col("rank"))).alias("votes"), F.min("rank").alias("first")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("votes", 9).desc(), "first", doc)
    return votes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)


def two_stage(document_hits: DataFrame, chunk_hits: DataFrame, doc: str, item: str, budget: int, k: int) -> DataFrame:
    """Chunk hits inside the first ``budget`` documents by appearance, ranked anew."""
    seen = document_hits.groupBy("query_id", doc).agg(F.min("rank").alias("first"))
    kept = seen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", doc))).where(
        F.col("place") <= budget
    )
    inside = chunk_hits.join(kept.select("query_id", doc), ["query_id", doc], "left_semi")
    return dedupe_ranking(inside, item, k)
