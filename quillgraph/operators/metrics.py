"""Ranking metrics and failure analysis (inventory section 15).

Rankings are ``method, query_id, item, rank``; gold is ``query_id, item``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_ranks(rankings: DataFrame) -> DataFrame:
    """Repeated items keep their first place and the rest moves up."""
    first = rankings.groupBy("method", "query_id", "item").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("method", "query_id").orderBy("first", "item")
    return first.withColumn("rank", F.row_number().over(order)).drop("first")


def _ideal(k: int, gold: Column) -> Column:
    steps = F.sequence(F.lit(1), F.least(F.lit(k), gold).cast("int"))
    return F.when(gold == 0, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)))


def query_metrics(rankings: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5), ndcg_at: int = 5) -> DataFrame:
    """One row per method and query with gold: hit, precision and recall at each k, mrr, ndcg, first gold rank.

    Queries that a method returns nothing for score zero. Precision counts an
    item once however often it is ranked; recall is over distinct gold.
    """
    golds = gold.select("query_id", "item").distinct()
    sizes = golds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    methods = rankings.select("method").distinct()
    marked = rankings.join(golds.withColumn("is_gold", F.lit(True)), ["query_id", "item"], "left").withColumn(
        "is_gold", F.coalesce("is_gold", F.lit(False))
    )
    first_time = F.row_number().over(Window.partitionBy("method", "query_id", "item").orderBy("rank")) == 1
    marked = marked.withColumn("counts", F.col("is_gold") & first_time)
    hit = lambda k: F.max(F.when(F.col("is_gold") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"hit{k}")
    found = lambda k: F.sum(F.when(F.col("counts") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"found{k}")
    gain = F.when(F.col("counts") & (F.col("rank") <= ndcg_at), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = marked.groupBy("method", "query_id").agg(
        *[hit(k) for k in ks],
        *[found(k) for k in ks],
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_gold"),
        F.sum(gain).alias("gain"),
    )
    # methods are a handful of names
    full = sizes.crossJoin(F.broadcast(methods)).join(per, ["method", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return full.select(
        "method",
        "query_id",
        *[zero(F.col(f"hit{k}")).alias(f"hit{k}") for k in ks],
        *[zero(F.col(f"found{k}") / k).alias(f"precision{k}") for k in ks],
        *[zero(F.col(f"found{k}") / F.col("n_gold")).alias(f"recall{k}") for k in ks],
        zero(1.0 / F.col("first_gold")).alias("mrr"),
        zero(F.col("gain") / _ideal(ndcg_at, F.col("n_gold"))).alias(f"ndcg{ndcg_at}"),
        "first_gold",
    )


def mean_metrics(per_query: DataFrame, names: list[str], slices: DataFrame | None = None, places: int = 6) -> DataFrame:
    """Means by method and, in the same pass, by method and slice (``slice`` null: overall)."""
    rows = per_query if slices is None else per_query.join(slices, "query_id", "left")
    if slices is None:
        rows = rows.withColumn("slice", F.lit(None).cast("string"))
        return rows.groupBy("method").agg(
            F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), places).alias(n) for n in names]
        )
    sets = rows.groupingSets([[F.col("method")], [F.col("method"), F.col("slice")]], F.col("method"), F.col("slice"))
    return sets.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), places).alias(n) for n in names])


def failure_taxonomy(per_query: DataFrame, fused: str, parts: list[str], gold_docs: DataFrame, ranked_docs: DataFrame, k: int = 5) -> DataFrame:
    """Why a fused ranking misses: diluted by fusion, missed inside the right document, or routed wrong.

    ``gold_docs``: ``query_id, doc``. ``ranked_docs``: ``query_id, doc`` of the
    fused top k.
    """
    hit = f"hit{k}"
    wide = per_query.groupBy("query_id").agg(
        F.max(F.when(F.col("method") == fused, F.col(hit))).alias("fused_hit"),
        F.max(F.when(F.col("method").isin(*parts), F.col(hit))).alias("part_hit"),
    )
    near = gold_docs.join(ranked_docs.distinct(), ["query_id", "doc"], "left_semi").select("query_id").distinct()
    return wide.join(near.withColumn("near", F.lit(True)), "query_id", "left").select(
        "query_id",
        F.when(F.col("fused_hit") == 1, "hit")
        .when(F.col("part_hit") == 1, "fusion_dilution")
        .when(F.col("near"), "within_document_miss")
        .otherwise("routing_miss")
        .alias("failure"),
    )


def contiguous(needle: Column, haystack: Column) -> Column:
    """Whether an array occurs in another as a run; an empty one doesn't."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(haystack) - F.size(needle) + 1))
    inside = F.exists(starts, lambda i: F.slice(haystack, i, F.greatest(F.size(needle), F.lit(1))) == needle)
    return (F.size(needle) > 0) & (F.size(needle) <= F.size(haystack)) & inside


def evaluate_method(queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], gold: DataFrame, method: str, k: int = 60) -> DataFrame:
    """Metrics of an injected retrieval: a function of the queries and a depth that gives ``query_id, item, rank``."""
    ranked = retrieve(queries, k).where(F.col("rank") <= k)
    return query_metrics(ranked.select(F.lit(method).alias("method"), "query_id", "item", "rank"), gold)
