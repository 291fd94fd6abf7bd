"""Rank fusion and gated reranking (inventory 12.17 to 12.25).

Rankings are long tables ``query_id, route, item, rank``; a route's order is its
``rank``, never the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import reciprocal_rank


def rrf(rankings: DataFrame, constant: int = 60, ties: str = "rank", limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, item, score, rank``.

    ``ties="rank"`` breaks ties by the best rank, then id; ``ties="list"`` by
    the first list that holds the item (column ``list``) and its rank there.
    """
    first = F.min("rank") if ties == "rank" else F.min(F.struct("list", "rank"))
    fused = rankings.groupBy("query_id", "item").agg(F.sum(reciprocal_rank("rank", constant)).alias("score"), first.alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first", "item")
    out = fused.withColumn("rank", F.row_number().over(order)).drop("first")
    return out.where(F.col("rank") <= limit) if limit else out


def weighted_rrf(rankings: DataFrame, constant: int = 10) -> DataFrame:
    """Fusion with a ``weight`` per list; ties by (list, rank)."""
    fused = rankings.groupBy("query_id", "item").agg(
        F.sum(F.col("weight") * reciprocal_rank("rank", constant)).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def source_group_rrf(scored: DataFrame, constant: int = 60) -> DataFrame:
    """Ranks inside each ``source`` by score, then fuses the sources; rows ``query_id, source, item, score, position``."""
    inside = Window.partitionBy("query_id", "source").orderBy(F.round("score", 9).desc(), "position")
    ranked = scored.select("query_id", "item", "source", "position", F.row_number().over(inside).alias("rank"))
    fused = ranked.groupBy("query_id", "item").agg(F.sum(reciprocal_rank("rank", constant)).alias("score"), F.min("position").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first", "item")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


#: The route subsets of the ablation study (fixed values).
ABLATIONS = {
    "bottom_up": ("bottom_up",),
    "top_down": ("top_down",),
    "graph_path": ("graph_path",),
    "bottom_up+top_down": ("bottom_up", "top_down"),
    "bottom_up+graph_path": ("bottom_up", "graph_path"),
    "top_down+graph_path": ("top_down", "graph_path"),
    "three_path": ("bottom_up", "top_down", "graph_path"),
}


def ablations(rankings: DataFrame) -> DataFrame:
    """All route subsets fused at once: adds ``variant``."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(r).alias("of")) for v, rs in ABLATIONS.items() for r in rs])
    spread = rankings.withColumn("pair", F.explode(F.filter(pairs, lambda p: p["of"] == F.col("route")))).select(
        F.col("pair.variant").alias("variant"), "query_id", "item", "rank"
    )
    fused = spread.groupBy("variant", "query_id", "item").agg(F.sum(reciprocal_rank("rank")).alias("score"), F.min("rank").alias("first"))
    order = Window.partitionBy("variant", "query_id").orderBy(F.round("score", 9).desc(), "first", "item")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


@dataclass(frozen=True)
class RerankWeights:
    """Weights of the routed reranker."""

    lexical: float = 1.0
    semantic: float = 1.0
    document: float = 0.0
    table: float = 0.0
    hierarchy: float = 0.0


def _candidates(bm25: DataFrame, dense: DataFrame, depth: int) -> DataFrame:
    left = bm25.where(F.col("rank") <= depth).select("query_id", "item", F.col("rank").alias("bm25_rank"))
    right = dense.where(F.col("rank") <= depth).select("query_id", "item", F.col("rank").alias("dense_rank"))
    return left.join(right, ["query_id", "item"], "full_outer")


def _ranked(scored: DataFrame, first: Column | None = None) -> DataFrame:
    order = [F.round("score", 12).desc(), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), F.col("item")]
    if first is not None:
        order = [first.desc(), *order]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def routed_rerank(
    bm25: DataFrame, dense: DataFrame, routes: DataFrame, features: DataFrame, weights: RerankWeights = RerankWeights(), depth: int = 30
) -> DataFrame:
    """The union of both top lists, scored by route.

    ``routes``: ``query_id, text_route``. ``features``: ``query_id, item,
    explicit_document, is_table, selected_rank`` for candidates that have any.
    A lexical weight over 1 keeps the best BM25 row of lexical queries on top.
    """
    rows = _candidates(bm25, dense, depth).join(routes, "query_id", "left").join(features, ["query_id", "item"], "left")
    on = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    lexical, semantic = F.col("text_route") == "lexical", F.col("text_route") == "semantic"
    scored = rows.withColumn(
        "score",
        F.when(lexical, weights.lexical).otherwise(1.0) * reciprocal_rank("bm25_rank")
        + F.when(semantic, weights.semantic).otherwise(1.0) * reciprocal_rank("dense_rank")
        + weights.document * on("explicit_document") / 61.0
        + F.when(F.col("text_route") == "table", weights.table * on("is_table") / 61.0).otherwise(0.0)
        + F.when(F.col("text_route") == "hierarchy", weights.hierarchy * reciprocal_rank("selected_rank")).otherwise(0.0),
    )
    protect = (lexical & (F.col("bm25_rank") == 1)).cast("int") if weights.lexical > 1 else None
    return _ranked(scored, F.coalesce(protect, F.lit(0)) if protect is not None else None).select(
        "query_id", "item", "bm25_rank", "dense_rank", "score", "rank"
    )


def selective_rerank(
    bm25: DataFrame,
    dense: DataFrame,
    routes: DataFrame,
    tables: DataFrame,
    depth: int = 30,
    support_depth: int = 5,
    threshold: int = 2,
    table_weight: float = 0.25,
) -> DataFrame:
    """BM25 as it is unless the query asks for tables or enough candidates are tables.

    ``tables`` has the ids (``item``) of table chunks. The result says whether
    the gate was ``enabled`` and why.
    """
    flags = tables.select("item").distinct().withColumn("is_table", F.lit(1))
    pool = _candidates(bm25, dense, support_depth).join(flags, "item", "left")
    support = pool.groupBy("query_id").agg(F.count("is_table").alias("support"))
    gate = (
        routes.join(support, "query_id", "left")
        .withColumn("intent", F.col("text_route") == "table")
        .withColumn("enabled", F.col("intent") | (F.coalesce("support", F.lit(0)) >= threshold))
        .withColumn(
            "reason",
            F.when(F.col("intent"), "explicit_table_intent")
            .when(F.col("enabled"), "candidate_table_support")
            .otherwise("insufficient_table_support"),
        )
        .select("query_id", "enabled", "reason")
    )
    fused = (
        _candidates(bm25, dense, depth)
        .join(flags, "item", "left")
        .withColumn(
            "score",
            reciprocal_rank("bm25_rank") + reciprocal_rank("dense_rank") + table_weight * F.coalesce("is_table", F.lit(0)) / 61.0,
        )
    )
    on = _ranked(fused).select("query_id", "item", "rank").join(gate.where("enabled"), "query_id")
    off = bm25.select("query_id", "item", "rank").join(gate.where("NOT enabled"), "query_id")
    return on.unionByName(off)


@dataclass(frozen=True)
class AdaptiveWeights:
    """Weights of the gated three-route fusion."""

    constant: int = 60
    bottom_up: float = 1.0
    top_down: float = 1.0
    graph: float = 0.35
    document_boost: float = 0.006
    table_boost: float = 0.004
    heading_boost: float = 0.003
    retain: int = 1


def graph_gate(queries: DataFrame) -> DataFrame:
    """Adds ``graph_on`` and ``gate_reason``; the first rule that holds decides.

    Needs ``structured`` and ``graph_rows`` (counts), ``anchor_labels``,
    ``reachable_documents``, ``selected_documents`` and ``explicit_documents``.
    """
    has = lambda label: F.array_contains("anchor_labels", label)
    entity = F.arrays_overlap("anchor_labels", F.array(*[F.lit(x) for x in ("Drug", "DrugShortage", "Ingredient", "Manufacturer", "NDC")]))
    text_docs = F.array_union("selected_documents", "explicit_documents")
    reason = (
        F.when(F.col("structured") > 0, "direct_structured_record")
        .when((F.size("anchor_labels") == 0) | (F.col("graph_rows") == 0), "no_qualified_graph_anchor")
        .when(has("RegulatoryDocument"), "explicit_regulatory_document_anchor")
        .when(has("RegulatoryTopic") & F.arrays_overlap("reachable_documents", text_docs), "topic_path_agrees_with_text_route")
        .when(entity & F.arrays_overlap("reachable_documents", "selected_documents"), "entity_path_agrees_with_text_route")
        .otherwise("graph_path_lacks_text_route_agreement")
    )
    off = ("no_qualified_graph_anchor", "graph_path_lacks_text_route_agreement")
    return queries.withColumn("gate_reason", reason).withColumn("graph_on", ~F.col("gate_reason").isin(*off))


def adaptive_rank(rankings: DataFrame, gates: DataFrame, boosts: DataFrame, weights: AdaptiveWeights = AdaptiveWeights(), top_k: int = 5) -> DataFrame:
    """Gated fusion of the routes bottom_up, top_down and graph_path.

    ``gates``: ``query_id, graph_on``. ``boosts``: ``query_id, item,
    explicit_document, table_match`` (booleans) and ``overlap``. Only positive
    scores are ranked; then the best row of each text route is kept inside the
    first ``top_k`` in place of the weakest row that is not kept itself.
    """
    weight = (
        F.when(F.col("route") == "bottom_up", weights.bottom_up)
        .when(F.col("route") == "top_down", weights.top_down)
        .otherwise(F.when(F.col("graph_on"), weights.graph).otherwise(0.0))
    )
    text = F.col("route").isin("bottom_up", "top_down")
    fused = (
        rankings.join(gates.select("query_id", "graph_on"), "query_id")
        .groupBy("query_id", "item")
        .agg(
            F.sum(F.when(weight > 0, weight * reciprocal_rank("rank", weights.constant)).otherwise(0.0)).alias("base"),
            F.min("rank").alias("first"),
            F.max(text | F.col("graph_on")).alias("boosted"),
            F.max(text & (F.col("rank") <= weights.retain)).alias("required"),
        )
        .join(boosts, ["query_id", "item"], "left")
    )
    boost = (
        F.when(F.col("explicit_document"), weights.document_boost).otherwise(0.0)
        + F.when(F.col("table_match"), weights.table_boost).otherwise(0.0)
        + weights.heading_boost * F.coalesce("overlap", F.lit(0.0))
    )
    scored = fused.withColumn("score", F.col("base") + F.when(F.col("boosted"), boost).otherwise(0.0)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", "item")
    ranked = scored.withColumn("rank", F.row_number().over(order)).select("query_id", "item", "score", "rank", "required")
    return _retained(ranked, top_k)


def _retained(ranked: DataFrame, top_k: int) -> DataFrame:
    """Rankings with the ``required`` rows beyond ``top_k`` swapped in for the weakest rows that aren't required.

    The i-th such row takes the place of the i-th weakest; what is displaced
    follows right behind the first ``top_k``, the last one displaced first.
    """
    head, query = F.col("rank") <= top_k, Window.partitionBy("query_id")
    spare, want = head & ~F.col("required"), ~head & F.col("required")
    marked = (
        ranked.withColumn("kind", F.when(spare, "spare").when(want, "want").otherwise("stay"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.when(spare, F.round("score", 12)).otherwise(F.col("rank")), "item")))
        .withColumn("swaps", F.least(F.coalesce(F.max(F.when(spare, F.col("nth"))).over(query), F.lit(0)), F.coalesce(F.max(F.when(want, F.col("nth"))).over(query), F.lit(0))))
        .withColumn("moves", F.col("kind").isin("spare", "want") & (F.col("nth") <= F.col("swaps")))
    )
    gaps = marked.where("moves AND kind = 'spare'").select("query_id", "nth", F.col("rank").alias("gap"))
    placed = marked.join(gaps, ["query_id", "nth"], "left").withColumn(
        "place",
        F.when(F.col("moves") & (F.col("kind") == "want"), F.struct(F.lit(0).alias("part"), F.col("gap").alias("at")))
        .when(F.col("moves"), F.struct(F.lit(1).alias("part"), (-F.col("nth")).alias("at")))
        .when(head, F.struct(F.lit(0).alias("part"), F.col("rank").alias("at")))
        .otherwise(F.struct(F.lit(2).alias("part"), F.col("rank").alias("at"))),
    )
    order = Window.partitionBy("query_id").orderBy("place")
    return placed.select("query_id", "item", "score", F.row_number().over(order).alias("rank"), (F.col("moves") & (F.col("kind") == "want")).alias("retained"))
