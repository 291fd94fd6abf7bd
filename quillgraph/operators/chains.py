"""Chains of relations: connected edge sets around a question's anchors, their features and rankings (14.6 to 14.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize, set_f1
from quillgraph.operators.graph import longest_spans, phrase_hits
from quillgraph.scratch import staged

# Phrases that speak of a relation, words that say nothing, weights and limits.
RELATION_ALIASES = {
    "AFFECTS_NDC_PRODUCT": ("affects ndc product", "package ndc", "ndc product"),
    "REPORTED_BY": ("reported by", "company reported", "reported"),
    "HAS_ACTIVE_INGREDIENT": ("has active ingredient", "active ingredient", "ingredient"),
    "CONTAINS_API": ("contains api", "linked api", "api is linked"),
    "SUPPLIED_BY": ("supplied by", "manufacturers supply", "manufacturer supply", "suppliers", "supplier"),
    "COVERS_TOPIC": ("covers topic", "topic does", "topic is", "linked topic"),
    "SUPERSEDES": ("supersedes", "superseding", "replaces", "replacement"),
    "USES_PRINCIPLES_FROM": ("uses principles from", "source of principles", "principle dependencies", "supplies principles", "foundation"),
    "COMPLEMENTS": ("complements", "complementary", "complement"),
    "INTERPRETS": ("interprets", "interpreted by", "interpretation"),
    "APPLIES_DEFINITION_FROM": ("applies definition from", "source of applied definitions", "applied definitions"),
    "REQUIRES_COMPLIANCE_WITH": ("requires compliance with", "ensure full compliance", "compliance with", "direct readers to consult"),
}
STOP_WORDS = (
    "a an and are as at be both by does for from how in is it of on or that the their "
    "then this through to was what when which who with"
).split()
ALIAS_PROPERTIES = ("doc_id", "package_ndc", "generic_name", "ingredient_name", "company_name", "reference_name", "topic_name", "cas")
EQUIVALENT_ALIASES = {"ema gmp annex 11": ("eu gmp annex 11", "eudralex volume 4 annex 11")}
WEIGHTS = {"node_token_f1": 1.0, "provenance": 0.1, "extra_edge": -0.02, "relation_coverage": 2.0, "relation_precision": 0.5, "orientation": 0.5}
MAX_EDGES, MAX_CANDIDATES, MAX_ATTEMPTS = 5, 50_000, 2_000_000


def node_aliases(nodes: DataFrame) -> DataFrame:
    """``id, alias``: what a node answers to: its name, what follows the kind in its id, and some properties, with their equivalents.

    Aliases are words joined by one space; those with fewer than three letters and digits go.
    """
    said = [F.col("name"), F.regexp_extract("id", "^[^:]*:(.*)$", 1), *[F.get_json_object("properties", f"$.{p}") for p in ALIAS_PROPERTIES]]
    rows = nodes.select("id", F.explode(F.array(*[normalize(c) for c in said])).alias("alias")).where(F.length(F.replace("alias", F.lit(" "), F.lit(""))) >= 3)
    same = F.create_map(*[x for k, v in EQUIVALENT_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    more = rows.select("id", F.explode(same[F.col("alias")]).alias("alias"))
    return rows.unionByName(more).distinct()


def relation_cues(questions: DataFrame) -> DataFrame:
    """``query_id, cues``: relations that a question (``query_id, question``) speaks of, by the longest phrases that don't overlap."""
    spark = questions.sparkSession
    rows = [(a, len(a.split()), r) for r, aliases in RELATION_ALIASES.items() for a in aliases]
    aliases = spark.createDataFrame(rows, "alias string, n_words int, relation string")
    spans = longest_spans(phrase_hits(questions, aliases, "query_id", "question"), by_length=False)
    found = spans.join(F.broadcast(aliases.select("alias", "relation")), "alias").groupBy(F.col("id").alias("query_id")).agg(F.array_sort(F.collect_set("relation")).alias("cues"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("cues", F.array().cast("array<string>")).alias("cues"))


def chain_candidates(
    anchors: DataFrame, edges: DataFrame, most_edges: int = MAX_EDGES, most_candidates: int = MAX_CANDIDATES, most_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Connected edge sets of up to ``most_edges`` around each question's anchors.

    ``anchors``: ``query_id, node``; ``edges``: ``source, relation, target,
    proven``. Gives ``query_id, signature, nodes, size, orientation,
    provenance``. A set is known by its sorted triples and found once a
    question, however often and from whichever anchor it is reached. An edge
    that closes a cycle is added only beside a parallel one. Orientation is the
    share of edges walked along their direction, from -1 to 1, the best of all
    ways to grow the set; an edge between two nodes of the set counts as along
    where its source is no deeper.

    The limits bound the work whatever the degrees. An attempt is an edge end at
    a node of a set; a question that would need more than ``most_attempts`` is
    given up before they are made and has no candidates. A question with
    ``most_candidates`` sets, smaller ones and then those first by signature,
    grows no further. Every level is a table of the shared folder.
    """
    triples = edges.groupBy(F.struct("source", "relation", "target").alias("e")).agg(F.max(F.col("proven").cast("int")).alias("proven"))
    ends = triples.select(F.explode(F.array("e.source", "e.target")).alias("node"), "e", "proven").distinct()
    touch = staged(ends, "chain-edges")
    degree = touch.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    kind = f"array<{triples.schema['e'].dataType.simpleString()}>"
    state = anchors.select("query_id", "node").distinct().select(
        "query_id", F.col("node").alias("anchor"), F.array().cast(kind).alias("signature"), F.create_map("node", F.lit(0)).alias("depths"), F.lit(0).alias("along"), F.lit(0).alias("proven")
    )
    spent = anchors.select("query_id", F.lit(0).cast("long").alias("spent")).distinct()
    levels: list[DataFrame] = []
    for size in range(1, most_edges + 1):
        nodes = state.select("query_id", F.explode(F.map_keys("depths")).alias("node"))
        more = nodes.join(degree, "node").groupBy("query_id").agg(F.sum("degree").alias("more"))
        spent = staged(spent.join(more, "query_id", "left").select("query_id", (F.col("spent") + F.coalesce("more", F.lit(0))).alias("spent")), "chain-work")
        state = state.join(spent.where(F.col("spent") <= most_attempts).select("query_id"), "query_id", "left_semi")
        source, target = F.col("e.source"), F.col("e.target")
        has = lambda c: F.map_contains_key("depths", c)
        pair = F.array_sort(F.array(source, target))
        parallel = F.exists("signature", lambda s: F.array_sort(F.array(s["source"], s["target"])) == pair)
        depth = lambda c: F.element_at("depths", c)
        inner = has(source) & has(target)
        new = F.when(inner, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).when(has(source), F.create_map(target, depth(source) + 1)).otherwise(F.create_map(source, depth(target) + 1))
        forward = F.when(inner, (depth(source) <= depth(target)).cast("int")).otherwise(has(source).cast("int"))
        grown = (
            state.withColumn("node", F.explode(F.map_keys("depths")))
            .join(touch.select("node", "e", F.col("proven").alias("shown")), "node")
            .where(~F.array_contains("signature", F.col("e")))
            .where(~inner | parallel)
            .select("query_id", "anchor", F.array_sort(F.concat("signature", F.array("e"))).alias("signature"), F.map_concat("depths", new).alias("depths"), (F.col("along") + forward).alias("along"), (F.col("proven") + F.col("shown")).alias("proven"))
        )
        best = F.max_by(F.struct("depths", "along", "proven"), F.struct("along", F.to_json("depths"))).alias("b")
        state = staged(grown.groupBy("query_id", "anchor", "signature").agg(best).select("query_id", "anchor", "signature", "b.*"), "chain-level")
        levels.append(state.withColumn("size", F.lit(size)))
        sets = levels[0].select("query_id", "signature")
        for level in levels[1:]:
            sets = sets.unionByName(level.select("query_id", "signature"))
        full = sets.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most_candidates)
        state = state.join(full, "query_id", "left_anti")
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    best = F.max_by(F.struct("depths", "along", "proven"), F.struct("along", F.to_json("depths"))).alias("b")
    merged = rows.join(spent.where(F.col("spent") <= most_attempts).select("query_id"), "query_id", "left_semi").groupBy("query_id", "signature", "size").agg(best)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("size", "signature"))
    kept = merged.withColumn("place", place).where(F.col("place") <= most_candidates)
    return kept.select(
        "query_id", "signature", F.array_sort(F.map_keys("b.depths")).alias("nodes"), "size",
        (2.0 * F.col("b.along") / F.col("size") - 1.0).alias("orientation"), (F.col("b.proven") / F.col("size")).alias("provenance"),
    )


def chain_rankings(candidates: DataFrame, questions: DataFrame, node_tokens: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` chains of each question by every method: ``query_id, method, chain_id, size, score, rank``.

    ``questions``: ``query_id, tokens, cues``; ``node_tokens``: ``node,
    tokens``. The core of a score is the F1 of the question's and the nodes'
    words, the share of proven edges and the length. ``m0`` is the core,
    ``cue_off`` adds the orientation, ``direction_off`` how the relations meet
    the question's cues, ``r1`` both; ``b0`` has no score. Ties go to fewer
    edges, then to the signature.
    """
    spread = candidates.select("query_id", "signature", F.explode("nodes").alias("node")).join(node_tokens, "node")
    words = spread.groupBy("query_id", "signature").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("words"))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    said = lambda c: F.array_except(c, stops)
    joined = candidates.join(words, ["query_id", "signature"], "left").join(questions, "query_id")
    relations = F.transform("signature", lambda s: s["relation"])
    met = F.size(F.array_intersect(F.array_distinct(relations), "cues"))
    hits = F.size(F.filter(relations, lambda r: F.array_contains("cues", r)))
    asked = F.size("cues")
    core = (
        WEIGHTS["node_token_f1"] * set_f1(said(F.col("tokens")), said(F.coalesce("words", F.array().cast("array<string>"))))
        + WEIGHTS["provenance"] * F.col("provenance")
        + WEIGHTS["extra_edge"] * (F.col("size") - 1)
    )
    cue = F.when(asked == 0, 0.0).otherwise(WEIGHTS["relation_coverage"] * met / asked + WEIGHTS["relation_precision"] * hits / F.col("size"))
    way = WEIGHTS["orientation"] * F.col("orientation")
    methods = {"b0": F.lit(None).cast("double"), "m0": core, "cue_off": core + way, "direction_off": core + cue, "r1": core + cue + way}
    scored = joined.select(
        "query_id", "size", F.array_join(F.transform("signature", lambda s: F.concat_ws("\t", s["source"], s["relation"], s["target"])), "||").alias("key"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in methods.items()])).alias("m"),
    ).select("query_id", "size", "key", "m.*")
    order = Window.partitionBy("query_id", "method").orderBy(F.round("score", 9).desc_nulls_last(), "size", "key")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("query_id", "method", F.sha2("key", 256).alias("chain_id"), "size", "score", "rank")
