"""Evidence routes: three-path retrieval, keyword and entity recall, graph expansion (parts of sections 8, 10, 12 to 14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import dense
from quillgraph.operators.graph import ancestors

# --- routes --------------------------------------------------------------------


def bottom_up(hits: DataFrame, known: DataFrame, k: int = 5, depth: int = 500) -> DataFrame:
    """The first ``k`` known chunks of a ranking ``query_id, item, rank`` with repeats: ``query_id, item, rank``."""
    inside = hits.where(F.col("rank") <= depth).join(known.select("item"), "item", "left_semi")
    return dense.dedupe_ranking(inside, "item", k)


def top_down(
    document_hits: DataFrame, chunk_hits: DataFrame, tree: DataFrame, k: int = 5, budget: int = 2, depth: int = 240, factor: float = 0.55
) -> DataFrame:
    """Chunks of the documents that hits vote for, then the children along their ancestor chains.

    ``document_hits``: ``query_id, doc, rank``; ``chunk_hits``: ``query_id,
    item, doc, score, rank``; ``tree``: PARENT_OF edges. A chunk inside the
    ``budget`` best documents is a seed with its score; every child of a node on
    a seed's ancestor chain gets ``factor`` of the seed's score, the first seed
    counting. Order: score, then seeds before children, then the first seed.
    """
    votes = dense.doc_votes(document_hits.where(F.col("rank") <= depth), "doc", budget).select("query_id", "doc")
    inside = chunk_hits.join(votes, ["query_id", "doc"], "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))
    seeds = inside.withColumn("seed", place).where(F.col("seed") <= k).select("query_id", "item", "score", "seed")
    up = ancestors(tree, tree.sparkSession).select(F.col("node").alias("item"), "ancestor", "distance")
    chain = seeds.join(up, "item").select("query_id", "seed", "score", F.col("ancestor").alias("source"), "distance")
    children = chain.join(tree.where("relation = 'PARENT_OF'").select("source", F.col("target").alias("item")), "source")
    near = children.select("query_id", "item", F.struct(F.lit(1).alias("kind"), "seed", "distance").alias("first"), (F.col("score") * factor).alias("score"))
    own = seeds.select("query_id", "item", F.struct(F.lit(0).alias("kind"), "seed", F.lit(0).alias("distance")).alias("first"), "score")
    best = own.unionByName(near).groupBy("query_id", "item").agg(F.min(F.struct("first", "score")).alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.round("b.score", 9).desc(), "b.first", "item")
    ranked = best.select("query_id", "item", F.col("b.score").alias("score"), F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def reachable_backfill(reached: DataFrame, chunk_hits: DataFrame, k: int = 5) -> DataFrame:
    """Evidence of the documents that paths reach: their chunk hits by score; a terminal chunk without a hit scores 0.

    ``reached``: ``query_id, item, doc`` (terminal chunks); ``chunk_hits`` as in ``top_down``.
    """
    docs = reached.select("query_id", "doc").distinct()
    hits = chunk_hits.join(docs, ["query_id", "doc"], "left_semi").select("query_id", "item", "score")
    paths = reached.select("query_id", "item", F.lit(0.0).alias("score"))
    best = hits.unionByName(paths).groupBy("query_id", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def threshold_hits(hits: DataFrame, least: float, most: int, doc: str) -> DataFrame:
    """Hits (``query_id, item, score, rank``) of ``least`` and more among the first ``most``, the best of each ``doc``."""
    kept = hits.where((F.col("rank") <= most) & (F.col("score") >= least))
    return kept.groupBy("query_id", doc).agg(F.max_by("item", F.struct("score", -F.col("rank"))).alias("item"), F.max("score").alias("score"))


def keyword_recall(keywords: DataFrame, terms: DataFrame, most: int = 8, least: int = 2) -> DataFrame:
    """Documents that hold ``least`` or more of a query's keywords as words: score 0.35 and 0.05 a keyword, five at most.

    ``keywords``: ``query_id, term``; ``terms``: ``doc, term`` occurrences.
    """
    hits = terms.join(keywords.distinct(), "term").groupBy("query_id", "doc").agg(F.count_distinct("term").alias("hits")).where(F.col("hits") >= least)
    scored = hits.withColumn("score", F.lit(0.35) + F.lit(0.05) * F.least(F.col("hits"), F.lit(5)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def entity_recall(names: DataFrame, mentions: DataFrame, most: int = 5, score: float = 0.3) -> DataFrame:
    """Chunks by how many of a query's entities they mention; ``names``: ``query_id, entity``; ``mentions``: ``chunk, entity``."""
    hits = mentions.distinct().join(names.distinct(), "entity").groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("entities"))
    order = Window.partitionBy("query_id").orderBy(F.desc("entities"), "chunk")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("score", F.lit(score))


def concentration(hits: DataFrame, doc: str, section: str, least: int = 3) -> DataFrame:
    """The document that most hits of a query lie in, if ``least`` do, and the section that most of those lie in."""
    docs = hits.groupBy("query_id", doc).agg(F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), doc))
    main = docs.withColumn("p", top).where(f"p = 1 AND n >= {least}").select("query_id", doc, "n")
    parts = hits.join(main, ["query_id", doc]).groupBy("query_id", doc, "n", section).agg(F.count(F.lit(1)).alias("in_section"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("in_section"), section))
    return parts.withColumn("p", best).where("p = 1").drop("p")


def chapter_read(found: DataFrame, chunks: DataFrame, seen: DataFrame, doc: str, section: str, most: int = 10, score: float = 0.4) -> DataFrame:
    """The other chunks of a query's main section: ``query_id, item``, the first ``most`` by id, at a fixed score."""
    rest = found.select("query_id", doc, section).join(chunks, [doc, section]).join(seen.select("query_id", "item"), ["query_id", "item"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("item"))
    return rest.withColumn("n", nth).where(F.col("n") <= most).select("query_id", "item", F.lit(score).alias("score"))


def rescored(candidates: DataFrame, score: Callable[[list[str], list[str]], list[tuple[float, float]]]) -> DataFrame:
    """Candidates ranked by an injected model of (query, passage) pairs that gives logits for yes and no.

    ``candidates``: ``query_id, item, bm25_rank, query, passage``. The score is
    the probability of yes; ties by the old rank, then the id.
    """

    @F.pandas_udf("struct<yes: double, no: double>")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, passages in batches:
            yield pd.DataFrame(score(queries.tolist(), passages.tolist()), columns=["yes", "no"])

    probability = 1 / (1 + F.exp(F.col("l.no") - F.col("l.yes")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "bm25_rank", "item")
    made = candidates.withColumn("l", logits("query", "passage")).withColumn("score", probability)
    return made.select("query_id", "item", "bm25_rank", "score", F.row_number().over(order).alias("rank"))


# --- graph ---------------------------------------------------------------------


def short_paths(starts: DataFrame, edges: DataFrame, depth: int = 3, most: int = 10) -> DataFrame:
    """Undirected paths of 1 to ``depth`` edges, no edge twice, the first ``most`` of each start by length, then nodes.

    ``starts``: ``node``. Shorter paths rank first, so a start that has ``most``
    of them is walked no further, and any other has fewer than ``most`` paths to
    go on from: no level grows beyond that, whatever the degrees.
    """
    named = edges.select("source", "relation", "target").distinct().withColumn("e", F.concat_ws("|", "source", "relation", "target"))
    step = named.select(F.col("source").alias("at"), F.col("target").alias("to"), "e").unionByName(named.select(F.col("target").alias("at"), F.col("source").alias("to"), "e"))
    level = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.array().cast("array<string>").alias("used"))
    out, nth = None, F.row_number().over(Window.partitionBy("start").orderBy("path", "used"))
    for n in range(1, depth + 1):
        grown = (
            level.withColumn("at", F.element_at("path", -1)).join(step, "at").where(~F.array_contains("used", F.col("e")))
            .select("start", F.concat("path", F.array("to")).alias("path"), F.concat("used", F.array("e")).alias("used"))
        )
        kept = grown.withColumn("n", nth).where(F.col("n") <= most).drop("n").withColumn("depth", F.lit(n))
        out = kept if out is None else out.unionByName(kept)
        done = out.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        level = kept.drop("depth").join(done, "start", "left_anti")
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "path", "used"))
    return out.withColumn("rank", place).where(F.col("rank") <= most).drop("used")


def mentioning_chunks(entities: DataFrame, mentions: DataFrame, most: int = 10, score: float = 0.5) -> DataFrame:
    """Chunks that mention a query's entities, the first ``most`` by id, at a fixed score."""
    found = mentions.join(entities, "entity").select("query_id", "chunk").distinct()
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk"))
    return found.withColumn("n", nth).where(F.col("n") <= most).select("query_id", "chunk", F.lit(score).alias("score"))


def chain_gold(edges: DataFrame, relations: list[str], least: int = 1) -> DataFrame:
    """Chains along relations in order, with how many start at each head: ``head, nodes, chains``; heads with fewer than ``least`` go."""
    found = edges.where(F.col("relation") == relations[0]).select(F.col("source").alias("head"), F.array("source", "target").alias("nodes"), F.col("target").alias("at"))
    for relation in relations[1:]:
        step = edges.where(F.col("relation") == relation).select(F.col("source").alias("at"), F.col("target").alias("to"))
        found = found.join(step, "at").select("head", F.concat("nodes", F.array("to")).alias("nodes"), F.col("to").alias("at"))
    sizes = found.groupBy("head").agg(F.count(F.lit(1)).alias("chains")).where(F.col("chains") >= least)
    return found.join(sizes, "head").select("head", "nodes", "chains")


# The first letters of drug classes and the classes they stand for.
ATC_CLASSES = {
    "A": "Alimentary tract and metabolism", "B": "Blood and blood forming organs", "C": "Cardiovascular system", "D": "Dermatologicals",
    "G": "Genito-urinary system and sex hormones", "H": "Systemic hormonal preparations", "J": "Antiinfectives for systemic use",
    "L": "Antineoplastic and immunomodulating agents", "M": "Musculo-skeletal system", "N": "Nervous system", "P": "Antiparasitic products",
    "R": "Respiratory system", "S": "Sensory organs", "V": "Various",
}


def class_edges(drugs: DataFrame) -> DataFrame:
    """Drugs (``id, codes`` with bars between) to the classes of their codes' first letters, each once."""
    names = F.create_map(*[F.lit(x) for kv in ATC_CLASSES.items() for x in kv])
    letters = drugs.select("id", F.explode(F.split("codes", r"\|")).alias("code")).select("id", F.upper(F.left(F.trim("code"), F.lit(1))).alias("letter"))
    known = letters.where(F.col("letter").isin(*ATC_CLASSES)).distinct()
    return known.select(F.col("id").alias("source"), F.lit("BELONGS_TO_CLASS").alias("relation"), F.concat(F.lit("atc:"), "letter").alias("target"), names[F.col("letter")].alias("name"))


def breadcrumb_parents(chunks: DataFrame) -> DataFrame:
    """``chunk_id, parent``: the nearest breadcrumb part that is a heading of the document, read from the end.

    ``chunks``: ``chunk_id, doc_id, seq, heading, parents_context`` (parts joined by `` > ``).
    """
    parts = F.reverse(F.split("parents_context", r"\s*>\s*"))
    crumbs = chunks.select("chunk_id", "doc_id", F.posexplode(parts).alias("up", "heading")).where("trim(heading) != ''")
    heads = chunks.groupBy("doc_id", "heading").agg(F.min_by("chunk_id", "seq").alias("parent"))
    hits = crumbs.join(heads, ["doc_id", "heading"]).where("parent != chunk_id")
    return hits.groupBy("chunk_id").agg(F.min_by("parent", "up").alias("parent"))
