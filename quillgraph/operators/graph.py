"""Property graphs as node and edge tables (inventory sections 13, 14 and parts of 7, 8, 11).

Nodes: ``id, label, name, properties`` (JSON). Edges: ``source, target,
relation, properties``; an edge is known by its first three columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import surrogate_id
from quillgraph.functions.text import alias_forms, normalize, normalize_alias
from quillgraph.scratch import staged

# Relations that may be walked, in the order they are tried.
RELATION_PRIORITY = {
    "MENTIONS": 0, "SAME_AS_CANDIDATE": 1, "AFFECTS_NDC_PRODUCT": 2, "HAS_ACTIVE_INGREDIENT": 2, "REPORTED_BY": 2,
    "APPLIES_DEFINITION_FROM": 3, "BELONGS_TO_AREA": 3, "COMPLEMENTS": 3, "CONTAINS_API": 3, "COVERS_TOPIC": 3,
    "INTERPRETS": 3, "REFERENCES": 3, "REQUIRES_COMPLIANCE_WITH": 3, "SUBSTITUTE_OF": 3, "SUPERSEDES": 3,
    "SUPPLIED_BY": 3, "USES_PRINCIPLES_FROM": 3, "RECALLED_BY": 4, "WAS_RECALLED": 4, "PARENT_OF": 5,
    "CONTAINS": 6, "NEXT": 7,
}
EDGE_KEY = ["source", "target", "relation"]


def edges_of(df: DataFrame, source: Column, relation: str, target: Column, **properties: Column) -> DataFrame:
    """Edge rows from two id columns and a literal relation."""
    bag = F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()])) if properties else F.lit("{}")
    return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), bag.alias("properties"))


def dedupe_edges(edges: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One row per edge key, the first or last by ``order``."""
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    nth = F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy(by))
    return edges.withColumn("__n", nth).where("__n = 1").drop("__n")


def dedupe_nodes(nodes: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One row per node id, the first or last by ``order``."""
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    nth = F.row_number().over(Window.partitionBy("id").orderBy(by))
    return nodes.withColumn("__n", nth).where("__n = 1").drop("__n")


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """Ids that come with more than one label, name or property bag."""
    content = F.sha2(F.to_json(F.struct("label", "name", "properties")), 256)
    return nodes.groupBy("id").agg(F.count_distinct(content).alias("versions")).where("versions > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("id")
    ends = edges.select("*", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(known, "id", "left_anti").groupBy(*EDGE_KEY).agg(F.array_sort(F.collect_set("id")).alias("missing"))


def append_missing(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` whose key it lacks."""
    return edges.unionByName(new.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").dropDuplicates(EDGE_KEY))


def extend(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two node tables as one; a property conflict is an error, equal rows count once."""
    both = base.unionByName(extra, allowMissingColumns=True)
    versions = F.count_distinct(F.to_json(F.struct("label", "name", "properties"))).alias("versions")
    checked = both.groupBy("id").agg(versions, F.min(F.struct("label", "name", "properties")).alias("v"))
    label = F.when(F.col("versions") > 1, F.raise_error(F.concat(F.lit("conflicting node "), F.col("id")))).otherwise(F.col("v.label"))
    return checked.select("id", label.alias("label"), "v.name", "v.properties")


def degrees(edges: DataFrame, top: int | None = None) -> DataFrame:
    """Undirected edge counts of nodes; ``top`` is a report size."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id")
    return counted.limit(top) if top else counted


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")


# --- document structure ------------------------------------------------------


def stack_parents(rows: DataFrame, group: str, position: str, level: str, item: str, levels: int = 6) -> DataFrame:
    """Each row's parent: the nearest row before it with a smaller level, null at the top.

    One window per level below the deepest, all over the same sort.
    """
    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.last(F.when(F.col(level) == n, F.struct(F.col(position).alias("p"), F.col(item).alias("i"))), ignorenulls=True).over(before)
    seen = rows
    for n in range(1, levels):
        seen = seen.withColumn(f"__l{n}", last(n))
    candidates = F.array(*[F.when(F.col(level) > n, F.col(f"__l{n}")) for n in range(1, levels)])
    parent = F.array_max(F.filter(candidates, lambda x: x.isNotNull()))["i"]
    return seen.withColumn("parent", parent).drop(*[f"__l{n}" for n in range(1, levels)])


def next_edges(rows: DataFrame, group: str, position: str, item: str) -> DataFrame:
    """NEXT edges between neighbours of a group."""
    after = F.lead(item).over(Window.partitionBy(group).orderBy(position))
    return edges_of(rows.withColumn("__next", after).where("__next IS NOT NULL"), F.col(item), "NEXT", F.col("__next"))


def neighbours_in_order(hits: DataFrame, rows: DataFrame, group: str, position: str, item: str, reach: int = 2, factor: float = 0.7) -> DataFrame:
    """Rows within ``reach`` places of a hit (``item, score``), at ``factor`` of its score, hits themselves left out."""
    at = hits.join(rows, item).select(group, F.explode(F.sequence(F.col(position) - reach, F.col(position) + reach)).alias(position), "score")
    near = rows.join(at, [group, position]).groupBy(item).agg((F.max("score") * factor).alias("score"))
    return near.join(hits.select(item), item, "left_anti")


# --- linking -------------------------------------------------------------------


def alias_index(nodes: DataFrame, least: int = 3) -> DataFrame:
    """``alias, n_words, node_ids`` of names and their forms, aliases of ``least`` characters and more."""
    forms = F.array_union(F.array(normalize_alias("name")), alias_forms("name"))
    rows = nodes.select("id", F.explode(forms).alias("alias")).where(F.length("alias") >= least)
    return rows.groupBy("alias").agg(F.array_sort(F.collect_set("id")).alias("node_ids")).withColumn("n_words", F.size(F.split("alias", " ")))


def phrase_hits(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every whole-word occurrence of an alias: ``id, start, n_words, alias`` (start counts words from 0).

    Word n-grams of the lengths that aliases have meet the aliases in an equi
    join, so nothing is compared pair by pair. Lengths are read from the alias
    table, which has few of them.
    """
    lengths = [r[0] for r in aliases.select("n_words").distinct().collect()]
    words = F.split(normalize(text_col), " ")
    prepared = texts.select(F.col(id_col).alias("id"), words.alias("words"))
    if not lengths:
        return prepared.select("id", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit("").alias("alias")).limit(0)
    def grams_of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: i + n <= F.size("words"))
        text = lambda i: F.array_join(F.slice("words", i + 1, n), " ")
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n_words"), text(i).alias("alias")))

    grams = F.concat(*[grams_of(n) for n in sorted(lengths)])
    spread = prepared.select("id", F.explode(grams).alias("g")).select("id", "g.*")
    return spread.join(aliases.select("alias"), "alias", "left_semi").select("id", "start", "n_words", "alias")


def mentions(texts: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """MENTIONS edges from texts to every entity whose alias they hold; the first place is kept."""
    aliases = alias_index(nodes)
    hits = phrase_hits(texts, aliases, id_col, text_col).join(aliases.select("alias", "node_ids"), "alias")
    linked = hits.select("id", F.explode("node_ids").alias("node"), "start", "alias")
    first = linked.groupBy("id", "node").agg(F.min(F.struct("start", "alias")).alias("m"))
    return edges_of(first, F.col("id").cast("string"), "MENTIONS", F.col("node"), start=F.col("m.start"), alias=F.col("m.alias"))


def longest_spans(hits: DataFrame, by_length: bool = True) -> DataFrame:
    """Non-overlapping hits per text, greedily: more words, more characters (with ``by_length``), earlier start, alias.

    The hits of one text are folded in one row; a text has few.
    """
    chars = -F.length("alias") if by_length else F.lit(0)
    order = F.struct((-F.col("n_words")).alias("w"), chars.alias("c"), F.col("start"), F.col("alias"), F.col("n_words"))
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("hits"))
    free = lambda taken, h: ~F.exists(taken, lambda t: (h["start"] < t["start"] + t["n_words"]) & (t["start"] < h["start"] + h["n_words"]))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), lambda taken, h: F.when(free(taken, h), F.concat(taken, F.array(h))).otherwise(taken))
    return listed.select("id", F.explode(kept).alias("h")).select("id", F.col("h.start").alias("start"), F.col("h.n_words").alias("n_words"), F.col("h.alias").alias("alias"))


def citations(texts: DataFrame, catalogue: DataFrame, id_col: str, text_col: str, pattern: str = r"(?i)\bICH\s+Q\d+[A-Z]?(?:\(R\d+\))?") -> DataFrame:
    """REFERENCES edges from document codes in texts.

    ``catalogue``: ``code, doc``, codes upper-case without spaces. A base code
    (without its version) resolves only if one document owns it. References to
    the own document are dropped; unknown codes become hashed nodes.
    """
    bare = F.regexp_replace(F.col("code"), r"\(R\d+\)|R\d+$", "")
    bases = catalogue.select(bare.alias("code"), "doc").groupBy("code").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("doc")).where("n = 1")
    known = catalogue.select("code", "doc").unionByName(bases.select("code", "doc")).dropDuplicates(["code"])
    found = texts.select(
        F.col(id_col).cast("string").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)))).alias("raw")
    ).withColumn("code", F.upper(F.regexp_replace("raw", r"\s+", "")))
    joined = found.join(known, "code", "left").where("doc IS NULL OR doc != id")
    target = F.when(F.col("doc").isNotNull(), F.concat(F.lit("regdoc:"), "doc")).otherwise(surrogate_id("regref", "code"))
    return edges_of(joined.select("id", target.alias("t"), "code").distinct(), F.col("id"), "REFERENCES", F.col("t"), code=F.col("code"))


def rule_relations(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Relations that a rule's pattern finds in its document, with the evidence, or why not.

    ``rules``: ``rule_id, source_doc_id, relation, target_value,
    evidence_pattern``; a list of a few dozen rows, joined by document.
    """
    joined = rules.join(texts.select(F.col(id_col).alias("source_doc_id"), F.col(text_col).alias("__text")), "source_doc_id", "left")
    evidence = F.regexp_substr("__text", F.concat(F.lit("(?is)"), "evidence_pattern"))
    return joined.select(
        "rule_id", "source_doc_id", "relation", "target_value", evidence.alias("evidence"),
        F.when(F.col("__text").isNull(), "rejected_source_missing").when(evidence.isNull(), "rejected_evidence_not_found").otherwise("accepted").alias("status"),
    )


# --- traversal -------------------------------------------------------------------


def ancestors(edges: DataFrame, spark: SparkSession, depth: int = 20) -> DataFrame:
    """``node, ancestor, distance`` along PARENT_OF, the node itself at 0; a bounded loop of joins."""
    up = edges.where("relation = 'PARENT_OF'").select(F.col("target").alias("child"), F.col("source").alias("parent"))
    reached = up.select(F.explode(F.array("child", "parent")).alias("node")).distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    level, out = reached, reached
    for d in range(1, depth + 1):
        level = level.join(up, level["ancestor"] == up["child"]).select("node", F.col("parent").alias("ancestor"), F.lit(d).alias("distance"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def adjacency(edges: DataFrame, most: int = 24) -> DataFrame:
    """``node, neighbour, relation, place``: both directions, walkable relations, the first ``most`` by priority and id."""
    priority = F.create_map(*[F.lit(x) for kv in RELATION_PRIORITY.items() for x in kv])
    walkable = edges.where(F.col("relation").isin(*RELATION_PRIORITY))
    both = walkable.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relation").union(
        walkable.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relation")
    )
    order = Window.partitionBy("node").orderBy(priority[F.col("relation")], "neighbour", "relation")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def bounded_paths(anchors: DataFrame, near: DataFrame, goals: DataFrame, depth: int = 4, per_anchor: int = 8, per_query: int = 20) -> DataFrame:
    """Simple paths from anchors (``query_id, node``) to goal nodes (``node``), shortest first.

    A path ends at its first goal. Level by level, a join with the adjacency;
    places along the way give the breadth-first order in which paths are kept.
    Longer paths rank behind, so an anchor with ``per_anchor`` paths is walked
    no further; each level is a table of the shared folder.
    """
    goal = goals.select(F.col("node").alias("end")).distinct().withColumn("is_goal", F.lit(True))
    frontier = anchors.select("query_id", F.col("node").alias("anchor"), F.array("node").alias("path"), F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("relations"))
    found = None
    for _ in range(depth):
        grown = (
            frontier.withColumn("node", F.element_at("path", -1))
            .join(near, "node")
            .where(~F.array_contains("path", F.col("neighbour")))
            .select("query_id", "anchor", F.concat("path", F.array("neighbour")).alias("path"), F.concat("order", F.array("place")).alias("order"), F.concat("relations", F.array("relation")).alias("relations"), F.col("neighbour").alias("end"))
            .join(goal, "end", "left")
        )
        grown = staged(grown, "paths")
        done = grown.where("is_goal").drop("is_goal", "end")
        found = done if found is None else found.unionByName(done)
        full = found.groupBy("query_id", "anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_anchor)
        frontier = grown.where("is_goal IS NULL").drop("is_goal", "end").join(full, ["query_id", "anchor"], "left_anti")
    length = F.size("path")
    nth = F.row_number().over(Window.partitionBy("query_id", "anchor").orderBy(length, "order", "path"))
    kept = found.withColumn("nth", nth).where(F.col("nth") <= per_anchor)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(length, "anchor", "order", "path"))
    return kept.withColumn("rank", place).where(F.col("rank") <= per_query).select("query_id", "anchor", "path", "relations", "rank")


def exact_budget_paths(anchors: DataFrame, near: pd.DataFrame, goals: set, depth: int = 4, states: int = 800, per_anchor: int = 8, per_query: int = 20) -> DataFrame:
    """Breadth-first search with a budget of expanded states, where the order of visits decides what is found.

    ``near`` is a pruned adjacency of a study's frozen graph, small enough for
    a worker; each query is searched in its own task. Says whether the budget
    was used up.
    """
    steps: dict = {}
    for r in near.sort_values(["node", "place"]).itertuples():
        steps.setdefault(r.node, []).append(r.neighbour)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, cut = [], 0, False
        for anchor in sorted(pdf["node"].unique()):
            queue, mine = [[anchor]], 0
            while queue and mine < per_anchor and len(rows) < per_query:
                if used >= states:
                    cut = True
                    break
                path = queue.pop(0)
                used += 1
                for n in steps.get(path[-1], ()):
                    if n in path:
                        continue
                    if n in goals:
                        if mine < per_anchor and len(rows) < per_query:
                            rows.append((pdf["query_id"].iloc[0], anchor, [*path, n], len(rows) + 1))
                            mine += 1
                    elif len(path) < depth:
                        queue.append([*path, n])
        out = pd.DataFrame(rows, columns=["query_id", "anchor", "path", "rank"])
        out["truncated"] = cut
        return out

    kind = anchors.schema["query_id"].dataType.simpleString()
    return anchors.groupBy("query_id").applyInPandas(search, f"query_id {kind}, anchor string, path array<string>, rank int, truncated boolean")


def risk_score(labels: Column, relations: Column) -> Column:
    """0.3 for a single supplier or shortage, 0.1 steps for what a path touches, less 10 % a hop beyond two."""
    has = lambda c, v, w: F.when(F.array_contains(c, v), w).otherwise(0.0)
    base = (
        has(labels, "ShortageEvent", 0.3) + has(relations, "SUPPLIED_BY", 0.3) + has(labels, "Country", 0.1)
        + has(labels, "Manufacturer", 0.1) + has(relations, "INTERACTS_WITH", 0.1)
    )
    hops = F.size(relations)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(hops > 2, 1 - 0.1 * (hops - 2)).otherwise(1.0)))
