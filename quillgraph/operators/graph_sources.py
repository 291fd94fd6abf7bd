"""Graphs from records, and walks over them (inventory sections 13 and 14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import surrogate_id
from quillgraph.functions.text import normalize
from quillgraph.operators.graph import edges_of


def node_rows(df: DataFrame, ident: Column, label: str, name: Column, **properties: Column) -> DataFrame:
    """Node rows from a table, one per id."""
    bag = F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()])) if properties else F.lit("{}")
    rows = df.select(ident.alias("id"), F.lit(label).alias("label"), name.alias("name"), bag.alias("properties"))
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "name", "properties")).alias("v")).select("id", "v.*")


def shortage_graph(records: DataFrame, drugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, products, companies and ingredients of shortage records, linked to known drugs by name.

    ``records`` as ``read_shortages`` gives them; ``drugs``: ``id, name``. An
    event is known by its package, company and posting date.
    """
    key = F.concat_ws("|", "package_ndc", "company_name", "initial_posting_date", "generic_name")
    rows = records.withColumn("event", F.concat(F.lit("shortage:"), F.left(F.sha2(key, 256), F.lit(20)))).withColumn(
        "product", F.when(F.col("package_ndc") != "", F.concat(F.lit("ndc:"), "package_ndc"))
    ).withColumn("company", F.when(F.trim("company_name") != "", surrogate_id("fdamfr", "company_name")))
    spread = rows.select("event", "product", F.explode("ingredients").alias("ingredient")).where("trim(ingredient) != ''")
    named = spread.withColumn("ingredient_id", surrogate_id("ingredient", "ingredient"))
    nodes = (
        node_rows(rows, F.col("event"), "FDA_DrugShortageEvent", F.col("generic_name"), status=F.col("status"), reason=F.col("shortage_reason"))
        .unionByName(node_rows(rows, F.col("product"), "FDANDCProduct", F.col("package_ndc")))
        .unionByName(node_rows(rows, F.col("company"), "FDAManufacturer", F.col("company_name")))
        .unionByName(node_rows(named, F.col("ingredient_id"), "FDAActiveIngredient", F.col("ingredient")))
    )
    known = drugs.select(F.col("id").alias("drug"), normalize("name").alias("n"))
    same = named.select("ingredient_id", normalize("ingredient").alias("n")).distinct().join(known, "n")
    edges = (
        edges_of(rows.where("product IS NOT NULL"), F.col("event"), "AFFECTS_NDC_PRODUCT", F.col("product"))
        .unionByName(edges_of(rows.where("company IS NOT NULL"), F.col("event"), "REPORTED_BY", F.col("company")))
        .unionByName(edges_of(named.where("product IS NOT NULL"), F.col("product"), "HAS_ACTIVE_INGREDIENT", F.col("ingredient_id")))
        .unionByName(edges_of(same, F.col("ingredient_id"), "SAME_AS_CANDIDATE", F.col("drug")))
    )
    return nodes, edges.dropDuplicates(["source", "relation", "target"])


def recall_graph(recalls: DataFrame, drugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recall events of known drugs: rows ``recall_number, product, firm, reason``; blank numbers are skipped."""
    rows = recalls.where("trim(coalesce(recall_number, '')) != ''").withColumn("recall", surrogate_id("recall", "recall_number"))
    firms = rows.where("trim(coalesce(firm, '')) != ''").withColumn("firm_id", surrogate_id("firm", "firm"))
    known = drugs.select(F.col("id").alias("drug"), normalize("name").alias("n"))
    hit = rows.withColumn("n", normalize("product")).join(known, "n")
    nodes = node_rows(rows, F.col("recall"), "RecallEvent", F.col("recall_number"), reason=F.col("reason")).unionByName(
        node_rows(firms, F.col("firm_id"), "FDAManufacturer", F.col("firm"))
    )
    edges = edges_of(hit, F.col("drug"), "WAS_RECALLED", F.col("recall")).unionByName(edges_of(firms, F.col("recall"), "RECALLED_BY", F.col("firm_id")))
    return nodes, edges.dropDuplicates(["source", "relation", "target"])


def table_graph(tables: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table nodes, HAS_TABLE edges where the chunk is known, and the rows where it isn't."""
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("table"))
    rows = tables.withColumn("id", F.concat_ws(":", F.lit("table"), "chunk_id", F.lpad(nth.cast("string"), 3, "0")))
    known = rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    nodes = node_rows(known, F.col("id"), "Table", F.col("id"), summary=F.col("table_summary"))
    lost = rows.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return nodes, edges_of(known, F.concat(F.lit("chunk:"), "chunk_id"), "HAS_TABLE", F.col("id")), lost.select("id", "chunk_id")


def regulation_edges(makers: DataFrame, rules: DataFrame) -> DataFrame:
    """Makers (``id, country``) to the regulations (``country, regulation``) of their country; a null country means all."""
    everyone = rules.where("country IS NULL").select("regulation")
    shared = makers.crossJoin(F.broadcast(everyone))  # the rule table is a fixed short list
    own = makers.join(rules.where("country IS NOT NULL"), "country")
    both = shared.select("id", "regulation").union(own.select("id", "regulation")).distinct()
    return edges_of(both, F.col("id"), "SUBJECT_TO", F.col("regulation"))


def event_evidence(queries: DataFrame, anchors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Shortage events near a query's anchors by matching terms, an equal package code counting 100.

    ``queries``: ``query_id, terms array, codes array``; ``anchors``: ``query_id, node``.
    """
    events = nodes.where("label = 'FDA_DrugShortageEvent'").select(F.col("id").alias("event"), F.lower(F.concat_ws(" ", "name", "properties")).alias("text"))
    touch = edges.select(F.col("source").alias("node"), F.col("target").alias("event")).union(edges.select("target", "source"))
    near = anchors.withColumn("event", F.col("node")).select("query_id", "event").union(anchors.join(touch, "node").select("query_id", "event")).distinct()
    product = edges.where("relation = 'AFFECTS_NDC_PRODUCT'").groupBy(F.col("source").alias("event")).agg(F.min("target").alias("product"))
    found = near.join(events, "event").join(product, "event", "left").join(queries, "query_id")
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("text"), t)))
    code = F.regexp_replace(F.coalesce("product", F.lit("")), "[^0-9]", "")
    scored = found.withColumn("score", hits + F.when(F.array_contains("codes", code), 100).otherwise(0)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "event")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "event", "product", "score", "rank")


def one_hop(anchors: DataFrame, edges: DataFrame, per_side: int = 100) -> DataFrame:
    """Edges from and to a query's anchors, each once, at most ``per_side`` of either side by id."""
    out = anchors.join(edges, anchors["node"] == edges["source"]).select("query_id", "node", "source", "relation", "target", F.lit("out").alias("side"))
    into = anchors.join(edges, anchors["node"] == edges["target"]).select("query_id", "node", "source", "relation", "target", F.lit("in").alias("side"))
    order = Window.partitionBy("query_id", "node", "side").orderBy("relation", "source", "target")
    ranked = out.unionByName(into).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_side)
    return ranked.select("query_id", "source", "relation", "target").distinct()


def hashed_walk(starts: DataFrame, edges: DataFrame, steps: int = 3, seed: int = 42) -> DataFrame:
    """One walk per start without coming back: each step goes to the neighbour with the least hash."""
    both = edges.select(F.col("source").alias("at"), F.col("target").alias("to")).union(edges.select("target", "source")).distinct()
    walk = starts.select("query_id", F.array("node").alias("path"))
    for n in range(steps):
        moved = (
            walk.withColumn("at", F.element_at("path", -1)).join(both, "at").where(~F.array_contains("path", F.col("to")))
            .groupBy("query_id", "path").agg(F.min_by("to", F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(n)), "to"), 256), F.col("to"))).alias("to"))
        )
        walk = walk.join(moved, ["query_id", "path"], "left").select("query_id", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"))
    return walk


def broken_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (``path_id, path``) with consecutive nodes that no edge joins, in that direction."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))
    steps = paths.where(F.size("path") > 1).select("path_id", F.explode(pairs).alias("p")).select("path_id", "p.*")
    return steps.join(edges.select("source", "target"), ["source", "target"], "left_anti").select("path_id").distinct()


def ambiguous_edges(gold: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that share source and relation with a gold edge but lead elsewhere."""
    heads = gold.select("source", "relation").distinct()
    return edges.join(heads, ["source", "relation"], "left_semi").join(gold, ["source", "relation", "target"], "left_anti").select("source", "relation", "target")
