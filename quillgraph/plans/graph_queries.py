"""Queries of graph construction, joins and traversal over the supply tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions.text import tokenize
from quillgraph.operators import chains, graph
from quillgraph.plans.registry import query, table
from quillgraph.plans.text_queries import TOKENS

_SUPPLY = "supply AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem)"


def _supply(spark, sf_dir):
    """SUPPLIED_BY pairs: which supplier supplies which part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()


def _nodes(spark, sf_dir):
    def rows(name, key, label, title):
        prefix = label.lower() + ":"
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"), F.lit("{}").alias("properties")
        )

    return (
        rows("part", "p_partkey", "API", "p_name")
        .unionByName(rows("supplier", "s_suppkey", "Manufacturer", "s_name"))
        .unionByName(rows("nation", "n_nationkey", "Country", "n_name"))
        .unionByName(rows("region", "r_regionkey", "Region", "r_name"))
    )


_NODES = """nodes AS (
    SELECT 'api:' || p_partkey AS id, 'API' AS label, p_name AS name FROM part
    UNION ALL SELECT 'manufacturer:' || s_suppkey, 'Manufacturer', s_name FROM supplier
    UNION ALL SELECT 'country:' || n_nationkey, 'Country', n_name FROM nation
    UNION ALL SELECT 'region:' || r_regionkey, 'Region', r_name FROM region)"""


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edges(spark, sf_dir):
    located = table(spark, sf_dir, "supplier").where("s_nationkey IS NOT NULL")
    within = table(spark, sf_dir, "nation").where("n_regionkey IS NOT NULL")
    return (
        graph.edges_of(_supply(spark, sf_dir), _id("api:", "part"), "SUPPLIED_BY", _id("manufacturer:", "supp"))
        .unionByName(graph.edges_of(located, _id("manufacturer:", "s_suppkey"), "LOCATED_IN", _id("country:", "s_nationkey")))
        .unionByName(graph.edges_of(within, _id("country:", "n_nationkey"), "BELONGS_TO_AREA", _id("region:", "n_regionkey")))
    )


_EDGES = """edges AS (
    SELECT DISTINCT 'api:' || l_partkey AS source, 'SUPPLIED_BY' AS relation, 'manufacturer:' || l_suppkey AS target FROM lineitem
    UNION ALL SELECT 'manufacturer:' || s_suppkey, 'LOCATED_IN', 'country:' || s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL
    UNION ALL SELECT 'country:' || n_nationkey, 'BELONGS_TO_AREA', 'region:' || n_regionkey FROM nation WHERE n_regionkey IS NOT NULL)"""


@query(f"WITH {_NODES} SELECT id, label, name FROM nodes")
def kg_nodes(spark, sf_dir):
    """13.12, 13.17: typed nodes of the supply graph."""
    return _nodes(spark, sf_dir).select("id", "label", "name")


@query(f"WITH {_EDGES} SELECT * FROM edges")
def kg_edges(spark, sf_dir):
    """13.12, 13.18: typed edges of the supply graph."""
    return _edges(spark, sf_dir).select("source", "relation", "target")


@query(f"WITH {_NODES} SELECT label, count(*) AS n FROM nodes GROUP BY ROLLUP (label)")
def label_counts(spark, sf_dir):
    """8.1, 8.15: label histogram with its total."""
    return _nodes(spark, sf_dir).rollup("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT source, relation, target, line FROM (
         SELECT 'order:' || l_orderkey AS source, 'CONTAINS' AS relation, 'api:' || l_partkey AS target, l_linenumber AS line,
                row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1"""
)
def edge_dedupe(spark, sf_dir):
    """11.3: the first of edges with one key stays."""
    rows = table(spark, sf_dir, "lineitem").select(
        _id("order:", "l_orderkey").alias("source"), F.lit("CONTAINS").alias("relation"), _id("api:", "l_partkey").alias("target"), F.col("l_linenumber").alias("line")
    )
    return graph.dedupe_edges(rows, "line")


@query(
    """SELECT source, relation, target, max(l) AS line FROM (
         SELECT 'order:' || l_orderkey AS source, 'CONTAINS' AS relation, 'api:' || l_partkey AS target, l_linenumber AS l FROM lineitem) GROUP BY ALL"""
)
def edge_dedupe_last(spark, sf_dir):
    """11.3: the last of edges with one key stays."""
    rows = table(spark, sf_dir, "lineitem").select(
        _id("order:", "l_orderkey").alias("source"), F.lit("CONTAINS").alias("relation"), _id("api:", "l_partkey").alias("target"), F.col("l_linenumber").alias("line")
    )
    return graph.dedupe_edges(rows, "line", "last")


@query(f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 15")
def degree_top15(spark, sf_dir):
    """8.4: a report of the fifteen nodes with the most edges."""
    return graph.degrees(_edges(spark, sf_dir), 15)


@query(
    f"""WITH {_SUPPLY}, per AS (SELECT part, count(*) AS suppliers FROM supply GROUP BY part)
    SELECT count(*) AS parts, round(avg(suppliers), 2) AS mean_suppliers, count_if(suppliers = 1)::BIGINT AS single_source, count_if(suppliers > 1)::BIGINT AS multi_source FROM per"""
)
def supplier_concentration(spark, sf_dir):
    """8.2: how concentrated supply is."""
    per = _supply(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("suppliers"))
    return per.agg(
        F.count(F.lit(1)).alias("parts"), F.round(F.avg("suppliers"), 2).alias("mean_suppliers"),
        F.count_if(F.col("suppliers") == 1).alias("single_source"), F.count_if(F.col("suppliers") > 1).alias("multi_source"),
    )


@query(f"WITH {_SUPPLY} SELECT part, count(*) AS suppliers, min(s_name) AS first_supplier FROM supply JOIN supplier ON s_suppkey = supp GROUP BY part HAVING count(*) <= 20")
def scarce_parts(spark, sf_dir):
    """8.3: parts with few suppliers and the first of their names."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), "s_name")
    per = _supply(spark, sf_dir).join(names, "supp").groupBy("part").agg(F.count(F.lit(1)).alias("suppliers"), F.min("s_name").alias("first_supplier"))
    return per.where("suppliers <= 20")


@query(
    f"""WITH {_SUPPLY} SELECT r_name, n_name, count(DISTINCT part) AS parts, count(DISTINCT supp) AS suppliers
    FROM supply JOIN supplier ON s_suppkey = supp JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""
)
def supply_chain_3hop(spark, sf_dir):
    """7.1, 7.2, 7.18, 8.5: part, supplier, country and region chained."""
    chain = (
        _supply(spark, sf_dir)
        .join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), "s_nationkey"), "supp")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return chain.groupBy("r_name", "n_name").agg(F.count_distinct("part").alias("parts"), F.count_distinct("supp").alias("suppliers"))


@query("SELECT n_name, count(DISTINCT s_suppkey) AS makers, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def optional_country(spark, sf_dir):
    """7.19: countries with or without makers; each side is counted before the join."""
    makers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count_distinct("s_suppkey").alias("makers"))
    buyers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_distinct("c_custkey").alias("customers"))
    return (
        table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "k").join(makers, "k", "left").join(buyers, "k", "left")
        .groupBy("n_name").agg(F.sum(F.coalesce("makers", F.lit(0))).alias("makers"), F.sum(F.coalesce("customers", F.lit(0))).alias("customers"))
    )


@query(f"WITH {_NODES}, {_EDGES}, kept AS (SELECT * FROM edges WHERE relation = 'LOCATED_IN' AND source LIKE '%5') SELECT id, label FROM nodes WHERE label != 'API' AND id NOT IN (SELECT source FROM kept UNION SELECT target FROM kept)")
def isolated_nodes(spark, sf_dir):
    """7.20: makers, countries and regions that no edge of a part of the graph touches."""
    kept = _edges(spark, sf_dir).where("relation = 'LOCATED_IN' AND source LIKE '%5'")
    return graph.isolated(_nodes(spark, sf_dir).where("label != 'API'"), kept).select("id", "label")


@query(f"WITH {_NODES}, {_EDGES}, known AS (SELECT id FROM nodes WHERE id NOT LIKE 'country:%3') SELECT source, relation, target FROM edges WHERE source NOT IN (SELECT id FROM known) OR target NOT IN (SELECT id FROM known)")
def dangling_edges(spark, sf_dir):
    """7.4, 13.11: edges that lead nowhere once some countries are gone."""
    known = _nodes(spark, sf_dir).where("id NOT LIKE 'country:%3'")
    return graph.dangling(_edges(spark, sf_dir), known).select("source", "relation", "target")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, sf_dir):
    """7.3, 7.4, 7.20: the negative pattern as an anti join: customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    """WITH b AS (SELECT p_partkey AS part, p_brand, p_type, p_size FROM part),
    g AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM b)
    SELECT a.part AS part_a, b.part AS part_b FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.part < b.part
    WHERE a.n BETWEEN 2 AND 20"""
)
def shares_target(spark, sf_dir):
    """7.14, 7.15: pairs inside groups of 2 to 20 rows; larger groups say too little and are no pairs."""
    key = ["p_brand", "p_type", "p_size"]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), *key)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 20")
    kept = rows.join(sizes, key)
    other = kept.select(F.col("part").alias("part_b"), *key)
    return kept.withColumnRenamed("part", "part_a").join(other, key).where("part_a < part_b").select("part_a", "part_b")


@query(
    """WITH g AS (SELECT p_partkey AS part, p_brand, p_type, p_size, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part)
    SELECT part_a, part_b, place FROM (
      SELECT a.part AS part_a, b.part AS part_b, row_number() OVER (PARTITION BY a.part ORDER BY b.part) AS place
      FROM g a JOIN g b USING (p_brand, p_type, p_size) WHERE a.n BETWEEN 2 AND 20 AND a.part < b.part) WHERE place <= 15"""
)
def treats_same_capped(spark, sf_dir):
    """7.15: as ``shares_target`` with at most fifteen partners a part, which is the feature."""
    pairs = shares_target(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("part_a").orderBy("part_b"))
    return pairs.withColumn("place", place.cast("long")).where("place <= 15")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next(spark, sf_dir):
    """9.8, 13.3: neighbours in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


_LEVELS = "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS level FROM conversations"


@query(
    f"""WITH l AS ({_LEVELS}) SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM l b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level) AS parent FROM l a"""
)
def stack_parent(spark, sf_dir):
    """9.5, 13.2: the nearest earlier row of a smaller level."""
    level = F.when(F.col("turn") == 0, 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = table(spark, sf_dir, "conversations").withColumn("level", level)
    return graph.stack_parents(rows, "conv_id", "turn", "level", "turn", 4).select("conv_id", "turn", "parent")


@query(
    f"""WITH RECURSIVE l AS ({_LEVELS}), p AS (
        SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM l b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level) AS parent FROM l a),
    r(node, ancestor, distance) AS (
        SELECT conv_id || ':' || turn, conv_id || ':' || turn, 0 FROM p
        UNION ALL SELECT r.node, p.conv_id || ':' || p.parent, distance + 1 FROM r JOIN p ON r.ancestor = p.conv_id || ':' || p.turn WHERE p.parent IS NOT NULL)
    SELECT node, ancestor, distance FROM r WHERE EXISTS (SELECT 1 FROM p WHERE parent IS NOT NULL AND (p.conv_id || ':' || p.turn = node OR p.conv_id || ':' || p.parent = node))"""
)
def ancestor_chain(spark, sf_dir):
    """14.1: all ancestors with their distance, level by level."""
    parents = stack_parent(spark, sf_dir).where("parent IS NOT NULL")
    ident = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(c).cast("string"))
    return graph.ancestors(graph.edges_of(parents, ident("parent"), "PARENT_OF", ident("turn")), spark)


@query(
    f"""WITH {_EDGES}, a AS (SELECT id, nb, relation, row_number() OVER (PARTITION BY id ORDER BY CASE relation WHEN 'SUPPLIED_BY' THEN 3 ELSE 3 END, nb, relation) AS place
      FROM (SELECT source AS id, target AS nb, relation FROM edges WHERE relation IN ('SUPPLIED_BY', 'BELONGS_TO_AREA') UNION ALL SELECT target, source, relation FROM edges WHERE relation IN ('SUPPLIED_BY', 'BELONGS_TO_AREA')))
    SELECT id AS node, nb AS neighbour, relation, place FROM a WHERE place <= 24"""
)
def neighbour_priority(spark, sf_dir):
    """14.2: the first 24 neighbours of every node, which bounds each step of a walk."""
    return graph.adjacency(_edges(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT source AS node, target AS nb, CASE WHEN relation = 'LOCATED_IN' THEN 'REFERENCES' ELSE relation END AS relation FROM edges
      UNION ALL SELECT target, source, CASE WHEN relation = 'LOCATED_IN' THEN 'REFERENCES' ELSE relation END FROM edges),
    near AS (SELECT node, nb, row_number() OVER (PARTITION BY node ORDER BY nb, relation) AS place FROM both_ways QUALIFY place <= 24),
    p(anchor, path, places, found) AS (
      SELECT 'region:' || r_regionkey, ['region:' || r_regionkey], []::BIGINT[], false FROM region
      UNION ALL SELECT anchor, list_append(path, nb), list_append(places, place), nb LIKE 'api:%' FROM p JOIN near ON node = path[-1] WHERE NOT found AND len(path) <= 4 AND NOT list_contains(path, nb)),
    k AS (SELECT * FROM p WHERE found QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY len(path), places, path) <= 8)
    SELECT anchor AS query_id, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY anchor ORDER BY len(path), places, path) AS rank FROM k QUALIFY rank <= 20"""
)
def bfs_paths(spark, sf_dir):
    """14.3: paths from regions to parts through countries and makers."""
    edges = _edges(spark, sf_dir).withColumn("relation", F.when(F.col("relation") == "LOCATED_IN", "REFERENCES").otherwise(F.col("relation")))
    near = graph.adjacency(edges)
    nodes = _nodes(spark, sf_dir)
    anchors = nodes.where("label = 'Region'").select(F.col("id").alias("query_id"), F.col("id").alias("node"))
    goals = nodes.where("label = 'API'").select(F.col("id").alias("node"))
    return graph.bounded_paths(anchors, near, goals).select("query_id", F.array_join("path", ">").alias("path"), F.col("rank").cast("long").alias("rank"))


_CHAIN = f"""e AS (SELECT p_partkey AS source, 'COMPLEMENTS' AS relation, t AS target, p_partkey % 2 AS proven FROM (SELECT p_partkey, unnest([p_partkey * 2 + 1, p_partkey * 2 + 2]) AS t FROM part) JOIN (SELECT p_partkey AS t FROM part) USING (t)
      UNION ALL SELECT p_partkey, 'SUPERSEDES', p_partkey + 1, 0 FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)),
    i AS (SELECT item_id, p_partkey AS anchor, 'Which ' || p_name || ' complements it' || CASE WHEN item_id % 2 = 0 THEN ' by superseding' ELSE '' END AS q FROM benchmark JOIN part ON p_partkey = item_id),
    s(query_id, sig, nodes, along, proven) AS (SELECT item_id, [{{'source': 0::BIGINT, 'relation': '', 'target': 0::BIGINT}}][1:0], [anchor], 0::BIGINT, 0::BIGINT FROM i
      UNION SELECT query_id, list_sort(list_append(sig, {{'source': e.source, 'relation': e.relation, 'target': e.target}})), list_sort(list_distinct(nodes || [e.source, e.target])),
                   along + list_contains(nodes, e.source)::INT, s.proven + e.proven
      FROM s JOIN e ON list_contains(nodes, e.source) != list_contains(nodes, e.target) WHERE len(sig) < 5),
    c AS (SELECT query_id, sig, nodes, len(sig) AS size, 2.0 * max(along) / max(len(sig)) - 1 AS orientation, max(proven) / max(len(sig))::DOUBLE AS provenance FROM s WHERE len(sig) > 0 GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_CHAIN},
    t AS (SELECT p_partkey, {TOKENS.format("p_name")} AS w FROM part),
    f AS (SELECT c.*, (SELECT list_distinct(flatten(list(w))) FROM t WHERE list_contains(c.nodes, t.p_partkey)) AS words, [x FOR x IN list_distinct({TOKENS.format("i.q")}) IF x NOT IN ('which', 'it', 'by')] AS asked,
          CASE WHEN item_id % 2 = 0 THEN ['COMPLEMENTS', 'SUPERSEDES'] ELSE ['COMPLEMENTS'] END AS cues, [x.relation FOR x IN sig] AS rels FROM c JOIN i ON item_id = query_id),
    g AS (SELECT query_id, size, sig, CASE WHEN len(list_intersect(asked, words)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(asked, words)) / (len(asked) + len(words)) END + 0.1 * provenance - 0.02 * (size - 1) AS core,
          2.0 * len(list_intersect(list_distinct(rels), cues)) / len(cues) + 0.5 * len([x FOR x IN rels IF list_contains(cues, x)]) / size AS cue, 0.5 * orientation AS way FROM f),
    m AS (SELECT query_id, size, array_to_string(['part:' || x.source || chr(9) || x.relation || chr(9) || 'part:' || x.target FOR x IN list_sort([{{'a': 'part:' || y.source, 'r': y.relation, 'b': 'part:' || y.target, 'source': y.source, 'relation': y.relation, 'target': y.target}} FOR y IN sig])], '||') AS k,
          unnest(['b0', 'm0', 'cue_off', 'direction_off', 'r1']) AS method, unnest([NULL, core, core + way, core + cue, core + cue + way]) AS score FROM g)
    SELECT query_id, method, sha256(k) AS chain_id, size::INT AS size, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 9) DESC NULLS LAST, size, k) AS rank FROM m QUALIFY rank <= 20"""
)
def chain_ranking(spark, sf_dir):
    """14.6, 14.7, 14.8: connected sets of up to five edges around each question's part, ranked by five methods.

    Parts complement each other along a tree and supersede their neighbours, a graph of small degrees; the supply
    graph's hubs would run into the limit on attempts at once.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    known = parts.select(F.col("p_partkey").alias("t"))
    down = parts.select("p_partkey", F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 2 + 2)).alias("t")).join(known, "t")
    after = parts.where("p_partkey > 0 AND p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") + 1).alias("t")).join(known, "t")
    edge = lambda df, name, proven: df.select(_id("part:", "p_partkey").alias("source"), F.lit(name).alias("relation"), _id("part:", "t").alias("target"), proven.alias("proven"))
    edges = edge(down, "COMPLEMENTS", F.col("p_partkey") % 2 == 1).unionByName(edge(after, "SUPERSEDES", F.lit(False)))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("p_partkey")).join(parts, "p_partkey")
    more = F.when(F.col("p_partkey") % 2 == 0, " by superseding").otherwise("")
    questions = asked.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Which "), "p_name", F.lit(" complements it"), more).alias("question"))
    found = chains.chain_candidates(asked.select(F.col("p_partkey").alias("query_id"), _id("part:", "p_partkey").alias("node")), edges)
    said = questions.select("query_id", F.array_distinct(tokenize("question")).alias("tokens")).join(chains.relation_cues(questions), "query_id")
    ranked = chains.chain_rankings(found, said, parts.select(_id("part:", "p_partkey").alias("node"), tokenize("p_name").alias("tokens")))
    return ranked.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


_NAMES = "(SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS alias, p_partkey FROM part)"


@query(
    f"""WITH n AS (SELECT DISTINCT alias FROM {_NAMES} WHERE length(alias) >= 3),
    m AS (SELECT s_suppkey, s_name || ' sells the ' || a.p_name || ', not ' || b.p_name || 's.' AS text FROM supplier JOIN part a ON a.p_partkey = s_suppkey * 2 JOIN part b ON b.p_partkey = s_suppkey),
    t AS (SELECT s_suppkey, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS t FROM m)
    SELECT s_suppkey, alias FROM t JOIN n ON contains(t, ' ' || alias || ' ')"""
)
def phrase_mentions(spark, sf_dir):
    """5.10, 7.5, 7.7: whole-word mentions of part names in a sentence on every maker, by n-gram equi join."""
    parts = table(spark, sf_dir, "part")
    name = lambda key, alias: parts.select(F.col("p_partkey").alias(key), F.col("p_name").alias(alias))
    makers = table(spark, sf_dir, "supplier").withColumn("two", F.col("s_suppkey") * 2)
    said = makers.join(name("two", "a"), "two").join(name("s_suppkey", "b"), "s_suppkey").select(
        "s_suppkey", F.concat("s_name", F.lit(" sells the "), "a", F.lit(", not "), "b", F.lit("s.")).alias("text")
    )
    nodes = parts.select(_id("api:", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    hits = graph.phrase_hits(said, graph.alias_index(nodes), "s_suppkey", "text")
    return hits.select(F.col("id").alias("s_suppkey"), "alias").distinct()


@query(
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""
)
def events_daily(spark, sf_dir):
    """19.1: daily tumbling windows."""
    day = F.window("ts", "1 day")
    return (
        table(spark, sf_dir, "events").groupBy("event_type", day.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")
    )


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g)
    SELECT user_id, nth::BIGINT AS nth, count(*) AS events FROM s GROUP BY ALL"""
)
def events_sessions(spark, sf_dir):
    """19.1: sessions closed by thirty minutes of silence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w) >= F.col("ts") - F.expr("INTERVAL 30 MINUTES")
    marked = table(spark, sf_dir, "events").withColumn("new", F.when(gap, 0).otherwise(1))
    return marked.withColumn("nth", F.sum("new").over(w)).groupBy("user_id", "nth").agg(F.count(F.lit(1)).alias("events"))


@query(
    """WITH q AS (SELECT item_id, sha256('slice:' || item_id) AS h, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 400 THEN 'middle' ELSE 'long' END AS slice FROM benchmark)
    SELECT item_id, slice, place FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY h, item_id) AS place FROM q) WHERE place <= 10"""
)
def slice_quota_topn(spark, sf_dir):
    """9.7, 17.4: ten items per slice in hash order."""
    slice_ = F.when(F.length("text") < 200, "short").when(F.length("text") < 400, "middle").otherwise("long")
    rows = table(spark, sf_dir, "benchmark").select("item_id", slice_.alias("slice"))
    order = Window.partitionBy("slice").orderBy(F.sha2(F.concat(F.lit("slice:"), F.col("item_id").cast("string")), 256), "item_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 10")


@query(
    """SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('spread:' || doc_id), doc_id) AS turn FROM documents)
    ORDER BY turn, source LIMIT 60"""
)
def round_robin_docs(spark, sf_dir):
    """17.2: a sample of sixty that takes one document of each source in turn."""
    order = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("spread:"), F.col("doc_id").cast("string")), 256), "doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(order).cast("long").alias("turn"))
    return rows.orderBy("turn", "source").limit(60)


@query(
    """WITH a AS (SELECT p_partkey AS k, sha256(p_name) AS h FROM part WHERE p_partkey % 7 != 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE sha256(p_name) END AS h FROM part WHERE p_partkey % 5 != 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'missing' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.h IS DISTINCT FROM b.h"""
)
def inventory_diff(spark, sf_dir):
    """7.23, 7.27, 18.6: added, missing and changed entries of two inventories made from one table."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.sha2("p_name", 256).alias("h"))
    before = rows.where("k % 7 != 0")
    after = rows.where("k % 5 != 0").withColumn("h", F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("h")))
    return inventory_changes(before, after)


def inventory_changes(before, after):
    """``k, change`` of two tables ``k, h``."""
    old, new = before.select("k", F.col("h").alias("old")), after.select("k", F.col("h").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").otherwise("changed")
    return old.join(new, "k", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("k", change.alias("change"))


@query(
    """WITH l AS (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, doc_id FROM documents)
    SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3"""
)
def repeating_lines(spark, sf_dir):
    """2.3: lines that three documents or more repeat, as running headers do."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    kept = lines.where(F.trim("line") != "").groupBy(F.md5("line").alias("line_md5")).agg(F.count_distinct("doc_id").alias("docs"))
    return kept.where("docs >= 3")
