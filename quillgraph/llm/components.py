"""Connected components over distributed links: union-find by graph contraction, the last links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgraph.llm.common import released, staged

#: so many links are settled by one task; more are contracted first
AT_ONCE = 100_000


def _hooks(edges: DataFrame, round_: int) -> DataFrame:
    """``node, up``: each node's first neighbour, or itself where it comes before all of them.

    Nodes with more neighbours come first, equals in a hash order of the round.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    order = lambda node: F.struct(-F.col("degree"), F.xxhash64(F.lit(round_), F.col(node)), F.col(node).alias("node"))
    offers = both.select(F.col("a").alias("to"), F.col("b").alias("a")).join(degrees, "a").select("to", order("a").alias("offer"))
    own = degrees.select(F.col("a").alias("to"), order("a").alias("offer"))
    return offers.unionByName(own).groupBy(F.col("to").alias("node")).agg(F.min("offer")["node"].alias("up"))


def _settled(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and, as ``name``, the least node reachable, for every node of a few edges: union-find in one task."""
    kind = edges.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(node):
            while (above := up[node]) != node:
                up[node] = node = up[above]
            return node

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                one, two = top(a), top(b)
                up[max(one, two)] = min(one, two)
            like = batch.column(0).type
        if nodes := list(up):
            yield pa.RecordBatch.from_arrays([pa.array(nodes, like), pa.array([top(n) for n in nodes], like)], names=["node", name])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, StructType([StructField("node", kind), StructField(name, kind)]))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is the least node reachable.

    Each round contracts the graph: a node is merged into the first of its
    neighbours, edges are renamed and what has become a loop goes. The order of
    nodes is drawn anew every round, so about half of the nodes that still have
    edges vanish in each, in chains and in stars alike, and the number of rounds
    grows with the logarithm of the largest component. There is no limit on the
    rounds: every round merges a node at least. Once ``AT_ONCE`` edges or fewer
    are left, one task settles them, which spares the driver the many small jobs
    of the last rounds. The merges are then followed back from the last round to
    the first. All tables are in the shared folder; nothing is collected. Null
    ends are no links; repeated links and loops are allowed, and a node with
    only loops is its own root.
    """
    given = staged(
        links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "component-links",
    )
    if given.count() <= AT_ONCE:
        return staged(_settled(given, "root"), "component-roots")
    edges, merges = given.where("a != b"), []
    while edges.count() > AT_ONCE:
        hooks = staged(_hooks(edges, len(merges)), "component-hooks")
        new = staged(
            edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("one")), "a")
            .join(hooks.select(F.col("node").alias("b"), F.col("up").alias("two")), "b")
            .where("one != two")
            .select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
            .distinct(),
            "component-edges",
        )
        if merges:
            released(edges)
        merges.append(hooks)
        edges = new
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = staged(_settled(edges, "up"), "component-ends")
    for hooks in reversed(merges):
        later = ends.select(F.col("node").alias("up"), F.col("up").alias("end"))
        ends = staged(hooks.join(later, "up", "left").select("node", F.coalesce("end", "up").alias("up")), "component-ends")
    named = nodes.join(ends, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
    least = named.groupBy("up").agg(F.min("node").alias("root"))
    return named.join(least, "up").select("node", "root")
