"""Samples, pools and review decisions (inventory section 17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import hash_order

# Words that mark boilerplate.
BOILERPLATE = ("copyright", "table of contents", "disclaimer", "acknowledg", "references", "bibliography")


def balanced(rows: DataFrame, category: str, item: str, n: int, seed: str = "42") -> DataFrame:
    """n rows spread evenly over categories, in hash order inside each."""
    order = Window.partitionBy(category).orderBy(hash_order(seed, item), item)
    kinds = rows.agg(F.greatest(F.count_distinct(category), F.lit(1)).alias("__kinds"))  # one row
    ranked = rows.withColumn("__n", F.row_number().over(order)).crossJoin(F.broadcast(kinds))
    return ranked.where(F.col("__n") <= F.floor(F.lit(n) / F.col("__kinds"))).drop("__n", "__kinds")


def round_robin(rows: DataFrame, group: str, item: str, n: int, seed: str = "spread") -> DataFrame:
    """n rows, one of each group in turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, item), item))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def useful_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of 220 to 2400 characters with a heading and no boilerplate."""
    text = F.lower(F.concat_ws(" ", "heading", "content"))
    plain = F.lit(True)
    for term in BOILERPLATE:
        plain = plain & ~F.contains(text, F.lit(term))
    return chunks.where(F.length("content").between(220, 2400) & (F.trim("heading") != "") & plain)


def quota(rows: DataFrame, slice_col: str, order: list[Column], quotas: dict[str, int]) -> DataFrame:
    """The first rows of each slice, as many as its quota; slices without one give none."""
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    nth = F.row_number().over(Window.partitionBy(slice_col).orderBy(*order))
    return rows.withColumn("place", nth).where(F.col("place") <= F.coalesce(most[F.col(slice_col)], F.lit(0)))


def candidate_pool(sources: DataFrame, least: int = 8, most: int = 12) -> DataFrame:
    """Candidates of each query from ranked sources, best source first, with all sources they came from.

    ``sources``: ``query_id, item, source, priority, rank``. Backfill sources
    have a priority of 100 or more and only fill up to ``least``.
    """
    merged = sources.groupBy("query_id", "item").agg(
        F.min(F.struct("priority", "rank")).alias("best"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "item"))
    ranked = merged.withColumn("place", place)
    return ranked.where((F.col("place") <= least) | ((F.col("place") <= most) & (F.col("best.priority") < 100))).select("query_id", "item", "sources", "place")


def batches(rows: DataFrame, slice_col: str, item: str, sizes: list[int]) -> DataFrame:
    """Adds ``batch``: the first ``sizes[0]`` rows of each slice are batch 1, and so on; the rest none."""
    nth = F.row_number().over(Window.partitionBy(slice_col).orderBy(item))
    batch, upper = F.lit(None).cast("int"), sum(sizes)
    for i in range(len(sizes), 0, -1):
        batch = F.when(nth <= upper, F.lit(i)).otherwise(batch)
        upper -= sizes[i - 1]
    return rows.withColumn("batch", batch)


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Rows of one normalised question as one: candidates and sources united, an exclusion of any holds."""
    return rows.groupBy("question_key").agg(
        F.min("annotation_id").alias("annotation_id"),
        F.min("query").alias("query"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates")))).alias("candidates"),
        F.concat_ws(";", F.array_sort(F.collect_set("source_file"))).alias("sources"),
        F.max("exclusion_reason").alias("exclusion_reason"),
    )


def apply_decisions(pack: DataFrame, decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Reviewed rows of a pack: accepted ones need known gold ids, others keep a reason.

    ``decisions``: ``annotation_id, decision, gold array<string>, reason``;
    ``known``: ``id``. Unknown gold ids make a row invalid and are named.
    """
    ids = decisions.select("annotation_id", F.explode("gold").alias("id"))
    unknown = ids.join(known, "id", "left_anti").groupBy("annotation_id").agg(F.array_sort(F.collect_set("id")).alias("unknown"))
    joined = pack.join(decisions, "annotation_id", "left").join(unknown, "annotation_id", "left")
    ok = (F.col("decision") == "accept") & (F.size("gold") > 0) & F.col("unknown").isNull()
    status = (
        F.when(F.col("decision").isNull(), "pending")
        .when(F.col("unknown").isNotNull(), "invalid_gold")
        .when(ok, "reviewed")
        .when(F.col("decision") == "accept", "missing_gold")
        .otherwise("excluded")
    )
    return joined.withColumn("review_status", status).withColumn("eligible", status == "reviewed")


def finalize(a: DataFrame, b: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Labels of two reviewers as one: consensus, else the adjudication; the rest is open.

    All have ``query_id, passage_id, label``.
    """
    key = ["query_id", "passage_id"]
    both = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), key, "full_outer")
    joined = both.join(adjudicated.withColumnRenamed("label", "c"), key, "left")
    same = F.col("a").eqNullSafe(F.col("b"))
    origin = F.when(same, "consensus").when(F.col("c").isNotNull(), "adjudicated").otherwise("open")
    return joined.select(*key, F.when(same, F.col("a")).otherwise(F.col("c")).alias("label"), origin.alias("origin"))
