"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a hash order and read as one endless token
stream, cut into blocks of equal token counts. Slot ``i`` of the schedule takes
the golden-ratio point frac((i + 1) / phi), which falls into one source's share
of the unit interval; the k-th slot of a source takes its k-th block, going
round again when the stream is used up. Every prefix of the schedule is close
to the target mix. What the slots leave open, because a source's last block is
short or its share falls between two slots, is settled at the end to the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, hash_buckets, running_total, staged

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of sources: ``source, source_size, target`` from ``source, size`` rows.

    Weights repeat over the sources in code-point order, null last. A target
    stops at ``most`` times the source's size and the excess goes to the others
    by weight: with sources in the order of cap per weight, those before the
    first whose fair share fits are capped. One row per source is all that is
    ordered here.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    return (
        per_source.withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(pattern, (F.col("nth") % len(weights)).cast("int") + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(onwards))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        # the first level that its own cap allows is the common one
        .withColumn(
            "common",
            F.min_by(
                F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                F.when(F.col("level") <= F.col("ratio"), F.col("ratio")),
            ).over(everything),
        )
        .withColumn(
            "target",
            F.when(F.col("common").isNull(), F.col("cap")).otherwise(
                F.least("cap", F.col("common") * F.col("weight"))
            ),
        )
        .select("source", "source_size", "target")
    )


def token_streams(docs: DataFrame, seed: int) -> DataFrame:
    """Adds each row's ``start`` in its source's shuffled token stream."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    buckets = hash_buckets(docs.count(), 2_000)
    return running_total(
        docs.withColumn("__key", key),
        ["source"],
        [F.col("__key"), F.col("id"), F.col("tie")],
        F.pmod(F.shiftrightunsigned("__key", 20), F.lit(buckets)),
        "size",
        "start",
    ).drop("__key")


def schedule(spark: SparkSession, targets: DataFrame, block: int, slots: int, chunk: int = 16_384) -> DataFrame:
    """The mix in order: ``slot, source, rank`` for every slot.

    ``rank`` counts the slots of one source. It is a count within chunks of
    consecutive slots plus the totals of the chunks before, so that a heavy
    source is not ranked in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upper = targets.where("target > 0").select("source", F.sum("target").over(by_name).alias("upper"))
    total = F.max("upper").over(Window.partitionBy())
    lower = F.lag("upper", 1, 0.0).over(Window.orderBy(F.col("source").asc_nulls_last()))
    shares = staged(upper.select("source", (lower / total).alias("low"), (F.col("upper") / total).alias("high")), "mix-shares")
    # a slot falls into one cell of a grid; the cell's few shares are looked up by an equi-join
    n_shares = max(1, shares.count())
    cells = shares.select(
        "source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * n_shares), F.floor(F.col("high") * n_shares))).alias("cell")
    )
    point = F.expr(f"pmod((id + 1) * {GOLDEN!r}D, 1D)")
    dealt = (
        spark.range(0, slots)
        .select(F.col("id").alias("slot"), F.expr(f"id div {chunk}").alias("chunk"), point.alias("point"), F.lit(1).alias("one"))
        .withColumn("cell", F.floor(F.col("point") * n_shares))
        .join(cells, "cell")
        # the last share has no upper end, whatever rounding made of it
        .where("low <= point AND (point < high OR high >= 1)")
        .select("slot", "chunk", "source", "one")
    )
    return running_total(dealt, ["source"], [F.col("slot")], F.col("chunk"), "one", "rank").select(
        "slot", "source", "rank"
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
    max_slots: int = 1 << 22,
    least_block: int = 16,
    most: int = 2,
) -> DataFrame:
    """One row per input row: id, tie, size, source, source_size, target, start, taken.

    ``size`` is the number of words (null text: 0); ``taken`` is how many words
    of the row the schedule takes, repeats counted, at most ``most`` times its
    size; over a source it sums to the rounded target. The block is the total
    target over ``max_slots``, at least ``least_block`` words, so the schedule
    never outgrows ``max_slots`` rows. Slots that a source doesn't need are left
    out, those it lacks follow the schedule, and its last one ends at the target.
    Null sources are one source of their own; null ids and rows that repeat an
    id are rows like any other (rows equal in id, source and text may swap
    places, which changes no sum). An empty table gives no rows, and a table
    without words takes nothing.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = staged(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
        "mix-sizes",
    )
    targets = staged(source_targets(docs, most=float(most)), "mix-targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block = max(least_block, int(-(-total // max_slots)))
    slots = max(1, round(total / block)) if total else 0
    placed = token_streams(docs, seed)
    named = targets.select(F.col("source").alias("__s"), "source_size", "target")
    if not slots:
        return placed.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__s")), "left").select(
            "id", "tie", "size", "source", "source_size", "target", "start", F.lit(0).cast("long").alias("taken")
        )
    goal, rest = F.round("target").cast("long"), F.expr("cast(round(target) as long) % source_size")
    needs = named.where("source_size > 0").select(
        "__s",
        F.ceil(F.col("source_size") / block).alias("blocks"),
        rest.alias("rest"),
        (F.floor(goal / F.col("source_size")) * F.ceil(F.col("source_size") / block) + F.ceil(rest / block)).alias("needed"),
    )
    dealt = staged(
        schedule(spark, targets, block, slots)
        .join(needs, F.col("source").eqNullSafe(F.col("__s")))
        .where("rank < needed")
        .groupBy(F.col("source").alias("__src"), (F.col("rank") % F.col("blocks")).alias("__block"))
        .agg(F.count(F.lit(1)).alias("times")),
        "mix-blocks",
    )
    got = dealt.groupBy(F.col("__src").alias("__g")).agg(F.sum("times").alias("got"))
    lacking = (
        needs.join(got, F.col("__s").eqNullSafe(F.col("__g")), "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < needed")
        .select(F.col("__s").alias("__src"), "blocks", F.explode(F.expr("sequence(got, needed - 1)")).alias("rank"))
        .select("__src", (F.col("rank") % F.col("blocks")).alias("__block"), F.lit(1).cast("long").alias("times"))
    )
    blocks = (
        dealt.unionByName(lacking)
        .groupBy("__src", "__block")
        .agg(F.sum("times").alias("times"))
        .join(F.broadcast(needs.select("__s", "rest")), F.col("__src").eqNullSafe(F.col("__s")))
        .drop("__s")
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("__block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        .withColumn(
            "part",
            F.least(F.col("start") + F.col("size"), (F.col("__block") + 1) * block)
            - F.greatest(F.col("start"), F.col("__block") * block),
        )
        .withColumnRenamed("__block", "__b")
    )
    # the last slot of a source takes its block up to ``rest`` only
    last = F.expr(f"rest % {block} > 0 AND __b = rest div {block}")
    beyond = F.greatest(F.lit(0), F.least("part", F.greatest("start", F.col("__b") * block) + F.col("part") - F.col("rest")))
    taken = (
        pieces.join(blocks, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__b") == F.col("__block")))
        .groupBy("id", "tie", "source", "start")
        .agg(F.sum(F.col("part") * F.col("times") - F.when(last, beyond).otherwise(0)).alias("got"))
        .select(
            F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__src"),
            F.col("start").alias("__start"), "got",
        )
    )
    same = (
        (F.col("tie") == F.col("__tie"))
        & (F.col("start") == F.col("__start"))
        & F.col("id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__src"))
        & (F.col("size") > 0)
    )
    return (
        placed.join(taken, same, "left")
        .join(named, F.col("source").eqNullSafe(F.col("__s")), "left")
        .select(
            "id", "tie", "size", "source", "source_size", "target", "start",
            F.coalesce("got", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows: each document as often as the schedule takes it.

    A document taken 1.5 times gives one whole row and one row of its leading
    words, up to the last word taken; one not taken gives none. Other columns
    are passed through. Rows equal in id, text and source share what the
    schedule takes of them.
    """
    shares = (
        mix_sources(df, id_col, text_col, source_col)
        .where("taken > 0")
        .groupBy("id", "tie", "source", "size")
        .agg(F.expr("sum(taken) div count(1)").alias("__taken"))
        .select(
            F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"),
            F.col("size").alias("__size"), "__taken",
        )
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row travels as one struct, so no column of the input can clash with a helper
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text).alias("tie"),
        F.col(text_col).alias("text"),
    )
    same = (
        (F.col("tie") == F.col("__tie"))
        & F.col("id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
    )
    copies = F.expr("sequence(1, cast(ceil(__taken / __size) as int))")
    part = F.col("__taken") - (F.col("copy") - 1) * F.col("__size")
    words = F.regexp_extract_all(F.col("text"), F.lit(f"([{chr(9)}-{chr(13)} ]*{WORD})"), F.lit(1))
    cut = F.when(part >= F.col("__size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), ""))
    return (
        rows.join(shares, same)
        .withColumn("copy", F.explode(copies))
        .withColumn("text", cut)
        .select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])
    )
