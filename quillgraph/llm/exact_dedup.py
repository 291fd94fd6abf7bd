"""Exact deduplication by progressive refinement.

Rows are grouped by text length, then by a hash of the length and a short
prefix; only rows whose group still holds two rows or more are digested in full
and grouped by that digest. What is shuffled is a few numbers a row, never a
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import staged

#: prefix hashes (8 bytes each) that are sent to every executor at most
MOST_SENT = 2_000_000


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _prefix(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix_chars))


def surviving_prefixes(df: DataFrame, text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """``prefix``: the prefix hashes that rows of equal length share, from one scan without a digest."""
    text = _text(text_col)
    narrow = staged(df.select(F.octet_length(text).alias("n_bytes"), _prefix(text, prefix_chars).alias("prefix")), "exact-prefixes")
    lengths = _shared(narrow, "n_bytes")
    return staged(_shared(narrow.join(lengths, "n_bytes", "left_semi"), "prefix"), "exact-survivors")


def surviving_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, most_sent: int = MOST_SENT
) -> DataFrame:
    """``id, digest`` of the rows whose length and prefix others share.

    Up to ``most_sent`` prefixes are broadcast and only the texts that pass are
    digested, where they are read. Beyond that a broadcast has no proven bound
    and moving texts to the prefixes would cost more than their digests, so
    digests are taken in the scan and filtered by a shuffled semi-join.
    """
    prefixes = surviving_prefixes(df, text_col, prefix_chars)
    text = _text(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), _prefix(text, prefix_chars).alias("prefix"))
    if prefixes.count() <= most_sent:
        return rows.join(F.broadcast(prefixes), "prefix", "left_semi").select("id", _digest(F.col("text")).alias("digest"))
    return rows.select("id", "prefix", _digest(F.col("text")).alias("digest")).join(prefixes, "prefix", "left_semi").select("id", "digest")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, most_sent: int = MOST_SENT
) -> DataFrame:
    """``digest, largest, size`` of every text that two rows or more have."""
    return (
        surviving_rows(df, id_col, text_col, prefix_chars, most_sent)
        .groupBy("digest")
        .agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, most_sent: int = MOST_SENT
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as
    empty. A null id never outranks another; a group of null ids only keeps
    them all. Rows that repeat both id and text are one row said twice: they
    share their verdict and both count in ``group_size``. Other input columns
    are not looked at, whatever their names. An empty table gives no rows.

    The groups come from ``exact_groups``, which digests only what the earlier
    steps leave. The digest of every row in the result is a column of the last
    projection and decides nothing.
    """
    groups = exact_groups(df, id_col, text_col, prefix_chars, most_sent)
    named = df.select(F.col(id_col).alias("id"), _digest(_text(text_col)).alias("digest"))
    return named.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("largest")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull(), F.lit(True))
        .otherwise(F.col("id").eqNullSafe(F.col("largest")))
        .alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two rows or more have."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
