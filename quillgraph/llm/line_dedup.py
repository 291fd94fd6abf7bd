"""Removal of repeated passages of two lines or more.

Every pair of neighbouring lines is looked up, so what is found doesn't depend
on where a passage begins or ends or on the lines around it: a passage of two
lines or more that stands in an earlier place is covered by pairs that do. A
rolling hash over the hashes of both lines counts the pairs over all documents;
those that repeat are compared byte by byte with their first occurrence and
removed where they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillgraph.llm.common import staged

SPAN = 2
LAST = (1 << 63) - 1


def line_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk of a text: all pairs of neighbouring lines, overlapping."""
    return [(i, SPAN) for i in range(len(lines) - SPAN + 1)]


def pair_hashes(lines: list[bytes]) -> np.ndarray:
    """A signed hash of every pair of neighbouring lines."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    return (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]).view(np.int64)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tie, text) to the hash of every pair of lines."""
    for batch in batches:
        docs, ties, counts, hashes = [], [], [], []
        for doc, tie, value in zip(*batch.columns, strict=True):
            lines = value.as_py().encode().split(b"\n")
            if len(lines) < SPAN:
                continue
            docs.append(doc.as_py())
            ties.append(tie.as_py())
            counts.append(len(lines) - SPAN + 1)
            hashes.append(pair_hashes(lines))
        if hashes:
            columns = [
                np.repeat(np.array(docs, np.int64), counts),
                np.repeat(np.array(ties, np.int64), counts),
                np.concatenate([np.arange(n, dtype=np.int32) for n in counts]),
                np.concatenate(hashes),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "tie", "first", "hash"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tie, text, flags) to the bytes of the flagged chunks."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("hash", pa.int64()), ("chunk", pa.binary())])
    for batch in batches:
        rows = []
        for doc, tie, value, flags in zip(*batch.columns, strict=True):
            lines = value.as_py().encode().split(b"\n")
            rows += [
                {"doc": doc.as_py(), "tie": tie.as_py(), **f, "chunk": b"\n".join(lines[f["first"] : f["first"] + SPAN])}
                for f in flags.as_py()
            ]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with repeated passages of lines taken out of ``text_col``.

    Adds ``n_lines`` and ``n_removed`` (lines, before and taken out); a column
    of the input with such a name is replaced. The occurrence with the smallest
    (id, line) stays, null ids coming last, and a line that is taken out stays in
    at least one other place. A pair that shares a line with its own first
    occurrence (three equal lines in a row) is no repeat. An empty line is a
    line like any other. Removed lines go with their line ends; what is left is joined by line feeds, and a text may end up empty but
    its row stays. A null text stays null, with 0 lines. Rows that share id and
    text share their fate, also where the id is null; single lines, however
    frequent, stay. Pairs that share a hash are told apart by their bytes. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    chunks = docs.mapInArrow(_chunk_rows, "doc long, tie long, first int, hash long")
    repeated = staged(
        chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash"), "line-repeated"
    )
    flags = (
        chunks.join(repeated, "hash", "left_semi").groupBy("doc", "tie").agg(F.collect_set(F.struct("first", "hash")).alias("flags"))
    )
    pieces = staged(
        docs.join(flags, ["doc", "tie"])
        .select("doc", "tie", "text", "flags")
        .mapInArrow(_text_rows, "doc long, tie long, first int, hash long, chunk binary"),
        "line-chunks",
    )
    # equal bytes, not only equal hashes: the first of them stays
    leaders = staged(
        pieces.groupBy("hash", "chunk").agg(F.min(F.struct("doc", "first", "tie")).alias("leader")).select("hash", "chunk", "leader"),
        "line-leaders",
    )
    near = F.expr(f"doc = leader.doc AND tie = leader.tie AND first < leader.first + {SPAN}")
    cuts = (
        pieces.join(leaders, ["hash", "chunk"])
        .where(~near)
        .groupBy("doc", "tie")
        .agg(F.collect_set("first").alias("cuts"))
        .select(F.col("doc").alias("cut_doc"), F.col("tie").alias("cut_tie"), "cuts")
    )
    names = [c for c in df.columns if c not in (text_col, "n_lines", "n_removed")]
    # the row travels as one struct, so no column of the input can clash with a helper
    wide = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.lit(None).cast("int").alias("row"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("tie"),
    )
    joined = wide.join(cuts, (F.col("doc") == F.col("cut_doc")) & (F.col("tie") == F.col("cut_tie")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for value, cuts in zip(batch.column(1), batch.column(2), strict=True):
                text = value.as_py()
                total = 0 if text is None else text.count("\n") + 1
                gone = 0
                if text is not None and cuts.is_valid:
                    lines = text.split("\n")
                    drop = {i for first in cuts.as_py() for i in range(first, first + SPAN)}
                    gone = len(drop)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(text)
                totals.append(total)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                names=["row", "text", "n_lines", "n_removed"],
            )

    schema = StructType([
        StructField("row", wide.schema["row"].dataType), StructField("text", StringType()),
        StructField("n_lines", LongType()), StructField("n_removed", LongType()),
    ])
    out = joined.select("row", "text", "cuts").mapInArrow(cut, schema)
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    return out.select(
        *[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept], "n_lines", "n_removed"
    )
