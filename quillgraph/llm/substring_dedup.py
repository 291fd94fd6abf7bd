"""Removal of repeated word windows across documents.

Every window of a fixed number of words gets a Rabin-Karp hash. Each window is
filed under its anchor, the least hash among the shorter windows inside it, so
equal windows always have equal anchors. Anchors are counted first; only what
lies under an anchor of two or more documents goes on. Neighbouring windows of
one anchor form a run. A run that some smaller document holds word for word is
removed as a whole; where runs of one anchor differ, their windows are counted
one by one, once for each different run. Removed windows merge into maximal
intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import staged
from quillgraph.llm.hashing import Rolling, WordHashes, mix, sliding_min

RUNS = "doc long, tie int, anchor long, content long, first int, n int"
PIECES = "doc long, tie int, anchor long, window long, first int"


def _tie(raw: bytes) -> int:
    """Tells rows apart that share an id but not a text."""
    return xxhash.xxh32_intdigest(raw) - (1 << 31)


def _anchors(rolling: Rolling, window: int) -> np.ndarray:
    """The anchor of every window of a text."""
    inner = max(1, window // 2)
    return sliding_min(mix(rolling.windows(inner)), window - inner + 1)


def _runs_of(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal anchors."""
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    return first, np.diff(np.append(first, len(anchors)))


def _run_rows(window: int):
    """Arrow batches of (id, text) to the runs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts, rows = [], 0
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                raw = (value.as_py() or "").encode()
                words = raw.split()
                if not doc.is_valid or len(words) < window:
                    continue
                rolling = Rolling(hashes.of(words))
                anchors = _anchors(rolling, window)
                first, n = _runs_of(anchors)
                content = mix(rolling.spans(first, n + window - 1) + n.astype(np.uint64))
                parts.append((np.full(len(first), doc.as_py()), np.full(len(first), _tie(raw)), anchors[first].view(np.int64), content.view(np.int64), first, n))
                rows += len(first)
                if rows > 200_000:
                    yield _batch(parts, RUNS)
                    parts, rows = [], 0
            if parts:
                yield _batch(parts, RUNS)

    return run


def _batch(parts: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    fields = [f.split() for f in schema.split(", ")]
    columns = [np.concatenate(c).astype(kinds[k]) for c, (_, k) in zip(zip(*parts, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n for n, _ in fields])


def _window_rows(window: int):
    """Arrow batches of (id, text, open runs) to the windows of those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts, rows = [], 0
            for doc, value, wanted in zip(*batch.columns, strict=True):
                if not wanted.is_valid:
                    continue
                raw = (value.as_py() or "").encode()
                tie = _tie(raw)
                spans = [(r["first"], r["n"]) for r in wanted.as_py() if r["tie"] == tie]
                if not spans:
                    continue
                rolling = Rolling(hashes.of(raw.split()))
                anchors, windows = _anchors(rolling, window), rolling.windows(window)
                at = np.concatenate([np.arange(f, f + n) for f, n in spans])
                parts.append((np.full(len(at), doc.as_py()), np.full(len(at), tie), anchors[at].view(np.int64), mix(windows[at]).view(np.int64), at))
                rows += len(at)
                if rows > 200_000:
                    yield _batch(parts, PIECES)
                    parts, rows = [], 0
            if parts:
                yield _batch(parts, PIECES)

    return run


def removal_intervals(docs: DataFrame, window: int = 50) -> DataFrame:
    """Runs of windows to remove: ``doc, tie, first, n``, from rows ``doc, text``.

    The ``n`` windows from word ``first`` on each occur in a document with a
    smaller id. Three tables are written to the shared folder on the way.
    """
    runs = docs.mapInArrow(_run_rows(window), RUNS)
    repeated = staged(
        runs.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"),
        "substring-anchors",
    )
    shared = staged(runs.join(repeated, "anchor", "left_semi"), "substring-runs")
    contents = shared.groupBy("anchor", "content").agg(F.min("doc").alias("least"))
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    ranked = staged(contents.join(several, "anchor"), "substring-contents")
    known = shared.join(ranked, ["anchor", "content"])
    whole = known.where("doc > least").select("doc", "tie", "first", "n")
    open_runs = (
        known.where("doc = least AND kinds > 1")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("tie", "first", "n")).alias("wanted"))
    )
    pieces = (
        docs.join(open_runs, "doc").select("doc", "text", "wanted").mapInArrow(_window_rows(window), PIECES)
    )
    pieces = staged(pieces, "substring-windows")
    least = pieces.groupBy(F.col("anchor").alias("a"), F.col("window").alias("w")).agg(F.min("doc").alias("least"))
    single = (
        pieces.join(least, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")))
        .where("doc > least")
        .select("doc", "tie", "first", F.lit(1).alias("n"))
    )
    return whole.unionByName(single)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text.

    A word goes if a window over it also starts in a document with a smaller
    id; all windows are judged on the input. ``kept_text`` joins the words left
    by one space. Null texts have no words. Rows with a null id neither lose
    words nor cost others any; rows that share an id count as one document, so
    they take nothing from each other. Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = removal_intervals(docs, window).groupBy("doc").agg(F.collect_set(F.struct("tie", "first", "n")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for value, cuts in zip(batch.column(1), batch.column(2), strict=True):
                raw = value.as_py().encode()
                words = raw.split()
                if cuts.is_valid:
                    tie, marks = _tie(raw), np.zeros(len(words) + 1, np.int64)
                    for c in cuts.as_py():
                        if c["tie"] == tie:
                            marks[c["first"]] += 1
                            marks[c["first"] + c["n"] + window - 1] -= 1
                    left = (np.cumsum(marks[:-1]) == 0).tolist()
                    keep = [w for w, ok in zip(words, left, strict=True) if ok]
                else:
                    keep = words
                total.append(len(words))
                removed.append(len(words) - len(keep))
                kept.append(b" ".join(keep).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_words", "n_removed", "kept_text"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return (
        docs.join(cuts, "doc", "left")
        .select("doc", "text", "cuts")
        .mapInArrow(run, "doc long, n_words long, n_removed long, kept_text string")
        .select(F.col("doc").cast(kind).alias(id_col), "n_words", "n_removed", "kept_text")
    )

