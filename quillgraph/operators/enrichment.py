"""Model-made columns behind guards (inventory section 4).

Models are functions of a list of prompts; results are kept in a table that
later runs anti-join, so nothing is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IRRELEVANT, INSUFFICIENT = "[IRRELEVANT_SOURCE]", "[INSUFFICIENT_SOURCE]"


def eligible(chunks: DataFrame, questions: bool = True) -> DataFrame:
    """Adds what a chunk gets: a summary from 20 lines or 1500 characters, questions from 100, strategy C1 above 500."""
    return chunks.withColumn("summary_eligible", (F.col("line_count") >= 20) | (F.col("char_count") >= 1500)).withColumn(
        "hyde_eligible", F.lit(questions) & (F.col("char_count") >= 100)
    ).withColumn("hyde_strategy", F.when(F.col("char_count") > 500, "C1").otherwise("C2"))


def complete(prompts: DataFrame, model: Callable[[list[str]], list[str]], cache: DataFrame | None = None) -> DataFrame:
    """``key, answer`` for prompts ``key, prompt``; cached keys are not asked, empty answers are not kept."""
    wanted = prompts.dropDuplicates(["key"])
    if cache is not None:
        wanted = wanted.join(cache, "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "answer": model(pdf["prompt"].tolist())})

    fresh = wanted.select("key", "prompt").mapInPandas(run, "key string, answer string").where("answer != ''")
    return fresh if cache is None else cache.join(prompts.select("key").distinct(), "key", "left_semi").unionByName(fresh)


def with_summaries(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds ``summary`` and puts it into ``search_text``; an answer that finds the source irrelevant is none."""
    named = answers.select(F.col("key").alias("chunk_id"), F.nullif(F.trim("answer"), F.lit(IRRELEVANT)).alias("summary"))
    text = F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in ("parents_context", "heading", "summary", "content")])
    joined = chunks.join(named, "chunk_id", "left")
    return joined.withColumn("search_text", F.when(F.col("summary").isNotNull(), text).otherwise(F.col("search_text")))


def question_lines(answer: Column) -> Column:
    """Lines of an answer without list marks, empty ones left out."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda x: x != "")


def guarded_questions(chunks: DataFrame, answers: DataFrame, keep: int = 2) -> DataFrame:
    """Questions that pass the guards, the first ``keep``, with counts of the others by reason.

    Rejected: shorter than 25 characters or without a question mark; with
    Chinese, Japanese or Korean letters; over 340 characters; naming an
    authority or a guideline code that the chunk does not name.
    """
    joined = chunks.join(answers.select(F.col("key").alias("chunk_id"), "answer"), "chunk_id")
    source = F.upper(F.regexp_replace(F.concat_ws(" ", "heading", "parents_context", "content"), r"[^A-Za-z0-9 ]", ""))
    squeezed = F.replace(source, F.lit(" "), F.lit(""))
    rows = joined.select("chunk_id", squeezed.alias("source"), F.posexplode(question_lines(F.col("answer"))).alias("place", "question"))
    names = F.concat(
        F.regexp_extract_all(F.upper("question"), F.lit(r"\b(?:FDA|WHO|EMA|ICH)\b"), F.lit(0)),
        F.regexp_extract_all(F.upper("question"), F.lit(r"\bICH\s+[A-Z]\d+[A-Z]?(?:\(R\d+\))?"), F.lit(0)),
    )
    bare = F.transform(names, lambda x: F.regexp_replace(x, "[^A-Z0-9]", ""))
    reason = (
        F.when((F.length("question") < 25) | ~F.contains("question", F.lit("?")), "malformed")
        .when(F.col("question").rlike(r"[぀-ヿ㐀-鿿가-힯]"), "cjk")
        .when(F.length("question") > 340, "too_long")
        .when(F.exists(bare, lambda n: ~F.contains(F.col("source"), n)), "unsupported_reference")
    )
    judged = rows.withColumn("reason", reason)
    good = F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("place", "question")))), lambda x: x["question"])
    return judged.groupBy("chunk_id").agg(
        F.slice(good, 1, keep).alias("hyde_questions"),
        *[F.count_if(F.col("reason") == r).alias(f"{r}_filtered") for r in ("malformed", "cjk", "too_long", "unsupported_reference")],
    )


def html_table_summary(table: Column) -> Column:
    """A sentence on an HTML table: its rows and up to five column names."""
    cells = lambda tag: F.transform(
        F.slice(F.regexp_extract_all(table, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), 1, 8),
        lambda x: F.left(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(80)),
    )
    first = F.regexp_extract(table, r"(?is)<tr\b.*?</tr>", 0)
    first_cells = F.transform(F.regexp_extract_all(first, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    heads = F.when(F.size(cells("th")) > 0, cells("th")).otherwise(first_cells)
    rows = F.size(F.regexp_extract_all(table, F.lit(r"(?i)<tr\b"), F.lit(0))) - F.when(F.size(cells("th")) > 0, 1).otherwise(0)
    return F.concat(F.lit("Table with "), rows.cast("string"), F.lit(" rows and columns: "), F.array_join(F.slice(heads, 1, 5), ", "))


def question_pairs(chunks: DataFrame, answers: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``pair_id, chunk_id, question, answer``: three questions for chunks of 500 characters and more, else one."""
    joined = chunks.join(answers.select(F.col("key").alias("chunk_id"), F.col("answer").alias("raw")), "chunk_id")
    many = F.when(F.col("char_count") >= 500, 3).otherwise(1)
    asked = F.slice(F.filter(question_lines(F.col("raw")), lambda q: F.length(q) > 5), F.lit(1), many)
    pairs = joined.select("chunk_id", F.explode(asked).alias("question"), F.left("content", F.lit(2000)).alias("answer"))
    named = pairs.withColumn("pair_id", F.concat_ws("_", "chunk_id", F.left(F.md5("question"), F.lit(8))))
    return named if done is None else named.join(done.select("pair_id"), "pair_id", "left_anti")


def inventory(chunks: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """One row: documents, chunks, longest and empty chunks, excluded documents that are present."""
    return chunks.agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("chunk_id").alias("chunk_ids"),
        F.max(F.length("content")).alias("max_chars"),
        F.count_if(F.trim("content") == "").alias("empty_chunks"),
        F.count_if(F.col("doc_id").isin(*excluded) if excluded else F.lit(False)).alias("excluded_rows"),
    )


def call_volume(chunks: DataFrame) -> DataFrame:
    """How many model calls an enrichment would take."""
    marked = eligible(chunks)
    return marked.agg(F.count_if("summary_eligible").alias("summaries"), F.count_if("hyde_eligible").alias("questions"))


def hierarchy_units(chunks: DataFrame, parents: DataFrame, budget: int = 18_000) -> DataFrame:
    """What the summary of each section reads: itself and its children in order, as far as they fit.

    A child that does not fit is passed over and a later, smaller one may still
    be taken. ``parents``: ``chunk_id, parent``. Deeper sections come first.
    """
    children = chunks.join(parents, "chunk_id").where("parent IS NOT NULL").select(F.col("parent").alias("section"), "seq", "chunk_id", F.length("content").alias("size"))
    listed = children.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "size"))).alias("units"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))
    step = lambda s, u: F.when(
        s["used"] + u["size"] <= budget, F.struct((s["used"] + u["size"]).alias("used"), F.concat(s["taken"], F.array(u["chunk_id"])).alias("taken"))
    ).otherwise(s)
    packed = listed.withColumn("packed", F.aggregate("units", start, step))
    heads = chunks.select(F.col("chunk_id").alias("section"), "level")
    return packed.join(heads, "section").select("section", "level", F.col("packed.taken").alias("depends_on"), F.col("packed.used").alias("chars"))
