"""Scans with contracts (inventory section 1)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, level int, heading string, parents_context string, content string, search_text string, "
    "prev_chunk_id string, next_chunk_id string, page_hint int, has_table boolean, table_refs array<string>, char_count int, "
    "line_count int, children_count int, metadata map<string,string>, summary string, hyde_questions array<string>, hyde_strategy string"
)
NODE_SCHEMA = "id string, label string, name string, properties string"
EDGE_SCHEMA = "source string, target string, relation string, properties string"


def struct_fields(ddl: str) -> str:
    """``a string, b map<string,int>`` as the fields of a struct type."""
    return ", ".join(f.replace(" ", ": ", 1) for f in ddl.split(", "))


def must(df: DataFrame, failing: Column, message: str) -> DataFrame:
    """The same rows; the first row for which ``failing`` holds stops the job."""
    return df.where(F.when(failing, F.raise_error(F.lit(message))).otherwise(F.lit(True)))


def read_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """A corpus of JSON array files, with ``file`` and the position in it, which is the corpus order.

    Each file must hold one document and no document may be in two files.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    rows = files.select("file", F.posexplode(F.from_json("value", f"array<struct<{struct_fields(CHUNK_SCHEMA)}>>")).alias("position", "row")).select("file", "position", "row.*")
    per_file = rows.groupBy("file").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("doc"))
    bad = per_file.where("docs != 1 OR doc = ''").select("file").union(
        per_file.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n > 1").select("file")
    )
    return rows.join(bad.withColumn("__bad", F.lit(True)), "file", "left").transform(
        lambda d: must(d, F.col("__bad").isNotNull(), "a file needs one document of its own")
    ).drop("__bad")


def corpus_position(chunks: DataFrame) -> DataFrame:
    """Adds ``corpus_pos``: file order, then order inside the file; counted per file plus the files before."""
    sizes = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(sizes.select("file", before.alias("base")), "file").withColumn("corpus_pos", F.col("base") + F.col("position")).drop("base")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per non-blank line; a line that is none stops the job with its file named."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = ~F.trim("value").startswith("{") | F.col("row").isNull()
    return parsed.where(F.when(bad, F.raise_error(F.concat(F.lit("no object in "), "file"))).otherwise(F.lit(True))).select("row.*")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot; an edge to an unknown node stops the job."""
    nodes = read_jsonl(spark, f"{folder}/nodes.jsonl", NODE_SCHEMA)
    edges = read_jsonl(spark, f"{folder}/edges.jsonl", EDGE_SCHEMA)
    ids = nodes.select("id")
    for end in ("source", "target"):
        known = ids.select(F.col("id").alias("__id"))
        edges = must(edges.join(known, F.col(end) == F.col("__id"), "left"), F.col("__id").isNull(), f"an edge has an unknown {end}").drop("__id")
    return nodes, edges


def second_parents(edges: DataFrame) -> DataFrame:
    """Nodes with more than one tree parent."""
    return edges.where("relation = 'PARENT_OF'").groupBy("target").agg(F.count_distinct("source").alias("parents")).where("parents > 1")


def projected_graph(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Edges of some relations; parallel ones merge and keep the set of their property hashes."""
    kept = edges.where(F.col("relation").isin(*relations))
    return kept.groupBy("source", "relation", "target").agg(F.array_sort(F.collect_set(F.sha2("properties", 256))).alias("provenance"))


def table_records(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Table rows with a summary whose chunk is known, with its document and heading."""
    known = chunks.select("chunk_id", "heading")
    kept = tables.where(F.trim(F.coalesce("table_summary", F.lit(""))) != "").join(known, "chunk_id")
    return kept.withColumn("doc_id", F.regexp_extract("chunk_id", r"^(.*)_C\d+", 1))


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns strings, a leading byte-order mark tolerated."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def retrying(fetch: Callable[[str], bytes], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> Callable[[str], bytes]:
    """A fetcher that tries again after 1, 2, 4 ... seconds."""

    def run(url: str) -> bytes:
        for n in range(attempts):
            try:
                return fetch(url)
            except (OSError, ValueError):
                if n + 1 == attempts:
                    raise
                wait(2.0**n)
        raise ValueError("no attempts")

    return run


def paged_snapshot(spark: SparkSession, total: int, page: int, fetch: Callable[[int, int], bytes]) -> DataFrame:
    """``skip, body, sha256`` of every page of a paged service, fetched on the executors."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for skip in batch.column(0).to_pylist():  # a page at a time, whatever its size
                yield pa.RecordBatch.from_pydict({"skip": [skip], "body": [fetch(skip, page)]}, schema=kinds)

    kinds = pa.schema([("skip", pa.int64()), ("body", pa.binary())])
    skips = spark.range(0, total, page).select(F.col("id").alias("skip"))
    return skips.mapInArrow(get, "skip long, body binary").withColumn("sha256", F.sha2("body", 256))


def verified_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages whose bytes still have the manifest's hash; any other stops the job."""
    joined = pages.join(manifest.select("skip", F.col("sha256").alias("__said")), "skip", "left")
    return must(joined, ~F.col("__said").eqNullSafe(F.sha2("body", 256)), "a page differs from its manifest").drop("__said")


def read_shortages(pages: DataFrame) -> DataFrame:
    """Flat shortage records out of raw pages; missing text is empty, missing lists are empty."""
    names = ["package_ndc", "generic_name", "company_name", "status", "availability", "shortage_reason", "initial_posting_date"]
    record = ", ".join(f"{n}: string" for n in names) + ", openfda: struct<substance_name: array<string>, rxcui: array<string>>"
    body = F.from_json(F.col("body").cast("string"), f"results array<struct<{record}>>")
    rows = pages.select(F.explode(body["results"]).alias("r"))
    text = [F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in names]
    return rows.select(*text, F.coalesce("r.openfda.substance_name", F.array().cast("array<string>")).alias("ingredients"))


def prohibited(bundle: DataFrame, flag: str = "prohibited_for_formal_evaluation") -> DataFrame:
    """Queries of a bundle that may be run: blank ones go, a prohibited bundle stops the job."""
    return must(bundle, F.coalesce(F.col(flag), F.lit(False)), "the bundle is prohibited").where(F.trim("query") != "")


def magic_checked(files: DataFrame, magic: bytes = b"%PDF-") -> DataFrame:
    """Binary files with a short hash and whether they begin as they should."""
    begins = F.substring("content", 1, len(magic)) == F.lit(magic)
    return files.select("path", "length", F.left(F.sha2("content", 256), F.lit(16)).alias("hash"), begins.alias("valid"))
