"""A training-corpus pipeline over ``documents``.

Toxic documents go, repeated line chunks are removed, one document of each
group of near-duplicates stays, sources are mixed to their target weights, and
what is left is encoded. Every stage but the last returns the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.byte_bpe import codec, round_trip
from quillgraph.llm.common import spread, staged
from quillgraph.llm.line_dedup import line_dedup
from quillgraph.llm.mixing import mixed_documents
from quillgraph.llm.superminhash import near_duplicates
from quillgraph.llm.toxicity import keep_clean, train

#: The rank file of the byte-level vocabulary, as a parameter of the last stage.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on ``labels`` doesn't find toxic (score below one half).

    A null or empty text is judged as one without evidence; null and repeated
    ids are rows like any other; other columns pass through. Without labels of
    both kinds no document goes, unless all labels are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that an earlier document has; ``n_chars`` is counted anew.

    No row goes: a text may end up empty, a null text stays null. Rows that
    share id and text share their fate; null ids come last.
    """
    kept = line_dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked at 80 % on 5-word shingles.

    Empty and null texts link with nothing, so they stay, as do null ids. Rows
    that share an id go or stay together.
    """
    copies = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, the last time perhaps in part; ``n_chars`` is counted anew.

    Documents without words are in no block, so the mix doesn't take them. Null
    sources are one source; null and repeated ids are rows like any other.
    """
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; a null text counts as empty."""
    return round_trip(docs, codec(RANKS, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

#: Learned scores, hashes and merges are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each is written and read again before the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = spread(staged(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
