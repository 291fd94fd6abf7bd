"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.byte_bpe import codec, round_trip
from quillgraph.llm.common import WORD, spread
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.gif import gif_frames, media_columns, with_media
from quillgraph.llm.line_dedup import line_dedup
from quillgraph.llm.mixing import mix_sources, source_targets
from quillgraph.llm.substring_dedup import substring_dedup
from quillgraph.llm.superminhash import near_duplicates
from quillgraph.llm.token_shards import bpe_ids, write_shards
from quillgraph.llm.toxicity import score_toxicity, train
from quillgraph.llm.url_rules import filter_urls

#: The rank file of the byte-level vocabulary, as a parameter of the queries.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores, whatever its number of splits."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Token counts and digests of encoding and decoding, for all documents."""
    return round_trip(_table(spark, sf_dir, "documents"), codec(ranks, public_tokenizers.PATTERN))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy of every text stays, for all documents."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document go as repeated chunks, and what stays."""
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated 50-word windows are removed."""
    kept = substring_dedup(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken"
    )


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as GIF and read back."""
    described = media_columns(_table(spark, sf_dir, "documents"))
    return described.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def gif_frames_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed frames of every document stored as GIF, as they are shown."""
    frames = gif_frames(with_media(_table(spark, sf_dir, "documents")), "doc_id", "media")
    return frames.withColumn("rgba_sha256", F.sha2("rgba", 256)).drop("rgba")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target, in words, of every source of documents."""
    docs = _table(spark, sf_dir, "documents")
    sizes = docs.select("source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    return source_targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


def op9_token_shards(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Where every sequence of token ids of all documents lies in the shards."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")  # as it lies in its files
    return write_shards(documents, ids=bpe_ids(codec(ranks, public_tokenizers.PATTERN)))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on 3-word shingles at 85 %."""
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_gif_media": op8_gif_media,
    "op9_token_shards": op9_token_shards,
    "op10_superminhash": op10_superminhash,
    "gif_frames": gif_frames_table,
    "mix_targets": mix_targets,
}

#: words of a text, as the contracts have them
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)
    """,
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        pairs AS (
            SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] AS pair
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM d)
        ),
        first AS (SELECT pair, min(struct_pack(doc_id := doc_id, i := i)) AS place FROM pairs GROUP BY pair HAVING count(*) > 1),
        gone AS (
            SELECT doc_id, list(DISTINCT i) AS cut FROM (
                SELECT p.doc_id, unnest([p.i, p.i + 1]) AS i FROM pairs p JOIN first f USING (pair)
                WHERE NOT (p.doc_id = f.place.doc_id AND p.i <= f.place.i + 1)
            ) GROUP BY doc_id
        )
        SELECT d.doc_id,
               CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
               coalesce(len(cut), 0) AS n_removed,
               sha256(array_to_string(
                   [x[1] FOR x IN list_zip(lines, range(1, len(lines) + 1)) IF NOT coalesce(list_contains(cut, x[2]), false)],
                   chr(10))) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op4_url_filter": r"""
        WITH parsed AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) AS query
            FROM pages
        ),
        cut AS (
            SELECT *, [x FOR x IN string_split(host, '.') IF x != ''] AS labels,
                   regexp_extract(path, '\.([A-Za-z][A-Za-z0-9]*)$', 1) AS kind
            FROM parsed
        ),
        urls AS (
            SELECT page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(flatten([
                ['host=' || array_to_string(labels[i:], '.') FOR i IN range(1, greatest(len(labels), 1) + 1)],
                ['word=' || x FOR x IN string_split_regex(host, '[.-]') IF x != ''],
                ['path=' || regexp_replace(x, '[0-9]+', '#', 'g') FOR x IN string_split(path, '/') IF x != ''],
                CASE WHEN kind = '' THEN [] ELSE ['type=' || lower(kind)] END,
                ['query=' || split_part(x, '=', 1) FOR x IN string_split(query, '&') IF x != '']
            ]))) END AS tokens
            FROM cut
        ),
        known AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
        baskets AS (SELECT tokens, bad FROM urls JOIN known ON page_id = doc_id WHERE len(tokens) > 0),
        totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM baskets),
        subsets AS (
            SELECT [tokens[k] FOR k IN range(1, len(tokens) + 1) IF (mask >> (k - 1)) & 1 = 1] AS sub, bad
            FROM (SELECT tokens, bad, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS mask FROM baskets)
        ),
        counts AS (SELECT sub, count(*) AS seen, count(*) FILTER (WHERE bad) AS bads FROM subsets GROUP BY sub),
        rated AS (
            SELECT sub, 'block' AS says, bads AS freq, CAST(bads AS DOUBLE) / n_bad AS mine,
                   CAST(seen - bads AS DOUBLE) / (n - n_bad) AS others, n
            FROM counts, totals WHERE bads >= 0.02 * n AND n_bad > 0 AND n_bad < n
            UNION ALL
            SELECT sub, 'allow', seen - bads, CAST(seen - bads AS DOUBLE) / (n - n_bad), CAST(bads AS DOUBLE) / n_bad, n
            FROM counts, totals WHERE seen - bads >= 0.02 * n AND n_bad > 0 AND n_bad < n
        ),
        scored AS (SELECT sub, says, mine / (mine + others) AS confidence, CAST(freq AS DOUBLE) / n AS support FROM rated),
        shorter AS (
            SELECT sub, says, confidence, [x FOR x IN sub IF x != token] AS part
            FROM (SELECT sub, says, confidence, unnest(sub) AS token FROM scored WHERE confidence >= 0.7 AND len(sub) > 1)
        ),
        beaten AS (
            SELECT DISTINCT a.sub, a.says FROM shorter a JOIN scored b ON b.sub = a.part AND b.says = a.says AND b.confidence >= a.confidence
        ),
        rules AS (SELECT * FROM scored WHERE confidence >= 0.7 AND (sub, says) NOT IN (SELECT (sub, says) FROM beaten)),
        best AS (
            SELECT tokens, max(struct_pack(confidence := confidence, support := support, says := says)) AS top
            FROM (SELECT DISTINCT tokens FROM urls) u JOIN rules ON list_has_all(u.tokens, rules.sub) GROUP BY tokens
        ),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
                WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
                WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
                WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
            FROM urls
        )
        SELECT page_id, host, path, rule,
               coalesce(CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
                             WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' END, best.top.says, 'allow') AS verdict
        FROM ruled LEFT JOIN best USING (tokens)
    """,
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
        ),
        least AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT doc_id, list(DISTINCT j) AS cut FROM (
                SELECT p.doc_id, unnest(range(i, i + 50)) AS j FROM windows p JOIN least USING (s) WHERE p.doc_id > low
            ) GROUP BY doc_id
        ),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) x
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(cut) AS j FROM gone) g WHERE g.doc_id = x.doc_id AND g.j = x.j)
            GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op10_superminhash": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
                JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n
            HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ),
        reach AS (
            SELECT doc_id, doc_id AS seen FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
        ),
        least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM least LEFT JOIN sizes USING (doc_id)
    """,
    "mix_targets": f"""
        WITH RECURSIVE sized AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
        weighed AS (
            SELECT source, source_size, 2.0 * source_size AS cap,
                   [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
                   1.5 * sum(source_size) OVER () AS total
            FROM sized
        ),
        -- share out, cap what is above, and share the excess out again, until nothing is above
        rounds AS (
            SELECT 0 AS step, source, source_size, cap, weight, total, weight * total / sum(weight) OVER () AS target FROM weighed
            UNION ALL
            SELECT step + 1, source, source_size, cap, weight, total,
                   CASE WHEN target >= cap THEN cap
                        ELSE weight * (total - sum(CASE WHEN target >= cap THEN cap ELSE 0 END) OVER ())
                             / sum(CASE WHEN target >= cap THEN 0 ELSE weight END) OVER () END
            FROM rounds WHERE step < (SELECT count(*) FROM weighed)
        )
        SELECT source, source_size, round(CAST(target AS DOUBLE), 6) AS target
        FROM rounds WHERE step = (SELECT count(*) FROM weighed)
    """,
}
