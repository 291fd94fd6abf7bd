"""Record-level functions: names, templates, nested JSON, alignment and annotation steps (parts of sections 4 to 7, 17)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quillgraph.functions.text import TABLE_TERMS, has_phrase, jaccard, normalize, normalize_alias, significant_words
from quillgraph.scratch import staged

# --- text ---------------------------------------------------------------------


@F.pandas_udf(ArrayType(StringType()))
def normalized_tokens(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised, lower-cased runs of letters and digits; null gives none."""
    folded = texts.fillna("").map(lambda t: unicodedata.normalize("NFKC", t).lower())
    return folded.map(lambda t: "".join(c if c.isalnum() else " " for c in t).split())


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonically composed text."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(DoubleType())
def _matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    # the ratio of matching blocks is defined on the first 3,000 characters
    return pd.Series([SequenceMatcher(None, (a or "")[:3000], (b or "")[:3000], autojunk=False).ratio() for a, b in zip(left, right, strict=True)])


def content_similarity(left: Column, right: Column) -> Column:
    """1 if one normalised text holds the other, else the larger of word overlap and matching-block ratio; 0 for an empty side."""
    a, b = normalize(left), normalize(right)
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(empty, 0.0).when(inside, 1.0).otherwise(F.greatest(jaccard(significant_words(left), significant_words(right)), _matching_ratio(a, b)))


def is_table_evidence(heading: Column, content: Column, chunk_id: Column, table_ids: DataFrame | None = None) -> Column:
    """Whether a chunk shows a table: by its heading, a mark in its text, or a term at its start (800 characters, as defined)."""
    start = normalize(F.left(F.coalesce(content, F.lit("")), F.lit(800)))
    found = normalize(heading).rlike(r"(^| )tables?( |$)") | F.contains(F.coalesce(content, F.lit("")), F.lit("[表:"))
    for term in TABLE_TERMS:
        found = found | has_phrase(start, F.lit(term))
    return F.coalesce(found, F.lit(False))


def table_score(query: Column, title: Column, signals: Column, summary: Column) -> Column:
    """3 for a signal phrase that both texts hold, 0.35 a shared word, 0.1 for a summary; four decimals."""
    q, t = normalize(query), normalize(title)
    phrases = F.size(F.filter(signals, lambda s: has_phrase(q, s) & has_phrase(t, s)))
    shared = F.size(F.array_intersect(significant_words(query), significant_words(title)))
    return F.round(3.0 * phrases + 0.35 * shared + F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", 0.1).otherwise(0.0), 4)


def store_names(names: DataFrame, store: DataFrame) -> DataFrame:
    """``name, doc_id``: the stored id equal to a name, else the first that holds it or is held by it, else the name in snake case.

    ``store``: ``doc_id``, the fixed list of document ids.
    """
    key = lambda c: F.lower(F.trim(c))
    pairs = names.select("name", key(F.col("name")).alias("k")).distinct().join(
        F.broadcast(store.select("doc_id", key(F.col("doc_id")).alias("s"))),  # a list of documents by name
        F.contains("k", "s") | F.contains("s", "k"),
        "left",
    )
    best = pairs.groupBy("name", "k").agg(F.min_by("doc_id", F.struct((F.col("k") != F.col("s")).alias("partial"), "doc_id")).alias("doc_id"))
    return best.select("name", F.coalesce("doc_id", F.regexp_replace("k", r"\s+", "_")).alias("doc_id"))


def display_titles(chunks: DataFrame) -> DataFrame:
    """``doc_id, title``: the metadata title, else the first heading over 12 characters, else the id with spaces."""
    return chunks.groupBy("doc_id").agg(
        F.coalesce(
            F.min_by("title", F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("seq"))),
            F.min_by("heading", F.when(F.length("heading") > 12, F.col("seq"))),
            F.replace(F.first("doc_id").cast("string"), F.lit("_"), F.lit(" ")),
        ).alias("title")
    )


def entity_text(label: Column, name: Column, country: Column, detail: Column) -> Column:
    """A sentence on an entity by its label; clauses about what is unknown are left out."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    made = (
        F.when(label == "Manufacturer", F.concat(known(name), F.lit(" is a manufacturer, located in "), known(country), F.lit(", rated "), known(detail)))
        .when(label == "API", F.concat(known(name), F.lit(" is an active ingredient, of kind "), known(detail)))
        .otherwise(F.concat(known(name), F.lit(" is a "), F.lower(label), F.lit(", in "), known(country)))
    )
    return F.concat(F.regexp_replace(made, r", [a-z ]*unknown(?=,|$)", ""), F.lit("."))


def context_block(doc: Column, parents: Column, heading: Column, summary: Column, content: Column) -> Column:
    """A chunk as an answer's context: its place as a heading, then its summary or the start of its text (800 characters, as defined)."""
    place = F.concat_ws(" > ", F.nullif(F.trim(parents), F.lit("")), heading)
    body = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.left(content, F.lit(800)))
    return F.concat(F.lit("### ["), doc, F.lit("] "), place, F.lit("\n"), body)


# --- JSON ---------------------------------------------------------------------


def forbidden_paths(forbidden: list[str]):
    """A column function: dotted paths of forbidden keys anywhere in a JSON text, sorted; unreadable texts give none."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def walk(value, path):
            if isinstance(value, dict):
                for k, v in value.items():
                    here = f"{path}.{k}" if path else k
                    if k in forbidden:
                        yield here
                    yield from walk(v, here)
            elif isinstance(value, list):
                for i, v in enumerate(value):
                    yield from walk(v, f"{path}[{i}]")

        def of(t):
            try:
                return sorted(walk(json.loads(t), "")) if t else []
            except ValueError:
                return []

        return texts.map(of)

    return found


def harvested_questions(raw: Column) -> Column:
    """Distinct normalised questions under the question keys of a JSON text, at any depth, sorted."""
    values = F.regexp_extract_all(raw, F.lit(r'"(?:query|question|revised_query|original_query)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: normalize(v)), lambda v: v != "")))


# --- joins ---------------------------------------------------------------------


def resolved_entities(rows: DataFrame, known: DataFrame, name: str, prefix: str) -> DataFrame:
    """Adds ``entity``: the known id (``id, name``, the last of equal names) of a normalised name, else a hashed one."""
    index = known.groupBy(normalize_alias("name").alias("__n")).agg(F.max("id").alias("__id"))
    hashed = F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(F.coalesce(F.col(name), F.lit("")), 256), F.lit(20)))
    joined = rows.withColumn("__n", normalize_alias(name)).join(index, "__n", "left")
    return joined.withColumn("entity", F.coalesce("__id", hashed)).drop("__n", "__id")


def first_name_match(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """``name, id``: the first seed (``id, name, seq``) whose name holds a name; ``names`` is a short list of questions' names."""
    wanted = names.select(F.lower("name").alias("k"), "name").distinct()
    hits = seeds.select("id", "seq", F.lower("name").alias("s")).join(F.broadcast(wanted), F.contains("s", "k"))
    return hits.groupBy("name").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def aligned_candidates(left: DataFrame, right: DataFrame, group: str, score: Column, most: int = 3) -> DataFrame:
    """The best ``most`` rows of the same group for each row of ``left``.

    ``left``: ``group, old, old_text``; ``right``: ``group, new, new_text``; ``score`` reads both texts.
    """
    scored = left.join(right, group).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(group, "old").orderBy(F.round("score", 9).desc(), "new"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select(group, "old", "new", "score", "place")


def best_parents(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``section_id, chunk_id``: the chunk of a document for a section heading.

    Equal heading first, then one that holds the other, then the first of level
    1, then the first; candidates in the order of level, heading, id.
    ``wanted``: ``section_id, doc_id, section``; ``chunks``: ``chunk_id, doc_id, level, heading``.
    """
    pairs = wanted.join(chunks, "doc_id")
    priority = (
        F.when(F.col("heading") == F.col("section"), 0)
        .when(F.contains("heading", "section") | F.contains("section", "heading"), 1)
        .when(F.col("level") == 1, 2)
        .otherwise(3)
    )
    return pairs.groupBy("section_id").agg(F.min_by("chunk_id", F.struct(priority.alias("p"), "level", "heading", "chunk_id")).alias("chunk_id"))


def c2_context(chunks: DataFrame) -> DataFrame:
    """What a short chunk's questions may read: its document's scope, its neighbours and its first two children.

    ``chunks``: ``chunk_id, doc_id, seq, parent, heading, content``.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    near = chunks.withColumn("prev_content", F.lag("content").over(order)).withColumn("next_content", F.lead("content").over(order))
    scope = chunks.where(F.col("heading").rlike(r"\b(?:Scope|Purpose|Introduction)\b")).groupBy("doc_id").agg(F.min_by("content", "seq").alias("scope"))
    children = chunks.where("parent IS NOT NULL").groupBy(F.col("parent").alias("chunk_id")).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda c: c["content"]), 1, 2).alias("child_contents")
    )
    return near.join(scope, "doc_id", "left").join(children, "chunk_id", "left").select(
        "chunk_id", "scope", "prev_content", "next_content", F.coalesce("child_contents", F.array().cast("array<string>")).alias("child_contents")
    )


def quality_report(chunks: DataFrame) -> DataFrame:
    """Counters per document and in total (null ``doc_id``): chunks, summaries, questions and the summary coverage at four decimals."""
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    counted = chunks.rollup("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(has("summary")).alias("summaries"), F.sum(F.size(F.coalesce("questions", F.array().cast("array<string>")))).alias("questions"),
        F.grouping("doc_id").alias("total"),
    )
    return counted.withColumn("coverage", F.round(F.col("summaries") / F.col("chunks"), 4))


def summary_graph(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary nodes of sections and the edges that hang them in: HAS_SECTION_SUMMARY from the section, SUMMARIZES to what was read.

    ``units``: ``section, text, depends_on``; a summary that found too little is not for retrieval.
    """
    ident = F.concat(F.lit("summary:"), F.col("section").cast("string"))
    nodes = units.select(ident.alias("id"), F.lit("SectionSummary").alias("label"), F.col("text").alias("name"), (F.col("text") != "[INSUFFICIENT_SOURCE]").alias("retrieval_eligible"))
    has = units.select(F.concat(F.lit("chunk:"), F.col("section").cast("string")).alias("source"), F.lit("HAS_SECTION_SUMMARY").alias("relation"), ident.alias("target"))
    reads = units.select(ident.alias("source"), F.explode("depends_on").alias("d")).select(
        "source", F.lit("SUMMARIZES").alias("relation"), F.concat(F.lit("chunk:"), F.col("d").cast("string")).alias("target")
    )
    return nodes, has.unionByName(reads).distinct()


# --- annotation ----------------------------------------------------------------


def valid_questions(questions: DataFrame, history: DataFrame, most_words: int = 55) -> DataFrame:
    """Questions that end in a question mark, have at most ``most_words`` words and were never asked before (``question`` of both, normalised)."""
    key = normalize("question")
    asked = history.select(key.alias("__k")).distinct()
    words = F.size(F.split(F.trim("question"), r"\s+"))
    good = questions.where(F.rtrim("question").endswith("?") & (words <= most_words)).withColumn("__k", key)
    return good.join(asked, "__k", "left_anti").drop("__k")


def _first_of_others(rows: list[tuple], most: int) -> list[tuple]:
    """The fewest rows (doc, chunk) of an ordered list that hold, for any document, the first ``most`` rows of others."""
    kept, of = [], {}
    for doc, chunk in rows:
        if len(kept) - max((n for d, n in of.items() if d != doc), default=0) < most:
            kept.append((doc, chunk))
            of[doc] = of.get(doc, 0) + 1
    return kept


def _swept(most: int):
    """Rows of whole buckets, last place first and seeds before chunks, to what follows each seed and to each bucket's beginning.

    Only the few rows that some document may need are held. Seeds have
    ``times``, beginnings have none but the documents of their chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ahead, types, out = None, [], None, []

        def ready() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), types["query_id"], types["doc_id"], pa.list_(types["chunk_id"]), pa.list_(types["doc_id"]))
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "times", "query_id", "doc_id", "found", "docs"])

        def begins() -> tuple:
            return here, None, None, None, [c for _, c in ahead], [d for d, _ in ahead]

        for batch in batches:
            types = {n: batch.schema.field(n).type for n in ("query_id", "doc_id", "chunk_id")}
            for bucket, times, query, doc, chunk in zip(*[batch.column(n).to_pylist() for n in ("bucket", "times", "query_id", "doc_id", "chunk_id")], strict=True):
                if bucket != here:
                    if here is not None:
                        out.append(begins())
                    here, ahead = bucket, []
                if times is None:
                    ahead = _first_of_others([(doc, chunk), *ahead], most)
                else:
                    out.append((bucket, times, query, doc, [c for d, c in ahead if d != doc][:most], None))
            if len(out) > 10_000:
                yield ready()
                out = []
        if here is not None:
            out.append(begins())
            yield ready()

    return run


def _followers(own: DataFrame, chunks: DataFrame, order: Column, most: int) -> DataFrame:
    """``query_id, chunk_id, times``: the ``most`` chunks of other documents that follow each seed in hash order.

    Chunks are dealt into buckets by the first bits of their hash, and each
    bucket is read once, backwards. A seed that has too few followers in its
    bucket gets the rest from the beginnings of the next ones: ten rows or so a
    bucket, which are all that meets in one place.
    """
    doc, chunk = chunks.schema["doc_id"].dataType, chunks.schema["chunk_id"].dataType
    query = own.schema["query_id"].dataType
    rows = chunks.select("chunk_id", "doc_id", F.lit(None).cast(query).alias("query_id"), F.lit(None).cast("long").alias("times"))
    both = rows.unionByName(own.groupBy("chunk_id", "doc_id", "query_id").agg(F.sum("times").alias("times"))).where("chunk_id IS NOT NULL AND doc_id IS NOT NULL")
    dealt = both.withColumn("bucket", F.conv(F.left(order, F.lit(3)), 16, 10).cast("int")).repartition("bucket").withColumn("h", F.unhex(order))
    sweep = dealt.sortWithinPartitions("bucket", F.desc("h"), F.col("times").isNull()).select("bucket", "times", "query_id", "doc_id", "chunk_id")
    name = lambda kind: kind.simpleString()
    read = staged(sweep.mapInArrow(_swept(most), f"bucket int, times long, query_id {name(query)}, doc_id {name(doc)}, found array<{name(chunk)}>, docs array<{name(doc)}>"), "pool")
    ahead, tails = [], []
    for r in sorted(read.where("times IS NULL").select("bucket", "found", "docs").collect(), reverse=True):  # one row a bucket
        tails.append((r["bucket"], ahead))
        ahead = _first_of_others([*zip(r["docs"], r["found"], strict=True), *ahead], most)
    later = own.sparkSession.createDataFrame(tails, f"bucket int, later array<struct<d: {name(doc)}, c: {name(chunk)}>>")
    rest = F.transform(F.filter("later", lambda x: x["d"] != F.col("doc_id")), lambda x: x["c"])
    found = read.where("times IS NOT NULL").join(F.broadcast(later), "bucket")
    return found.select("query_id", "times", F.explode(F.slice(F.concat("found", rest), 1, most)).alias("chunk_id"))


def confirmatory_pool(seeds: DataFrame, chunks: DataFrame, siblings: int = 8, distractors: int = 4, salt: str = "pool") -> DataFrame:
    """``query_id, chunk_id, kind``: a seed, its neighbours, siblings (same parent and level) and chunks of other documents, in hash order.

    ``seeds``: ``query_id, chunk_id``, or ``query_id`` and all columns of a
    chunk; ``chunks``: ``chunk_id, doc_id, seq, parent, level``. Distractors are
    the chunks of other documents that come next in one hash order of all
    chunks. Repeated rows of seeds and chunks count as often as they are there.
    """
    order = F.sha2(F.concat(F.lit(salt + ":"), F.col("chunk_id").cast("string")), 256)
    place = ["doc_id", "seq", "parent", "level"]
    named = seeds if set(place) <= set(seeds.columns) else seeds.select("query_id", "chunk_id").join(chunks.select("chunk_id", *place), "chunk_id")
    own = named.groupBy("query_id", "chunk_id", *place).agg(F.count(F.lit(1)).alias("times"))
    rows = chunks.select("chunk_id", *place)

    def first(found: DataFrame, most: int, p: int, kind: str) -> DataFrame:
        """The first ``most`` rows of each query in hash order; ``times`` says how many rows one stands for."""
        before = F.sum("times").over(Window.partitionBy("query_id").orderBy(order, "chunk_id").rowsBetween(Window.unboundedPreceding, -1))
        once = found.groupBy("query_id", "chunk_id").agg(F.sum("times").alias("times")).withColumn("before", F.coalesce(before, F.lit(0)))
        return once.where(F.col("before") < most).select("query_id", "chunk_id", F.lit(p).alias("p"), F.lit(kind).alias("kind"))

    seed = own.select("query_id", "chunk_id", F.lit(0).alias("p"), F.lit("seed").alias("kind"))
    at = own.select("query_id", "doc_id", F.explode(F.array(F.col("seq") - 1, F.col("seq") + 1)).alias("seq"))
    near = at.join(rows, ["doc_id", "seq"]).select("query_id", "chunk_id", F.lit(1).alias("p"), F.lit("neighbour").alias("kind"))
    same = own.select("query_id", F.col("chunk_id").alias("seed"), "doc_id", "parent", "level", "times").join(rows, ["doc_id", "parent", "level"]).where("chunk_id != seed")
    kin = first(same, siblings, 2, "sibling")
    far = first(_followers(own, rows.select("chunk_id", "doc_id"), order, distractors), distractors, 3, "distractor")
    both = seed.unionByName(near).unionByName(kin).unionByName(far)
    return both.groupBy("query_id", "chunk_id").agg(F.min_by("kind", "p").alias("kind"))


def ground_truth(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: the annotated ids of a query (``query_id, annotated array``) that the corpus holds."""
    listed = queries.select("query_id", F.explode(F.array_distinct("annotated")).alias("chunk_id"))
    return listed.join(known.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id")


def gap_slice(capability: Column) -> Column:
    """The slice that a capability's description belongs to."""
    norm = normalize(capability)
    return (
        F.when(F.contains(norm, F.lit("multi hop")) | F.contains(norm, F.lit("chain")), "multi_hop")
        .when(F.contains(norm, F.lit("table")), "table")
        .when(F.contains(norm, F.lit("shortage")) | F.contains(norm, F.lit("event")), "structured_event")
        .when(F.contains(norm, F.lit("section")) | F.contains(norm, F.lit("hierarchy")), "hierarchy")
        .otherwise("semantic")
    )


def event_projection(properties: Column, fields: list[str]) -> Column:
    """Named JSON properties as a struct of strings, blank where absent."""
    return F.struct(*[F.coalesce(F.get_json_object(properties, f"$.{f}"), F.lit("")).alias(f) for f in fields])
