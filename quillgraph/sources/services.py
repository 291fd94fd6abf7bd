"""Records out of the saved answers of public services (inventory 1.16 to 1.19, 1.22, 1.23, 1.26).

Answers are tables of raw bodies, one row per page, as ``readers.paged_snapshot``
saves them, so everything here runs offline and on any number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_LIMIT, REACTIONS = 500, 5  # what a record keeps, as defined


def _results(pages: DataFrame, record: str, field: str = "results") -> DataFrame:
    """``key`` and the fields of every record of every page; unreadable bodies have none."""
    body = F.from_json(F.col("body").cast("string"), f"{field} array<struct<{record}>>")
    return pages.select("key", F.explode(body[field]).alias("r")).select("key", "r.*")


def enforcement_reports(pages: DataFrame, limit: int = 10) -> DataFrame:
    """The newest ``limit`` recall reports of each search ``key``, texts cut to 500 characters."""
    rows = _results(pages, "recall_number: string, product_description: string, reason_for_recall: string, report_date: string, recalling_firm: string")
    order = Window.partitionBy("key").orderBy(F.col("report_date").desc_nulls_last(), "recall_number")
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(TEXT_LIMIT)).alias(c)
    kept = rows.select("key", "recall_number", cut("product_description"), cut("reason_for_recall"), "report_date", "recalling_firm")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def adverse_events(pages: DataFrame) -> DataFrame:
    """Safety reports with their first five reactions."""
    rows = _results(pages, "safetyreportid: string, serious: string, patient: struct<reaction: array<struct<reactionmeddrapt: string>>>")
    names = F.filter(F.transform("patient.reaction", lambda r: r["reactionmeddrapt"]), lambda n: n.isNotNull())
    return rows.select("key", "safetyreportid", "serious", F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, REACTIONS).alias("reactions"))


def drug_identifiers(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """``key, rxcui``: the id of an exact name, else the best approximate one, else null."""
    ids = exact.select("key", F.get(F.from_json(F.col("body").cast("string"), "idGroup struct<rxnormId: array<string>>")["idGroup"]["rxnormId"], F.lit(0)).alias("a"))
    near = approximate.select("key", F.get(F.from_json(F.col("body").cast("string"), "approximateGroup struct<candidate: array<struct<rxcui: string>>>")["approximateGroup"]["candidate"], F.lit(0))["rxcui"].alias("b"))
    both = ids.groupBy("key").agg(F.max("a").alias("a")).join(near.groupBy("key").agg(F.max("b").alias("b")), "key", "full_outer")
    return both.select("key", F.coalesce("a", "b").alias("rxcui"))


def related_concepts(pages: DataFrame, kinds: tuple[str, ...] = ("IN", "BN", "SBD")) -> DataFrame:
    """``key, tty, rxcui, name`` of the nested concept groups of the wanted kinds."""
    body = F.from_json(F.col("body").cast("string"), "relatedGroup struct<conceptGroup: array<struct<tty: string, conceptProperties: array<struct<rxcui: string, name: string>>>>>")
    groups = F.filter(body["relatedGroup"]["conceptGroup"], lambda g: g["tty"].isin(*kinds))
    return pages.select("key", F.explode(groups).alias("g")).select("key", "g.tty", F.explode("g.conceptProperties").alias("p")).select("key", "tty", "p.rxcui", "p.name")


def molecules(pages: DataFrame, most: int = 5) -> DataFrame:
    """``key, molecule, name``: of the first ``most`` hits the first whose name holds the key or is held by it, else the first."""
    body = F.from_json(F.col("body").cast("string"), "molecules array<struct<molecule_chembl_id: string, pref_name: string>>")
    hits = pages.select("key", F.posexplode(F.slice(body["molecules"], 1, most)).alias("place", "m"))
    name, key = F.lower(F.coalesce("m.pref_name", F.lit(""))), F.lower("key")
    match = F.when((name != "") & (F.contains(name, key) | F.contains(key, name)), 0).otherwise(1)
    return hits.groupBy("key").agg(F.min_by("m", F.struct(match.alias("no_match"), "place")).alias("m")).select(
        "key", F.col("m.molecule_chembl_id").alias("molecule"), F.col("m.pref_name").alias("name")
    )


def molecule_facts(mechanisms: DataFrame, indications: DataFrame, targets: DataFrame) -> DataFrame:
    """``molecule, mechanisms, indications``: what a molecule does to which target, and what it is for, each heading once.

    Pages of the bulk service; ``targets``: ``target, target_name``. Targets
    are joined, where the service would have to be asked for lists of ids.
    """
    does = _results(mechanisms, "molecule_chembl_id: string, mechanism_of_action: string, target_chembl_id: string", "mechanisms")
    named = does.join(targets, does["target_chembl_id"] == targets["target"], "left")
    done = named.groupBy(F.col("molecule_chembl_id").alias("molecule")).agg(
        F.array_sort(F.collect_set(F.concat_ws(" of ", "mechanism_of_action", "target_name"))).alias("mechanisms")
    )
    wanted = _results(indications, "molecule_chembl_id: string, mesh_heading: string", "drug_indications")
    used = wanted.groupBy(F.col("molecule_chembl_id").alias("molecule")).agg(F.array_sort(F.collect_set("mesh_heading")).alias("indications"))
    none = F.array().cast("array<string>")
    return done.join(used, "molecule", "full_outer").select("molecule", F.coalesce("mechanisms", none).alias("mechanisms"), F.coalesce("indications", none).alias("indications"))


def legacy_key(ident: Column) -> Column:
    """The key of an older store: lower case, everything else than letters and digits as underscores."""
    return F.regexp_replace(F.lower(ident), "[^a-z0-9]+", "_")


def foreign_chunks(rows: DataFrame, depth: int = 8) -> DataFrame:
    """Chunks of another format (``id, parent_id, doc, seq, title, body``) in this one's columns.

    Ids in snake case, breadcrumbs along the parents (``depth`` at most, so a
    cycle ends), links to the neighbours of the document.
    """
    named = rows.select(legacy_key(F.col("id")).alias("chunk_id"), legacy_key(F.col("parent_id")).alias("parent"), legacy_key(F.col("doc")).alias("doc_id"), "seq", F.col("title").alias("heading"), F.col("body").alias("content"))
    up = named.select(F.col("chunk_id").alias("at"), F.col("parent").alias("next"), F.col("heading").alias("crumb"))
    walk, done = named.select("chunk_id", F.col("parent").alias("at"), F.array().cast("array<string>").alias("crumbs")), None
    for _ in range(depth):
        ended = walk.join(up.select("at"), "at", "left_anti").select("chunk_id", "crumbs")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.join(up, "at").select("chunk_id", F.col("next").alias("at"), F.concat(F.array("crumb"), "crumbs").alias("crumbs"))
    done = done.unionByName(walk.select("chunk_id", "crumbs"))
    order = Window.partitionBy("doc_id").orderBy("seq", "chunk_id")
    return named.join(done, "chunk_id").select(
        "chunk_id", "doc_id", "heading", F.array_join("crumbs", " > ").alias("parents_context"), "content",
        F.lag("chunk_id").over(order).alias("prev_chunk_id"), F.lead("chunk_id").over(order).alias("next_chunk_id"),
    )


def markdown_rows(text: Column, columns: list[str]) -> Column:
    """The rows of a pipe table in a text as structs of strings; the head and its rule are left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|"))
    body = F.slice(F.filter(lines, lambda x: ~x.rlike(r"^\|[\s:|-]+\|$")), 2, 1_000_000_000)
    cells = lambda x: F.transform(F.split(F.substr(x, F.lit(2), F.length(x) - 2), r"\|"), lambda c: F.trim(c))
    return F.transform(body, lambda x: F.struct(*[F.coalesce(F.get(cells(x), F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]))
