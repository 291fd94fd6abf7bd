"""MinHash near-deduplication with SuperMinHash signatures.

Each element of a set draws a random permutation of the signature's places and
random fractions; in step j it offers j plus a fraction to the j-th place of its
permutation. As offers of later steps can never beat earlier ones, a document
stops once its largest value is below the step. Bands of the signature give
candidate buckets. Candidates are verified on full shingle sets, first against
one hub per bucket, then, where a bucket still holds several components, block
by block between components. Union-find groups what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import staged
from quillgraph.llm.components import components
from quillgraph.llm.hashing import WordHashes, mix, shingle_set

_U = np.uint64
#: members of one hub's part; members of one block
PART, BLOCK = 128, 512


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, places: int) -> np.ndarray:
    """Signatures (sets, places) of element hashes; ``owner`` is each one's set.

    A value's high half is the step, its low half the random fraction. An empty
    set keeps the largest value everywhere.
    """
    out = np.full(sets * places, ~_U(0), np.uint64)
    table = None
    for j in range(places):
        draw = mix(elements + _U(((j + 1) * 0xD1342543DE82EF95) & ((1 << 64) - 1)))
        pick = j + ((draw & _U(0xFFFFFFFF)) % _U(places - j)).astype(np.int64)
        rows = np.arange(len(elements))
        if table is None:
            place = pick
        else:
            place = table[rows, pick].astype(np.int64)
            table[rows, pick] = table[:, j]
        np.minimum.at(out, owner * places + place, (_U(j) << _U(32)) | (draw >> _U(32)))
        worst = out.reshape(sets, places).max(axis=1)
        live = worst[owner] >= (_U(j + 1) << _U(32))
        if not live.any():
            break
        if table is None:  # permutations are only kept for what goes on
            elements, owner, pick = elements[live], owner[live], pick[live]
            table = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
            table[np.arange(len(elements)), pick] = 0
        elif not live.all():
            elements, owner, table = elements[live], owner[live], table[live]
    return out.reshape(sets, places)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One key a band: a hash of its place and its ``rows`` values."""
    sets, places = signatures.shape
    keys = np.broadcast_to(mix(np.arange(places // rows, dtype=np.uint64) + _U(1)), (sets, places // rows)).copy()
    for r in range(rows):
        keys = mix(keys ^ signatures[:, r::rows][:, : places // rows] * _U(0x9E3779B97F4A7C15))
    return keys


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed(df: DataFrame, size: int, places: int, rows: int) -> DataFrame:
    """``doc, n, set, bands`` from rows ``doc, text``; an empty set has null ``set`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(200_000)

        def flush(ids, sets):
            lengths = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), lengths)
            keys = band_keys(superminhash(np.concatenate(sets), owner, len(sets), places), rows).view(np.int64)
            has = lengths > 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if ok else None for k, ok in zip(keys.tolist(), has.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc", "n", "set", "bands"],
            )

        for batch in batches:
            ids, sets, total = [], [], 0
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc.as_py())
                sets.append(shingle_set((value.as_py() or "").encode(), hashes, size))
                total += len(sets[-1])
                if total > 50_000:
                    yield flush(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield flush(ids, sets)

    return df.select("doc", "text").mapInArrow(run, "doc long, n long, set binary, bands array<long>")


def _with_texts(df: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``set, text`` for ``nodes`` (``set, doc``): the text of that document with that set."""
    rows = df.join(nodes, "doc").select("doc", "text", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(200_000)
        for batch in batches:
            # rows that share an id but not the text have another set
            same = [
                set_key(shingle_set((t.as_py() or "").encode(), hashes, size)) == s.as_py()
                for t, s in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1)], names=["set", "text"]).filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, "set binary, text string")


def linked(inner, left, right, percent: int):
    """Whether sets of these sizes with ``inner`` common elements are similar enough."""
    return 100 * inner >= percent * (left + right - inner)


def _hub_links(size: int, percent: int):
    """Per (hub, part): links between the hub and the members."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes(200_000)
        hub = pdf["hub"].iloc[0]
        mine = pdf[pdf["set"] == hub]
        if mine.empty:
            return pd.DataFrame({"a": [], "b": []})
        base = shingle_set(mine["text"].iloc[0].encode(), hashes, size)
        found = set()
        for key, text in zip(pdf["set"], pdf["text"], strict=True):
            if key == hub or key in found:
                continue
            other = shingle_set(text.encode(), hashes, size)
            if linked(len(np.intersect1d(base, other, assume_unique=True)), len(base), len(other), percent):
                found.add(key)
        return pd.DataFrame({"a": [hub] * len(found), "b": sorted(found)})

    return check


def _block_links(size: int, percent: int):
    """Per pair of blocks: one link for each pair of components that has any."""

    def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(vocabulary)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
            out[i, at[vocabulary[at] == s]] = 1
        return out

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes(200_000)
        pdf = pdf.drop_duplicates(["block", "set"])
        one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
        left, right = pdf[pdf["block"] == one], pdf[pdf["block"] == two]
        links, done = [], set()
        sets_l = [shingle_set(t.encode(), hashes, size) for t in left["text"]]
        sets_r = sets_l if one == two else [shingle_set(t.encode(), hashes, size) for t in right["text"]]
        if not sets_l or not sets_r:
            return pd.DataFrame({"a": [], "b": []})
        # only shingles of both sides can be common
        all_l, all_r = np.unique(np.concatenate(sets_l)), np.unique(np.concatenate(sets_r))
        vocabulary = np.intersect1d(all_l, all_r, assume_unique=True)
        if not len(vocabulary):
            return pd.DataFrame({"a": [], "b": []})
        inner = np.zeros((len(sets_l), len(sets_r)), np.float32)
        for i in range(0, len(vocabulary), 10_000):
            part = vocabulary[i : i + 10_000]
            inner += matrix(sets_l, part) @ matrix(sets_r, part).T
        n_l, n_r = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_r])
        hits = np.argwhere(linked(inner, n_l[:, None], n_r[None, :], percent))
        key_l, key_r = left["set"].tolist(), right["set"].tolist()
        root_l, root_r = left["root"].tolist(), right["root"].tolist()
        for i, j in hits.tolist():
            pair = (root_l[i], root_r[j])
            if pair[0] != pair[1] and pair not in done:
                done.add(pair)
                links.append((key_l[i], key_r[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return check


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked when their sets of ``size``-word shingles have a
    similarity of ``percent`` or more; ``component_id`` is the least id that
    links reach. Two sets at the threshold s share a band with probability
    1 - (1 - s**rows)**bands, 0.9999999 for 85 % and 0.999995 for 80 % with
    the defaults; what shares a band is always verified, whatever the size of
    its bucket. Documents with equal sets count as one until the end.

    A null or empty text, or one without words, has no shingles and links with
    nothing. A null id has a null component and is kept. Rows that share an id
    are one document with several texts: the least id of all their sets'
    components, and kept if it is their own. Other columns are not read; an
    empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = docs.where("doc IS NOT NULL")
    known = staged(signed(docs, size, bands * rows, rows), "near-signed")
    nodes = (
        known.where("set IS NOT NULL AND doc IS NOT NULL")
        .groupBy("set")
        .agg(F.min(F.struct("doc", "bands")).alias("first"))
        .select("set", "first.doc", "first.bands")
    )
    buckets = nodes.select("set", "doc", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("set").alias("hub")).where("members > 1")
    members = staged(buckets.join(staged(shared, "near-buckets"), "bucket"), "near-members")
    texts = staged(_with_texts(named, members.select("set", "doc").distinct(), size), "near-texts")

    # first: every member against its bucket's hub; a hub's members are dealt over parts
    pairs = members.where("set != hub").select("hub", "set").distinct()
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
    hubs = parts.select("hub", F.col("hub").alias("set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sent = dealt.select("hub", "set", "part").unionByName(hubs).join(texts, "set")
    star = staged(
        sent.groupBy("hub", "part").applyInPandas(_hub_links(size, percent), "a binary, b binary"), "near-star"
    )
    roots = components(star)

    # then: what a bucket holds of several components, block against block
    placed = members.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
        "bucket", "set", F.coalesce("root", "set").alias("root")
    )
    mixed = (
        placed.groupBy("bucket")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count(F.lit(1)).alias("members"),
            F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("sum"),
        )
        .where("low != high AND members > 2")
        # the same members in several bands are looked at once
        .groupBy("members", "sum")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    inside = staged(placed.join(mixed, "bucket"), "near-inside")
    weights = inside.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    # a large component has blocks of its own; small ones share blocks
    apart = weights.withColumn("own", F.col("n") >= BLOCK // 4)
    loose = apart.where("NOT own").groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).alias("loose_blocks"))
    blocks = staged(
        inside.join(apart, ["bucket", "root"])
        .join(loose, "bucket", "left")
        .select(
            "bucket", "set", "root",
            F.when(F.col("own"), F.col("root")).alias("only"),
            F.when(F.col("own"), F.xxhash64("root", F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / BLOCK))))
            .otherwise(F.pmod(F.xxhash64("set"), F.col("loose_blocks")))
            .alias("block"),
        ),
        "near-blocks",
    )
    kinds = blocks.select("bucket", "block", "only").distinct()
    other = kinds.select("bucket", F.col("block").alias("two"), F.col("only").alias("only_two"))
    meetings = (
        kinds.withColumnRenamed("block", "one")
        .join(other, "bucket")
        .where("one <= two AND (only IS NULL OR only_two IS NULL OR only != only_two)")
        .select("bucket", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    )
    brought = meetings.join(blocks, ["bucket", "block"]).join(texts, "set")
    across = brought.groupBy("bucket", "one", "two").applyInPandas(_block_links(size, percent), "a binary, b binary")
    same_id = (
        known.where("set IS NOT NULL AND doc IS NOT NULL").groupBy("doc")
        .agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a != b").select("a", "b")
    )
    groups = components(staged(star.unionByName(across).unionByName(same_id), "near-links"))

    # a set's least document is found anew: its bands need not travel once more
    firsts = known.where("set IS NOT NULL AND doc IS NOT NULL").groupBy("set").agg(F.min("doc").alias("doc"))
    least = firsts.join(groups.withColumnRenamed("node", "set"), "set", "left")
    least = staged(least.select("set", "doc", F.coalesce("root", "set").alias("root")), "near-roots")
    reach = least.groupBy("root").agg(F.min("doc").alias("reach"))
    owners = least.join(reach, "root").select("set", "reach")
    kind = df.schema[id_col].dataType.simpleString()
    return (
        known.join(owners, "set", "left")
        .withColumn("component", F.when(F.col("doc").isNotNull(), F.coalesce("reach", "doc")))
        .select(
            F.col("doc").cast(kind).alias(id_col),
            F.col("n").alias("n_shingles"),
            F.col("component").cast(kind).alias("component_id"),
            F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
        )
    )
