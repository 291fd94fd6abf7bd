"""Identifiers, hashes and lenient JSON (inventory section 6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_alias


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_id(prefix: str, value: Column | str, digits: int = 20) -> Column:
    """``prefix:slug`` of a name, or ``prefix:`` and hex digits of its hash where no slug is left."""
    value = F.coalesce(_col(value), F.lit(""))
    slug = F.replace(normalize_alias(value), F.lit(" "), F.lit("-"))
    hashed = F.left(F.sha2(value, 256), F.lit(digits))
    return F.concat(F.lit(prefix + ":"), F.when(slug != "", slug).otherwise(hashed))


def node_id(kind: str, *parts: Column | str) -> Column:
    """``kind:part:part``; numbers are padded to three digits by the caller."""
    return F.concat_ws(":", F.lit(kind), *[_col(p).cast("string") for p in parts])


def blind_id(seed: Column | str, query: Column | str, chunk: Column | str) -> Column:
    """``P-`` and eight upper-case hex digits, which hide where a passage comes from."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    key = F.concat_ws(":", seed, _col(query).cast("string"), _col(chunk).cast("string"))
    return F.concat(F.lit("P-"), F.upper(F.left(F.sha2(key, 256), F.lit(8))))


def hash_order(label: str, value: Column | str) -> Column:
    """The key of a reproducible shuffle."""
    return F.sha2(F.concat(F.lit(label + ":"), _col(value).cast("string")), 256)


def stable_seed(value: Column | str) -> Column:
    """The first eight bytes of a hash modulo 2**32."""
    return F.conv(F.substring(F.sha2(_col(value), 256), 9, 8), 16, 10).cast("long")


def run_id(content: Column | str) -> Column:
    """The first twelve hex digits of a content hash."""
    return F.left(F.sha2(_col(content), 256), F.lit(12))


def canonical_json_hash(row: Column) -> Column:
    """Hash of a struct as JSON; fields keep their order, nulls are left out."""
    return F.sha2(F.to_json(row), 256)


def reciprocal_rank(rank: Column | str, constant: int = 60) -> Column:
    """1 / (constant + rank), 0 for a missing rank."""
    return F.coalesce(F.lit(1.0) / (F.lit(constant) + _col(rank)), F.lit(0.0))


def model_json(raw: Column | str) -> Column:
    """The JSON object in a model's answer, fenced or with words around it; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(_col(raw), r"(?s)\{.*\}", 0), F.lit("")))


def allowed_ids(ids: Column, allowed: Column, most: int = 3) -> Column:
    """The first ids that are allowed, once each."""
    return F.slice(F.array_intersect(ids, allowed), 1, most)


def provenance(version: str, source: Column | str, locator: Column | str, derivation: str) -> Column:
    """The provenance struct that nodes and edges carry."""
    return F.struct(
        F.lit(version).alias("version"), _col(source).alias("source_file"), _col(locator).alias("locator"), F.lit(derivation).alias("derivation")
    )
