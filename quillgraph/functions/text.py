"""Text columns: tokens, predicates, routing and overlap (inventory section 5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word and term lists that results depend on.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "of", "on", "or",
    "should", "the", "to", "what", "when", "which", "with",
)
TABLE_TERMS = (
    "acceptance criteria", "acceptance criterion", "concentration limit", "concentration limits",
    "maximum daily dose", "pde", "storage condition", "storage conditions", "table", "tables", "threshold",
    "thresholds", "validation characteristic", "validation characteristics",
)
HIERARCHY_TERMS = (
    "annex", "appendix", "chapter", "chapters", "lifecycle stages", "organised", "organized", "part", "parts",
    "section", "sections", "structure", "under which", "where does", "which document", "which guideline",
)
GRAPH_TERMS = (
    "active ingredient", "api", "contains api", "drug", "drugs", "ingredient", "manufactured by",
    "manufacturer", "manufacturers", "ndc", "shortage", "shortages", "supplier", "suppliers", "unavailable",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_alias(c: Column | str) -> Column:
    """Lower case, parenthesised parts removed, everything but a-z and 0-9 as single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def tokenize(c: Column | str) -> Column:
    """All runs of a-z and 0-9 after case folding; null gives no tokens."""
    folded = F.replace(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))


def normalize(c: Column | str) -> Column:
    """Tokens joined by one space; also the key of a question."""
    return F.array_join(tokenize(c), " ")


def word_set(c: Column | str) -> Column:
    """Distinct tokens longer than one character that are no stop words."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokenize(c), lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t)))


def significant_words(c: Column | str) -> Column:
    """Distinct tokens longer than two characters."""
    return F.array_distinct(F.filter(tokenize(c), lambda t: F.length(t) > 2))


def keywords(c: Column | str) -> Column:
    """Codes such as ``Q3D`` first, then words of three letters and more, lower case, in order, once each."""
    text = F.coalesce(_col(c), F.lit(""))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    codes = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{1,5}\s*[A-Za-z]?\d+[A-Za-z0-9]*"), F.lit(0))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))
    lowered = F.transform(F.concat(codes, words), lambda x: F.lower(x))
    return F.array_distinct(F.filter(lowered, lambda x: ~F.array_contains(stops, x)))


def first_keywords(c: Column | str, most: int = 6) -> Column:
    """The first words of three letters and more that are no stop words."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.filter(tokenize(c), lambda x: (F.length(x) >= 3) & ~F.array_contains(stops, x)), 1, most)


def ndc_codes(c: Column | str) -> Column:
    """Package codes in a text, digits only."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\b\d{4,5}-\d{3,5}-\d{1,3}\b"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit("-"), F.lit("")))


def has_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Whether a normalised phrase occurs in a normalised text as whole words; an empty phrase never does."""
    phrase = _col(phrase)
    inside = F.contains(F.concat(F.lit(" "), _col(text), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
    return (F.length(phrase) > 0) & inside


def has_any_term(text: Column | str, terms=TABLE_TERMS, whole: bool = True) -> Column:
    """Whether one of ``terms`` occurs, as a whole phrase or as a substring."""
    norm = normalize(text)
    found = F.lit(False)
    for t in terms:
        found = found | (has_phrase(norm, F.lit(t)) if whole else F.contains(norm, F.lit(t)))
    return found


def names_document(query: Column | str, aliases: Column) -> Column:
    """Whether a query holds one of a document's names as a whole phrase; without names it doesn't."""
    norm = normalize(query)
    return F.coalesce(F.exists(aliases, lambda a: has_phrase(norm, a)), F.lit(False))


def route(query: Column | str, names_document: Column | None = None) -> Column:
    """table, hierarchy, lexical (a document is named) or semantic, in that order."""
    named = F.lit(False) if names_document is None else names_document
    return (
        F.when(has_any_term(query), F.lit("table"))
        .when(has_any_term(query, HIERARCHY_TERMS), F.lit("hierarchy"))
        .when(named, F.lit("lexical"))
        .otherwise(F.lit("semantic"))
    )


def wants_graph(query: Column | str) -> Column:
    """The graph flag, independent of the route."""
    return has_any_term(query, GRAPH_TERMS)


def heading_overlap(query: Column | str, heading: Column | str) -> Column:
    """Share of the query's words in the heading; 0 for an empty query."""
    q, h = word_set(query), word_set(heading)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, h)) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def join_parts(*parts: Column | str, limit: int | None = None) -> Column:
    """Stripped, non-empty parts joined by line feeds, cut to ``limit`` characters if given."""
    text = F.concat_ws("\n", *[F.nullif(F.trim(_col(p)), F.lit("")) for p in parts])
    return F.left(text, F.lit(limit)) if limit else text


def parse_ids(c: Column | str, separator: str = "[;\n]") -> Column:
    """Trimmed non-empty parts, once each, in order."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), separator), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def safe_id(c: Column | str, most: int = 60) -> Column:
    """Everything but word characters as underscores, at most 60 characters."""
    return F.left(F.regexp_replace(_col(c), r"[^A-Za-z0-9_]+", "_"), F.lit(most))


def alias_forms(c: Column | str) -> Column:
    """A name's forms: without parentheses, inside them, and after a colon; lower-cased and normalised."""
    name = F.coalesce(_col(c), F.lit(""))
    forms = F.array(
        normalize_alias(F.regexp_replace(name, r"[(（].*[)）]\s*$", "")),
        normalize_alias(F.regexp_extract(name, r"[(（]([^()（）]*)[)）]\s*$", 1)),
        normalize_alias(F.regexp_extract(name, r"[:：]\s*(.+)$", 1)),
    )
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) > 0))


def document_aliases(doc_id: Column | str) -> Column:
    """Names a document id answers to: itself, without its agency, ``ich x`` and ``annex n`` forms."""
    base = normalize(_col(doc_id))
    second = F.regexp_extract(base, "^ich ([a-z0-9]+)", 1)
    cgmp = base.rlike("^fda cgmp( |$)")
    forms = F.array(
        base,
        F.regexp_extract(base, "^(?:ich|ema|fda|who) (.+)$", 1),
        F.regexp_extract(base, "^ema gmp (annex [a-z0-9]+)", 1),
        F.when(cgmp, F.lit("fda cgmp")).otherwise(""),
        F.when(cgmp, F.lit("cgmp guidance")).otherwise(""),
        F.when(second != "", F.concat(F.lit("ich "), second)).otherwise(""),
        second,
    )
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) >= 2))


def revised_question(note: Column | str) -> Column:
    """The question after the last colon before the last question mark; null unless it starts with a letter."""
    found = F.trim(F.regexp_extract(_col(note), r"(?s).*[:：]([^:：]*\?)", 1))
    return F.when(found.rlike(r"^\p{L}"), found)


def html_text(html: Column | str) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, entities read, space squeezed."""
    blocks = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    out = F.regexp_replace(F.coalesce(_col(html), F.lit("")), blocks, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\x20\x09-\x0D]+", " "))
