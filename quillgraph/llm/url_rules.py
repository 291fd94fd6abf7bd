"""URL filtering by fixed rules and by mined association rules.

Fixed (host, path) rules come first; the longest that fits decides. Elsewhere
Spark's FP-growth mines combinations of URL tokens together with the label of
the page. Combinations whose support and class-balanced confidence pass the
thresholds, and that say more than any part of them, become rules, found again
through an inverted index from each rule's rarest token.
Everything runs as DataFrame operations inside the JVM.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): host, then path. A rule holds for the host and its subdomains.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
BLOCK, ALLOW = "label=block", "label=allow"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """What follows the first ``?`` after the host, up to ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a url, none without a host.

    Host suffixes, words of the host's labels (cut at hyphens), path segments,
    the file type and the names of query parameters. Numbers inside segments
    become ``#``, so ids don't make tokens of their own.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host="), F.concat_ws(".", F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))))),
    )
    words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")),
    )
    kind = F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]*)$", 1)
    kinds = F.when(kind == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("type="), F.lower(kind))))
    names = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, words, segments, kinds, names))
    )


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # later, longer ones override
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float = 0.02, min_confidence: float = 0.7) -> DataFrame:
    """Rules ``tokens, says, support, confidence`` from rows ``tokens, bad``.

    Tokens and label must stand together on at least ``min_support`` of the
    labelled pages. Confidence is balanced: the label's share among the pages that
    the tokens fit, as if both labels were equally frequent at large; with bad
    pages in the minority, plain confidence would hardly ever let a block rule
    pass. A rule that is no surer than one with a token less is pruned. Of
    equal token sets the surer verdict stays. Null tokens or labels teach
    nothing.
    """
    known = labelled.where("size(tokens) > 0 AND bad IS NOT NULL")
    totals = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("n_bad")
    ).first()
    n, n_bad = totals["n"], totals["n_bad"]
    if not 0 < n_bad < n:
        return known.select(
            "tokens", F.lit("").alias("says"), F.lit(0.0).alias("support"), F.lit(0.0).alias("confidence")
        ).limit(0)
    baskets = known.select(
        F.concat("tokens", F.array(F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items")
    )
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets).freqItemsets
    label = F.when(F.array_contains("items", BLOCK), F.lit(BLOCK)).when(F.array_contains("items", ALLOW), F.lit(ALLOW))
    parts = sets.select(
        F.array_sort(F.array_remove(F.array_remove("items", BLOCK), ALLOW)).alias("tokens"), label.alias("label"), "freq"
    ).where("size(tokens) > 0")
    alone = parts.where("label IS NULL").select("tokens", F.col("freq").alias("all"))
    here, there = F.when(F.col("label") == BLOCK, F.lit(n_bad)).otherwise(F.lit(n - n_bad)), F.when(F.col("label") == BLOCK, F.lit(n - n_bad)).otherwise(F.lit(n_bad))
    mine, others = F.col("freq") / here, (F.col("all") - F.col("freq")) / there
    rated = parts.where("label IS NOT NULL").join(alone, "tokens").withColumn("confidence", mine / (mine + others))
    shorter = rated.select(F.col("tokens").alias("part"), F.col("label").alias("of"), F.col("confidence").alias("part_confidence"))
    beaten = (
        rated.select("tokens", "label", "confidence", F.explode("tokens").alias("token"))
        .select("tokens", "label", "confidence", F.array_remove("tokens", F.col("token")).alias("part"))
        .join(shorter.withColumnRenamed("of", "label"), ["part", "label"])
        .where("part_confidence >= confidence")
        .select("tokens", "label")
        .distinct()
    )
    return (
        rated.where(F.col("confidence") >= min_confidence)
        .join(beaten, ["tokens", "label"], "left_anti")
        .select(
            "tokens",
            F.when(F.col("label") == BLOCK, F.lit("block")).otherwise(F.lit("allow")).alias("says"),
            (F.col("freq") / n).alias("support"),
            "confidence",
        )
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule for each distinct ``tokens`` of ``urls``: ``tokens, mined, confidence``.

    The inverted index lists each rule under its rarest token (by support of
    the rules that hold it, then by name); a rule fits where the page has all
    its tokens. The surest rule wins, then the one with more support, then
    block before allow.
    """
    spread = rules.select("*", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.max("support").alias("seen"))
    rarest = (
        spread.join(common, "token")
        .groupBy("tokens", "says", "support", "confidence")
        .agg(F.min(F.struct("seen", "token"))["token"].alias("key"))
        .withColumnRenamed("tokens", "needs")
    )
    pages = urls.select("tokens").distinct()
    hits = pages.select("tokens", F.explode("tokens").alias("key")).join(rarest, "key")
    return (
        hits.where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", "support", "says")).alias("best"))
        .select("tokens", F.col("best.says").alias("mined"), F.col("best.confidence").alias("confidence"))
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    good_col: str = "quality",
    min_support: float = 0.02,
    min_confidence: float = 0.7,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined, confidence.

    ``labels`` are joined by ``id_col`` = ``label_id``, that is, a page is taken
    to be the page of the document of the same number; the tables have no other
    key. A label is 0 (bad) or 1; others, null labels and null ids teach
    nothing; of labels that repeat an id the least counts. A null url or one without ``://`` has an
    empty host and path, fits no rule and is allowed, as is every page that no
    rule fits. Repeated pages are judged alike. Without labels, or with an empty
    table, only the fixed rules speak.
    """
    parsed = pages.select(
        F.col(id_col).alias("id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        url_query(F.col(url_col)).alias("query"),
    )
    urls = parsed.withColumn("tokens", F.array_sort(url_tokens(F.col("host"), F.col("path"), F.col("query")))).drop("query")
    known = (
        labels.where(F.col(good_col).isin(0, 1))
        .groupBy(F.col(label_id).alias("label_of"))
        .agg((F.min(good_col) == 0).alias("bad"))
    )
    labelled = urls.join(known, F.col("id") == F.col("label_of")).select("tokens", "bad")
    found = match_rules(urls, mine_rules(labelled, min_support, min_confidence)).withColumnRenamed("tokens", "found_for")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return urls.join(found, F.col("tokens") == F.col("found_for"), "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.col("mined"), F.lit("allow")).alias("verdict"),
        "mined",
        "confidence",
    )
