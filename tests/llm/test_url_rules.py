import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.url_rules import filter_urls, match_rules, mine_rules, url_host, url_path, url_query, url_tokens

URLS = [
    (1, "http://Shop.Example.COM/en/71"), (2, "https://a.example.com/en/8"), (3, "http://example.net/de/8x"), (4, "http://x.net/de/1?q=1"),
    (5, "http://y.org/es/a#b"), (6, None), (7, "no scheme"), (8, "http://"), (9, "http://com/en/"), (10, "http://welcome/en/"),
    (11, "ftp://user.example.com?x"), (12, "http://a.com/EN/1"), (13, ""), (None, "http://q.com/en/1"), (1, "http://Shop.Example.COM/en/71"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("tokens", F.lit("x"))


def test_fixed_rules(spark, pages):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, labels).collect() if r["page_id"]}
    assert got[1] == ("shop.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("example.net/de/8", "block")
    assert got[4] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[5] == ("y.org", "/es/a", "org/es/", "block")
    assert got[6] == got[7] == got[8] == got[13] == ("", "", None, "allow")
    assert got[9][2] == "com/en/" and got[10][2] is None
    assert got[11] == ("user.example.com", "", None, "allow") and got[12][2] is None
    assert filter_urls(pages, labels).count() == len(URLS)


def tokens_of(df):
    url = F.col("url")
    return df.select("page_id", F.array_sort(url_tokens(url_host(url), url_path(url), url_query(url))).alias("tokens"), (F.col("quality") == 0).alias("bad"))


def plain_rules(local, min_support, min_confidence):
    """Rules by counting every subset of every token set."""
    n, counts, bads = len(local), Counter(), Counter()
    for items, bad in local:
        for k in range(1, len(items) + 1):
            for sub in itertools.combinations(sorted(items), k):
                counts[sub] += 1
                bads[sub] += bad
    total = {"block": sum(b for _, b in local)}
    total["allow"] = n - total["block"]
    other = {"block": "allow", "allow": "block"}
    rated = {}
    for sub, c in counts.items():
        of = {"block": bads[sub], "allow": c - bads[sub]}
        for says, freq in of.items():
            if freq >= min_support * n:
                mine, others = freq / total[says], of[other[says]] / total[other[says]]
                rated[sub, says] = mine / (mine + others)
    return {
        (sub, says): conf
        for (sub, says), conf in rated.items()
        if conf >= min_confidence
        and not any(len(sub) > 1 and rated[tuple(x for x in sub if x != t), says] >= conf for t in sub)
    }


def test_mined_rules_against_all_subsets(spark):
    hosts = ["good.site", "bad-luck.site", "mixed.site"]
    rows = [(i, f"http://{hosts[i % 3]}/{'ad' if i % 2 else 'news'}/{i}.html?p={i}", int(not (i % 3 == 1 or (i % 3 == 2 and i % 2)))) for i in range(180)]
    df = spark.createDataFrame(rows, "page_id long, url string, quality int")
    labelled = tokens_of(df)
    local = [(frozenset(r["tokens"]), r["bad"]) for r in labelled.collect()]
    want = plain_rules(local, 0.05, 0.6)
    rules = mine_rules(labelled, 0.05, 0.6)
    got = {(tuple(r["tokens"]), r["says"]): r["confidence"] for r in rules.collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for r in match_rules(labelled, rules).collect():
        mine = [(c, says) for (s, says), c in want.items() if set(s) <= set(r["tokens"])]
        assert abs(max(mine)[0] - r["confidence"]) < 1e-9
    verdicts = filter_urls(df.select("page_id", "url"), df.select(F.col("page_id").alias("doc_id"), "quality"))
    got = {r["page_id"]: r["verdict"] for r in verdicts.collect()}
    assert all((got[i] == "block") == (q == 0) for i, _, q in rows)


def test_a_minority_of_bad_pages_makes_block_rules(spark):
    """One page in ten is bad; a token with 40 % bad pages is far above that."""
    rows = [(i, f"http://{'casino-win' if i % 8 == 0 else f'h{i % 5}'}.site/{i}", int(not (i % 8 == 0 and i % 5 < 2 or i % 16 == 3))) for i in range(640)]
    df = spark.createDataFrame(rows, "page_id long, url string, quality int")
    rules = {(tuple(r["tokens"]), r["says"]) for r in mine_rules(tokens_of(df)).collect()}
    assert (("word=casino",), "block") in rules
    verdicts = filter_urls(df.select("page_id", "url"), df.select(F.col("page_id").alias("doc_id"), "quality"))
    held = {r["page_id"]: r["verdict"] for r in verdicts.collect()}
    assert all((held[i] == "block") == (i % 8 == 0) for i, *_ in rows if i % 16 != 3)


def test_tokens(spark):
    url = F.col("url")
    df = spark.createDataFrame([("http://m.free-bets.Example.com/en/54/a.HTML?page=2&ref=x&page=3#top",), ("http:///x",), (None,)], "url string")
    got = df.select(url_tokens(url_host(url), url_path(url), url_query(url)).alias("t")).collect()
    hosts = ["m.free-bets.example.com", "free-bets.example.com", "example.com", "com"]
    want = [f"host={h}" for h in hosts] + [f"word={w}" for w in ("m", "free", "bets", "example", "com")]
    want += ["path=en", "path=#", "path=a.HTML", "type=html", "query=page", "query=ref"]
    assert got[0]["t"] == want and got[1]["t"] == got[2]["t"] == []


def test_ties_repeats_and_long_urls(spark):
    long = "http://a.site/" + "/".join(f"s{i}" for i in range(5000))
    rows = [(i, "http://tie.site/x", i % 2) for i in range(40)] + [(100, long, 1), (101, long, 1), (100, long, 0), (None, "http://tie.site/x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, quality int")
    got = filter_urls(df.select("page_id", "url"), df.select(F.col("page_id").alias("doc_id"), "quality")).collect()
    assert len(got) == len(rows) and len({r["verdict"] for r in got if r["host"] == "tie.site"}) == 1
    assert {r["path"] for r in got if r["host"] == "a.site"} == {long[13:]}


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, quality int")
    assert filter_urls(pages, labels).count() == 0
