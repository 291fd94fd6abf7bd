import hashlib
from collections import defaultdict

import pytest

from quillgraph.llm.exact_dedup import exact_dedup, exact_groups, surviving_rows


@pytest.mark.parametrize(("frame", "most_sent"), [("docs", 2_000_000), ("clashing", 2_000_000), ("clashing", 0)])
def test_against_plain_grouping(request, rows, frame, most_sent):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    want = set()
    for text, members in groups.items():
        keep = max((d for d in members if d is not None), default=None)
        for d in members:
            want.add((d, keep, len(members), d == keep, hashlib.sha256(text.encode()).hexdigest()))
    got = exact_dedup(request.getfixturevalue(frame), most_sent=most_sent).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(rows)


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_same_length_and_prefix_do_not_make_copies(spark):
    head = "x" * 100
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(df).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True)}


@pytest.mark.parametrize("most_sent", [0, 100])
def test_only_what_is_left_is_digested(spark, most_sent):
    """Alone in length, alone in prefix, same prefix with another end, and true copies."""
    head = "x" * 70
    rows = [(1, "alone"), (2, "abc"), (3, "xyz"), (4, head + "a"), (5, head + "b"), (6, head + "a"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["id"] for r in surviving_rows(df, most_sent=most_sent).collect()) == [4, 5, 6, 7, 8]
    groups = {bytes(r["digest"]): (r["largest"], r["size"]) for r in exact_groups(df, most_sent=most_sent).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert groups == {digest(head + "a"): (6, 2), digest(""): (8, 2)}
