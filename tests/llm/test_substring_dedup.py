import re

import pytest

from quillgraph.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """(words, kept words) by looking up every window of every smaller document."""
    least = {}
    split = [(doc, WORD.findall(text or "")) for doc, text, *_ in rows]
    for doc, w in split:
        for i in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[i : i + window])
                least[k] = min(doc, least.get(k, doc))
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_against_every_window(clashing, rows, window):
    got = [tuple(r) for r in substring_dedup(clashing, window=window).collect()]
    want = plain(rows, window)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 0


def test_empty_and_shared_ids(spark, no_docs):
    assert substring_dedup(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, "x " + text), (2, "y " + text)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in substring_dedup(df).collect())
    assert got == [(1, 60, 0), (1, 61, 0), (2, 61, 60)]
