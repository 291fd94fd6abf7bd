import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillgraph.llm.mixing import mix_sources, mixed_documents, schedule, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(3, 1, 2)):
    """Targets by refilling until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.remove(s)
    return target


def test_targets_and_taken(clashing, rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = water(sizes)
    mixed = mix_sources(clashing).collect()
    assert len(mixed) == len(rows)
    taken = Counter()
    for r in mixed:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 64 for s in sizes)
    again = mix_sources(clashing).collect()
    pick = lambda rs: sorted((r["id"] or -1, r["tie"], r["taken"]) for r in rs)
    assert pick(again) == pick(mixed)


def test_capped_targets(spark):
    rows = [("a", 10), ("b", 1000), ("c", 30), (None, 5), ("e", 0)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = water(dict(rows))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_schedule_follows_the_golden_ratio(spark):
    targets = spark.createDataFrame([("a", 10, 60.0), ("b", 10, 30.0), ("c", 10, 10.0)], "source string, source_size long, target double")
    rows = sorted(schedule(spark, targets, 1, 500, chunk=64).collect())
    count = Counter()
    for slot, source, rank in rows:
        point = (slot + 1) * 0.6180339887498949 % 1
        assert source == ("a" if point < 0.6 else "b" if point < 0.9 else "c")
        assert rank == count[source]
        count[source] += 1
        assert abs(count["a"] - 0.6 * (slot + 1)) < 4


def test_mixed_rows_hold_what_is_taken(docs, rows):
    taken = defaultdict(int)
    for r in mix_sources(docs).collect():
        taken[r["id"]] += r["taken"]
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words, texts = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in got.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    twice = rows[8][0]
    assert all(abs(words[d] - taken[d]) <= (1 if d == twice else 0) for d in taken)


def test_empty_tables(spark, no_docs):
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix_sources(blank).select(F.col("taken")).collect()] == [0, 0]


def test_small_sources_get_their_targets(spark):
    """Blocks far larger than the small sources: each still gives its target to the word."""
    sizes = {"a": [700] * 60, "b": [7] * 43, "c": [1] * 100, "d": [90] * 8 + [80], "e": [500] * 5, "f": [2], None: [33]}
    rows = [(s, " ".join(["w"] * n)) for s, ns in sizes.items() for n in ns]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    for max_slots in (8, 40, 1 << 22):
        taken = Counter()
        for r in mix_sources(df, max_slots=max_slots).collect():
            goal = int(r["target"] + 0.5)
            whole, rest = divmod(goal, r["source_size"])
            assert r["taken"] == whole * r["size"] + min(max(rest - r["start"], 0), r["size"])
            taken[r["source"]] += r["taken"]
        assert taken == {s: int(t + 0.5) for s, t in water({s: sum(ns) for s, ns in sizes.items()}).items()}
    few = spark.createDataFrame([(1, "three words here", "a")], df.schema)
    assert mix_sources(few).first()["taken"] == 5
