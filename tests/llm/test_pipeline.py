"""Each stage of the corpus pipeline against a plain version, and all of them in a row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_superminhash import plain as plain_groups
from test_toxicity import made

import corpus_pipeline as pipeline
from quillgraph.llm.toxicity import train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The awkward documents, some toxic ones with labels, and ids that are null or said twice."""
    path = tmp_path_factory.mktemp("pipeline")
    extra = [(10_000 + i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in made(300, 9)]
    labels = [(10_000 + i, y, 1) for i, _, y, _ in made(300, 9)] + [(None, 1, 1), (10_001, None, None)]
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def found(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def stage(spark, name, docs, folder):
    return dict(pipeline.STAGES)[name](spark, docs, folder)


def test_the_order_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"]


def without_toxic(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [r for r in rows if model.scores([r[1] or ""])[0] < 0.5]


def without_repeats(rows):
    texts = plain_lines(rows)
    return [(r[0], None if r[1] is None else texts[r[0], r[1]][0], *r[2:4], None if r[1] is None else len(texts[r[0], r[1]][0])) for r in rows]


def without_copies(rows):
    return [r for r, (_, _, least) in zip(rows, plain_groups(rows, 5, 80), strict=True) if r[0] is None or r[0] == least]


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    kept = found(stage(spark, "toxicity", docs, folder))
    assert kept == Counter(without_toxic(spark, rows, folder))
    clean = {10_000 + i for i, _, _, toxic in made(300, 9) if not toxic}
    assert len(rows) - 100 < sum(kept.values()) < len(rows) and sum(r[0] in clean for r in kept) > 0.97 * len(clean)


def test_repeated_lines_go(spark, docs, folder):
    assert found(stage(spark, "line_dedup", docs, folder)) == Counter(without_repeats([tuple(r) for r in docs.collect()]))


def test_one_of_each_group_stays(spark, docs, folder):
    assert found(stage(spark, "near_dedup", docs, folder)) == Counter(without_copies([tuple(r) for r in docs.collect()]))


def test_sources_are_mixed(spark, docs, folder):
    before = Counter(tuple(r) for r in docs.collect())
    after = found(stage(spark, "mix_sources", docs, folder))
    words = lambda rows: Counter({s: sum(n * len(WORD.findall(r[1] or "")) for r, n in rows.items() if r[3] == s) for s in {r[3] for r in rows}})
    sizes, taken = words(before), words(after)
    names = sorted((s for s in sizes), key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in names:  # rows that are said twice share what is taken of them, so a word may be lost to rounding
        assert abs(taken[s] - (2 * sizes[s] if s in capped else level * weight[s])) <= 2, s
    texts = defaultdict(set)
    for r in before:
        texts[r[0], r[3]].add(r[1])
    for r, _ in after.items():
        assert any(t == r[1] or (t or "").startswith(r[1]) for t in texts[r[0], r[3]]) and r[4] == len(r[1])


def test_texts_are_encoded(spark, docs, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = enc.encode(r["text"] or "", disallowed_special=())
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in stage(spark, "byte_bpe", docs, folder).collect()) == want


def test_all_stages_in_a_row(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    left = without_copies(without_repeats(without_toxic(spark, rows, folder)))
    got = pipeline.run(spark, folder).collect()
    whole = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in left)
    ids, sizes = {r[0] for r in left}, {r[0]: len(WORD.findall(r[1] or "")) for r in left}
    assert {r["doc_id"] for r in got} <= ids and {i for i in ids if sizes[i] > 200} <= {r["doc_id"] for r in got}
    same = sum((r["doc_id"], r["decoded_sha256"]) in whole for r in got)
    assert same > 0.5 * len(got) and all(n <= 3 * whole[k] for k, n in Counter((r["doc_id"], r["decoded_sha256"]) for r in got).items() if k in whole)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_tables_and_extra_columns(spark, no_docs, clashing, folder, name):
    assert stage(spark, name, no_docs, folder).count() == 0
    extra = clashing.withColumn("__copy", F.lit(1)).withColumn("__id", F.lit("x"))
    after = stage(spark, name, extra, folder)
    assert after.count() > 0 and (name == "byte_bpe" or after.columns == extra.columns)
