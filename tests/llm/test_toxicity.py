import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.toxicity import POWER, SubsequenceKernel, fit, fragments, keep_clean, score_toxicity, sentences, train

INSULTS = ("blockhead", "nincompoop", "scoundrel")


def made(n, seed):
    rng = random.Random(seed)
    syllables = "an be co du el fi go ha in jo ka le mi no or pe qu ra se ti".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        text = [[word() for _ in range(rng.randrange(4, 12))] for _ in range(rng.randrange(1, 6))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                rng.choice(text).insert(1, rng.choice(INSULTS))
        label = toxic if rng.random() > 0.04 else 1 - toxic
        rows.append((i, ". ".join(" ".join(s) for s in text) + ".", label, toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(900, 1)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(model):
    rows = made(400, 2)
    said = np.array(model.scores([r[1] for r in rows])) >= 0.5
    assert (said == np.array([r[3] for r in rows])).mean() > 0.97


def said(model, words):
    return dict(zip(words, model.scores([f"he is a {w} an be." for w in words]), strict=True))


def test_spelled_out_and_padded_insults(model):
    words = ["meko", "b l o c k h e a d", "n.i.n.c.o.m.p.o.o.p", "s-c-o-u-n-d-r-e-l", "nincompooop", "bloockhead", "blockkhead", "scounddrel", "block-head", "blokhead", "ninncomppoop"]
    plain, *others = said(model, words).values()
    assert plain < 0.2
    for word, score in zip(words[1:], others, strict=True):
        assert score >= 0.5 or (word == "blokhead" and score > 2 * plain), (word, score)


def test_clean_words_like_insults_are_told_apart():
    """Clean words near an insult become landmarks against it."""
    rng, rows = random.Random(5), made(700, 8)
    near = [(t.replace(".", " scoundrels.", 1) if rng.random() < 0.04 and not y else t, y) for _, t, _, y in rows]
    model = fit([t for t, _ in near], [y for _, y in near])
    assert "scoundrels" in model.landmarks
    got = said(model, ["scoundrels", "scoundrel"])
    assert got["scoundrels"] < 0.5 <= got["scoundrel"]


def test_other_scripts():
    """Letters of any script have codes of their own."""
    kernel = SubsequenceKernel(["привет", "idiot"])
    assert (kernel.against(["дурак", "banana", "中文字"]) == 0).all()
    assert np.allclose(kernel.against(["привет", "idiot"]), np.eye(2), atol=1e-5)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randrange(3, 8)))
    rows = [(" ".join([*(word() for _ in range(8)), *(["негодяй"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(400)]
    model = fit([t for t, _ in rows], [y for _, y in rows])
    scores = model.scores(["негодяй", "он негоодяй", "н е г о д я й", "привет мир", "дом и лес"])
    assert min(scores[:3]) >= 0.5 > max(scores[3:])


def test_training_and_scoring_pool_alike(model):
    """A long token counts with all its fragments, wherever they stand."""
    long = "anbecodublockheadelfigohainjokale"
    assert len(fragments(long)) > 1 and fragments("ab1") == [] and fragments("a" * 17) == ["a" * 16, "a" * 9]
    model.learn_tokens({long, *fragments(long)})
    assert model.memo[long] == sum(model.memo[w] for w in fragments(long))
    covered = "".join(fragments("abcdefghijklmnopqrstuvwxyz" * 3))
    assert set("abcdefghijklmnopqrstuvwxyz") <= set(covered)


def test_very_long_texts(model):
    text = "an be co. " * 200_000
    clean, toxic = model.scores([text, text + "du el blockhead fi."])
    assert clean < 0.5 <= toxic


def test_kernel_against_plain_sums():
    """Gap-weighted subsequences of order three, counted one by one."""
    from itertools import combinations

    def phi(w):
        out = {}
        for t in combinations(range(len(w)), 3):
            u = tuple(w[i] for i in t)
            out[u] = out.get(u, 0) + 0.75 ** (t[2] - t[0] + 1)
        return out

    def k(a, b):
        dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
        x, y = phi(a), phi(b)
        return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** POWER

    words, marks = ["idiot", "banana", "idiiot", "abc", "xyz", "бидон", "bändana"], ["idiot", "bandana", "дубина"]
    got = SubsequenceKernel(marks).against(words)
    assert np.allclose(got, [[k(a, b) for b in marks] for a in words], atol=1e-5)


def test_equal_texts_score_equally_and_order_does_not_matter(model):
    texts = [r[1] for r in made(50, 3)]
    assert model.scores(texts) == model.scores(texts[::-1])[::-1]


def test_degenerate_training():
    assert fit([], []).scores(["x", ""]) == fit(["a b"], [0]).scores(["x", ""])
    assert fit(["abc def"], [1]).scores(["x"])[0] > 0.99
    assert len(fit(["", "!"], [0, 1]).scores([""])) == 1


def test_sentences_hold_all_words():
    text = "A b. " + "we " * 100 + "! i d i o t. x-y-z and a.b"
    flat = [w for s in sentences(text) for w in s]
    assert flat.count("we") == 100 and {"idiot", "xyz", "a", "b"} <= set(flat) and max(map(len, sentences(text))) <= 24


def test_operators(spark, clashing, rows, no_docs):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = train(clashing, labels)
    got = score_toxicity(clashing, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    kept = keep_clean(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert score_toxicity(no_docs, train(no_docs, labels)).count() == 0
    learned = labels.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    assert train(clashing, learned).landmarks == model.landmarks
