"""Documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus(seed=3):
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empties, one long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    base = words(rng, 120)
    texts = ["", None, "one", "two words", "  spaced\tout \n text ", "Ünïcödé ßtraße 中文 😀"]
    texts += [" ".join(words(rng, rng.randrange(5, 200))) for _ in range(20)]
    texts += [" ".join(base)] * 3
    for _ in range(6):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for _ in range(4):
        texts.append(" ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30)))
    lines = [" ".join(words(rng, 8)) for _ in range(6)]
    texts += ["\n".join([" ".join(words(rng, 5)), *lines, " ".join(words(rng, 5))]) for _ in range(3)]
    texts.append(" ".join(words(rng, 6000)))
    texts.append("same " * 300)
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, " ".join(base), None, None, None))
    rows.append(rows[8])  # a row said twice
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = "kept keep_id group_size size target taken n hash flags bands set score held_out n_lines n_removed digest id tie".split()
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
