import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import components as parts
from quillgraph.llm.components import components
from quillgraph.llm.superminhash import near_duplicates, superminhash
from quillgraph.llm.hashing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, size, percent):
    """Components by comparing all pairs that share a shingle."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets, posts = [], defaultdict(list)
    for i, r in enumerate(rows):
        w = WORD.findall(low(r[1]))
        sets.append(frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset())
        for s in sets[-1]:
            posts[s].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in posts[x] if j < i).items():
            both_named = rows[i][0] is not None and rows[j][0] is not None
            if both_named and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for j in range(i):
            if rows[i][0] is not None and rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(clashing, rows, size, percent):
    got = near_duplicates(clashing, size=size, percent=percent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(plain(rows, size, percent), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_near_copies(spark):
    """A bucket whose hub links to few: links between the others must not be lost."""
    base = [f"w{i}" for i in range(150)]
    texts, now = [], list(base)
    for i in range(300):
        now = list(now)
        now[(i * 7) % 150] = f"edit{i}"
        texts.append(" ".join(now))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in near_duplicates(df, size=3, percent=85).collect())
    assert got == sorted(plain(rows, 3, 85))


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        n = 400
        common = int(2 * n * share / (1 + share))
        pool = mix(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        both = superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 256)
        assert abs((both[0] == both[1]).mean() - share) < 0.1


def test_signature_does_not_depend_on_company():
    values = [mix(np.arange(i, i + n, dtype=np.uint64)) for i, n in ((0, 3), (9, 50), (77, 1))]
    owner = np.repeat(np.arange(3), [len(v) for v in values])
    together = superminhash(np.concatenate(values), owner, 3, 96)
    for i, v in enumerate(values):
        assert (superminhash(v, np.zeros(len(v), int), 1, 96)[0] == together[i]).all()
        assert (together[i] < np.uint64(96) << np.uint64(32)).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 200), (None, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert [tuple(r) for r in components(spark.createDataFrame([(4, 4)], "a long, b long")).collect()] == [(4, 4)]


@pytest.mark.parametrize("order", ["random", "falling"])
def test_long_chains_settle_in_few_rounds(spark, monkeypatch, order):
    """A path of 2,000 nodes with labels that a spreading minimum walks one by one."""
    n = 2000
    place = np.random.default_rng(4).permutation(n).tolist() if order == "random" else [0, *range(n - 1, 0, -1)]
    links = spark.createDataFrame(list(zip(place, place[1:], strict=False)), "a long, b long")
    rounds = []
    hooks = parts._hooks
    monkeypatch.setattr(parts, "_hooks", lambda edges, i: rounds.append(i) or hooks(edges, i))
    got = components(links).collect()
    assert len(got) == n and {r["root"] for r in got} == {0} and len(rounds) <= 30


def test_a_chain_of_versions_is_one_group(spark):
    """Each text is 3 words away from the one before; only neighbours are near enough."""
    now, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):
        now = list(now)
        for j in range(3):
            now[(i * 31 + j * 50) % 150] = f"v{i}x{j}"
        rows.append((1000 - i, " ".join(now)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(plain(rows, 3, 85))


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Each round is many small jobs, whose plans and tasks the driver holds."""
    tables = []
    staged = parts.staged
    monkeypatch.setattr(parts, "staged", lambda df, label: tables.append(label) or staged(df, label))
    links = [(i, i + 1) for i in range(300)] + [(900, 900)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {900: 900} | dict.fromkeys(range(301), 0) and len(tables) == 2


@pytest.mark.parametrize("at_once", [0, 1, 40, 100_000])
def test_components_however_many_links_are_left_to_one_task(spark, monkeypatch, at_once):
    rng = np.random.default_rng(8)
    names = [mix(np.array([i], np.uint64)).tobytes() for i in range(400)]
    ends = [*rng.integers(0, 400, (220, 2)).tolist(), *([5, i] for i in range(0, 60, 2)), *([i, i + 1] for i in range(200, 260)), [399, 399]]
    root = list(range(400))
    for a, b in ends:  # all of one label take the other
        root = [root[a] if r == root[b] else r for r in root]
    used = sorted({i for pair in ends for i in pair})
    least = {i: min(names[j] for j in used if root[j] == root[i]) for i in used}
    rounds = []
    hooks = parts._hooks
    monkeypatch.setattr(parts, "_hooks", lambda edges, i: rounds.append(i) or hooks(edges, i))
    monkeypatch.setattr(parts, "AT_ONCE", at_once)
    links = spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in ends] + [(None, bytearray(names[0]))], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(links.repartition(5)).collect()}
    assert got == {names[i]: n for i, n in least.items()}
    assert bool(rounds) == (at_once < 100_000)
