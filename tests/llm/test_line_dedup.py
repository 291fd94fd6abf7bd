import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillgraph.llm.line_dedup import line_chunks, line_dedup


def plain(rows):
    """Texts after removal, by going through all chunks in order."""
    ordered = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    seen, out = {}, {}
    places = defaultdict(list)
    for doc, text in ordered:
        lines = text.encode().split(b"\n")
        for first, n in line_chunks(lines):
            if n >= 2:
                places[b"\n".join(lines[first : first + n])].append((doc is None, doc or 0, first, text))
    for chunk, found in places.items():
        seen[chunk] = min(found)
    for doc, text in ordered:
        lines = text.encode().split(b"\n")
        gone = set()
        for first, n in line_chunks(lines) if len(lines) > 1 else []:
            chunk = b"\n".join(lines[first : first + n])
            if n >= 2 and seen[chunk][:3] != (doc is None, doc or 0, first):
                gone |= set(range(first, first + n))
        out[doc, text] = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(gone)
    return out


def test_against_plain_version(clashing, rows):
    want = plain(rows)
    got = line_dedup(clashing)
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == len(rows)
    texts = {r[0]: r[1] for r in rows}
    removed = 0
    for r in got.collect():
        if texts[r["doc_id"]] is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        assert (r["text"], r["n_removed"]) == want[r["doc_id"], texts[r["doc_id"]]]
        removed += r["n_removed"]
    assert removed > 0


def test_boundaries_resist_shifts():
    lines = [str(i * i).encode() for i in range(200)]
    ends = lambda ls, skip: {f + n - skip for f, n in line_chunks(ls)}
    moved = ends([b"new", b"lines", b"ahead", *lines], 3)
    assert len(ends(lines, 0) & moved) > 0.8 * len(ends(lines, 0))


def test_repeats_inside_one_text_and_empty_table(spark, no_docs):
    block = "\n".join(f"line {i}" for i in range(40))
    df = spark.createDataFrame([(1, block + "\n" + block)], "doc_id long, text string")
    row = line_dedup(df).first()
    assert 0 < row["n_removed"] <= 40 and row["text"].startswith(block[:40])
    assert line_dedup(no_docs).count() == 0


def test_every_repeated_run_of_lines_goes(spark):
    """Against a look-up of all runs: passages of 2 to 9 lines inside otherwise different texts."""
    rng = random.Random(5)
    shared = [[f"passage {p} line {i}" for i in range(2 + p % 8)] for p in range(40)]
    texts = []
    for d in range(120):
        lines = [f"own {d} {i}" for i in range(rng.randrange(1, 9))]
        for p in rng.sample(range(40), 2):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = shared[p]
        texts.append("\n".join(lines))
    texts.append("\n".join(["same"] * 5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup(df).collect()}

    earlier, everywhere = set(), set()
    for d, text in enumerate(texts[:-1]):
        lines, gone = text.split("\n"), set()
        for n in range(2, 10):
            for i in range(len(lines) - n + 1):
                run = tuple(lines[i : i + n])
                if run in earlier:
                    gone |= set(range(i, i + n))
        earlier |= {tuple(lines[i : i + n]) for n in range(2, 10) for i in range(len(lines) - n + 1)}
        assert got[d]["text"].split("\n") == ([x for i, x in enumerate(lines) if i not in gone] or [""])
        assert got[d]["n_removed"] == len(gone)
        everywhere |= set(lines)
    kept = {x for d in range(len(texts) - 1) for x in got[d]["text"].split("\n")} - {""}
    assert kept == everywhere
    assert got[len(texts) - 1]["text"] == "same\nsame"


def test_null_ids_are_rows_of_their_own(spark):
    """Many null ids: each text has its own repeats; helpers' names may be columns."""
    shared = "first common line\nsecond common line"
    rows = [(None, f"own {i}\n{shared}\nend {i}") for i in range(30)] + [(5, shared), (None, shared), (None, None), (None, "")]
    names = ["row", "text2", "cuts", "doc", "tie", "cut_doc", "__text", "__cuts", "a b.c", "n_removed"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    found = sorted((r["doc_id"] is None, r["text"] is None, r["text"] or "", r["n_removed"], r["a b.c"]) for r in got.collect())
    want = [(False, False, shared, 0, 8), (True, False, "", 0, 8), (True, False, "", 2, 8), (True, True, "", 0, 8)]
    want += [(True, False, f"own {i}\nend {i}", 2, 8) for i in range(30)]
    assert found == sorted(want)


def test_very_long_texts(spark):
    lines = "\n".join(f"line {i} of a long text" for i in range(100_000))
    got = line_dedup(spark.createDataFrame([(1, lines), (2, lines + "\nend")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == {1: (100_000, 0), 2: (100_001, 100_000)}
