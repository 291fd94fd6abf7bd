import hashlib

import numpy as np
import public_tokenizers
import pytest

from quillgraph.llm.byte_bpe import codec
from quillgraph.llm.token_shards import Ids, bpe_ids, feistel, read_shards, utf8_ids, write_shards


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    first, other = feistel(np.arange(total), total, 1), feistel(np.arange(total), total, 2)
    assert sorted(first) == list(range(total)) == sorted(other)
    if total > 100:
        assert (first != other).any() and (first != np.arange(total)).mean() > 0.9


def wide():
    """Two-byte ids, code points; made inside, as workers can't import this module."""
    return Ids(lambda text: b"".join((ord(c) % 65_000).to_bytes(2, "little") for c in text), 2, b"\xff\xff")


def tokens():
    return bpe_ids(codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@pytest.mark.parametrize("make", [utf8_ids, wide, tokens])
def test_shards_hold_every_id_once(clashing, tmp_path, make):
    folder, ids = str(tmp_path / "shards"), make()
    made = sorted(write_shards(clashing, folder, ids=ids, length=100, per_shard=50).collect())
    kind = f"<u{ids.width}"
    want = sorted(ids.encode(r["text"] or "") + ids.end for r in clashing.select("text").collect())
    records = list(read_shards(folder))
    assert [s for s, _ in records] == list(range(len(made))) == [r["slot"] for r in made]
    for (_, record), r in zip(records, made, strict=True):
        assert len(record) == 100 and hashlib.sha256(record[: r["n_ids"]].tobytes()).hexdigest() == r["sha256"]
    stream = b"".join(record[: r["n_ids"]].tobytes() for r, (_, record) in sorted(zip(made, records, strict=True), key=lambda x: x[0]["sequence"]))
    cut = np.frombuffer(stream, kind)
    marks = np.flatnonzero(cut == np.frombuffer(ids.end, kind)[0])
    starts = np.concatenate(([0], marks[:-1] + 1))
    assert sorted(cut[a : b + 1].tobytes() for a, b in zip(starts, marks, strict=True)) == want
    resumed = list(read_shards(folder, 70))
    assert resumed[0][0] == 70 and (resumed[0][1] == records[70][1]).all()


def test_tokens_of_shards_decode_to_the_texts(docs, rows, tmp_path):
    bpe = codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    folder = str(tmp_path / "shards")
    made = write_shards(docs, folder, ids=bpe_ids(bpe), length=64, per_shard=7).collect()
    order = {r["slot"]: r["sequence"] for r in made}
    stream = np.concatenate([ids for slot, ids in sorted(read_shards(folder), key=lambda r: order[r[0]])])
    parts = np.split(stream, np.flatnonzero(stream == 0xFFFF) + 1)
    texts = [bpe.decode(p[:-1].tolist()).decode() for p in parts if len(p)]
    fill = -(sum(r["n_ids"] for r in made)) % 64  # the last sequence is filled up with end ids
    assert sorted(texts) == sorted([t or "" for _, t, *_ in rows] + [""] * fill)


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.endswith(".crc")}


def test_the_split_of_the_input_and_another_run_change_nothing(docs, tmp_path):
    folder, other = tmp_path / "shards", tmp_path / "other"
    write_shards(docs.repartition(7), str(folder), length=256, per_shard=20)
    (folder / ".shard-000000-lost").write_bytes(b"what a lost task left")
    before = files(folder)
    write_shards(docs.coalesce(1), str(folder), length=256, per_shard=20)
    assert files(folder) == {k: v for k, v in before.items() if not k.startswith(".")}
    few = write_shards(docs, str(other), length=256, per_shard=20, most_tasks=2, most_sent=0)
    assert files(other) == files(folder) and few.select("shard").distinct().count() > 2


def test_files_give_one_order_at_any_split_size(spark, docs, tmp_path):
    """Small splits cut files into many segments; the shards stay the same."""
    docs.repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "docs"))
    made = {}
    for name, size in (("one", "128m"), ("many", "4k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = spark.read.parquet(str(tmp_path / "docs"))
            made[name] = df.rdd.getNumPartitions()
            write_shards(df, str(tmp_path / name), ids=tokens(), length=256, per_shard=20)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert made["many"] > made["one"] and files(tmp_path / "many") == files(tmp_path / "one")


def test_rounds_change_nothing(spark, docs, tmp_path):
    """Rounds write ranges of shards; shards and manifest stay the same, and the session's settings too."""
    made = {r: sorted(write_shards(docs, str(tmp_path / str(r)), ids=tokens(), length=64, per_shard=7, rounds=r).collect()) for r in (1, 4, 10_000)}
    assert made[1] == made[4] == made[10_000] and made[1][-1]["shard"] > 4
    assert files(tmp_path / "1") == files(tmp_path / "4") == files(tmp_path / "10000")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_edge_cases(spark, no_docs, tmp_path):
    assert write_shards(no_docs, str(tmp_path / "none")).count() == 0
    assert list(read_shards(str(tmp_path / "none"))) == []
    long = "alpha beta " * 200_000
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (None, None), (2, "")], "doc_id long, text string")
    made = write_shards(df, str(tmp_path / "long"), length=4096, per_shard=100).collect()
    assert sum(r["n_ids"] for r in made) == 2 * len(long) + 5
