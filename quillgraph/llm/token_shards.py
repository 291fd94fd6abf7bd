"""Training-order materialisation of token ids in fixed-stride shards.

The token ids of all documents form one stream, each document closed by an end
id, cut into sequences of equal length. A keyed Feistel network with
cycle-walking permutes the sequence numbers, which gives every sequence its
slot in training order without sorting or storing a permutation. Documents
stand in the stream in the order of their files, however the input is split.
Each task writes the shards of its slot range; a record's place in its file is
its slot times the stride, so reading is sequential and resumes anywhere.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import Broadcast, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.byte_bpe import ByteBpe
from quillgraph.llm.common import remove_at_exit, shared_root, shuffles_removed, staged
from quillgraph.llm.hashing import mix

MAGIC = b"QGSHARD1"
HEADER = "<8sIIQQ"  # magic, bytes an id, ids a record, first slot, records
HEADER_SIZE = struct.calcsize(HEADER)


@dataclass(frozen=True)
class Ids:
    """How texts become ids: ``encode`` gives little-endian ids of ``width`` bytes."""

    encode: Callable[[str], bytes]
    width: int
    end: bytes

    def __reduce__(self) -> tuple:  # functions of any kind can be sent
        return _ids_of, (cloudpickle.dumps(self.encode), self.width, self.end)


def _ids_of(encode: bytes, width: int, end: bytes) -> Ids:
    return Ids(cloudpickle.loads(encode), width, end)


def utf8_ids() -> Ids:
    """Byte-level ids: UTF-8 bytes as they are; 255, which UTF-8 never uses, ends a document."""
    return Ids(str.encode, 1, b"\xff")


@dataclass(frozen=True)
class _Narrow:
    """Encodes with a byte-level BPE codec in as few bytes an id as its vocabulary needs."""

    bpe: ByteBpe
    width: int

    def __call__(self, text: str) -> bytes:
        return self.narrow(self.bpe.packed(text))

    def narrow(self, packed: bytes) -> bytes:
        return np.frombuffer(packed, "<u4").astype(f"<u{self.width}").tobytes()

    def many(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.narrow, self.bpe.packed_all(texts))


def bpe_ids(bpe: ByteBpe) -> Ids:
    """Ids of a byte-level BPE codec, two bytes an id where the vocabulary allows; the largest number ends a document."""
    width = 2 if max(bpe.ranks, default=0) < 0xFFFF else 4
    return Ids(_Narrow(bpe, width), width, b"\xff" * width)


def feistel(numbers: np.ndarray, total: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. total - 1, applied to ``numbers``.

    The network permutes the next even power of two; values outside the range
    walk on along their cycle until they fall inside.
    """
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r + 1) & ((1 << 64) - 1))
            left, right = right, left ^ (mix(right + salt) & mask)
        out[todo] = x = left << np.uint64(half) | right
        todo = todo[x >= np.uint64(total)]
    return out.astype(np.int64)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows (file, row, text) in an order that doesn't depend on how the input is split.

    A scan of Parquet files has it: the row's number in its file. Any other
    frame (columns ``id``, ``text``) is written sorted by a hash of its rows.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "text"]
    try:
        return df.select(*place)
    except AnalysisException:
        key = [F.xxhash64("id", "text"), F.xxhash64("text", "id")]
        return staged(df.orderBy(*key), "shard-texts").select(*place)


def _encoded(ids: Broadcast):
    """Rows (file, row, text) to (file, since, start, n, ids); every document ends with the end id.

    A segment is a run of consecutive rows of a file in one task, named by its
    first row; ``start`` counts the ids before a document in its segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ids.value
        file = since = following = place = None
        for batch in batches:
            files, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            segments, starts, counts, data = [], [], [], []
            many = getattr(made.encode, "many", None)  # the codec may have a faster way for many texts
            encoded = (many or partial(map, made.encode))(batch.column(2).to_pylist())
            for name, row, value in zip(files, rows, encoded, strict=True):
                if name != file or row != following:
                    file, since, place = name, row, 0
                raw = value + made.end
                n = len(raw) // made.width
                segments.append(since)
                starts.append(place)
                counts.append(n)
                data.append(raw)
                place, following = place + n, row + 1
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (segments, starts, counts)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "since", "start", "n", "ids"])

    return run


def _pieces(width: int, length: int, total: int, key: int, per_shard: int, first_shard: int, end_shard: int):
    """Rows (start, ids) to the pieces of their sequences that belong into a range of shards."""
    size = length * width
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("at", pa.int32()), ("sequence", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sequence, parts, held = [], [], [], 0

            def ready() -> pa.RecordBatch:
                numbers = np.array(sequence, np.int64)
                slot = feistel(numbers, total, key)
                shard = slot // per_shard
                here = np.flatnonzero((shard >= first_shard) & (shard < end_shard))
                columns = [shard[here], slot[here], np.array(begin)[here], numbers[here], [parts[i] for i in here.tolist()]]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at = value.as_py(), start * width
                held += len(data)
                stop, first = at + len(data), at
                while at < stop:
                    end = min(stop, (at // size + 1) * size)
                    begin.append(at % size)
                    sequence.append(at // size)
                    parts.append(data[at - first : end - first])
                    at = end
                if held > 4_000_000:
                    yield ready()
                    begin, sequence, parts, held = [], [], [], 0
            if parts:
                yield ready()

    return run


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _writer(root: str, width: int, length: int, total: int, per_shard: int, end: bytes):
    """Sorted pieces to shard files; returns one row a record."""
    size = length * width
    schema = pa.schema([("slot", pa.int64()), ("sequence", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_ids", pa.int32()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        out = name = part = None
        shard, rows, record, now = -1, [], [], None

        def put() -> None:
            slot, sequence = now
            data = b"".join(record)
            out.write(data.ljust(size, end[:1] if width == 1 else b"\xff"))
            rows.append((slot, sequence, shard, HEADER_SIZE + (slot - shard * per_shard) * size, len(data) // width, hashlib.sha256(data).hexdigest()))

        def close() -> None:
            out.close()
            store.move(part, name)  # a shard appears whole or not at all

        def ready() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for s, slot, _, sequence, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and now[0] != slot:
                    put()
                    record = []
                now_shard = s
                if now_shard != shard:
                    if out is not None:
                        close()
                    shard = now_shard
                    name = f"{folder}/shard-{shard:06d}.bin"
                    part = f"{folder}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    out.write(struct.pack(HEADER, MAGIC, width, length, shard * per_shard, min(per_shard, total - shard * per_shard)))
                now = slot, sequence
                record.append(data)
            if len(rows) > 10_000:
                yield ready()
                rows = []
        if now is not None:
            put()
            close()
        if rows:
            yield ready()

    return run


def write_shards(
    df: DataFrame,
    root: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids: Ids | None = None,
    length: int = 2048,
    per_shard: int = 4096,
    key: int = 20_26,
    most_tasks: int = 20_000,
    most_sent: int = 200_000,
    rounds: int = 3,
) -> DataFrame:
    """Writes all texts as shards; one row per sequence: slot, sequence, shard, offset, n_ids, sha256.

    ``ids`` says how texts become ids (``bpe_ids``; UTF-8 bytes by default).
    Every text is encoded once, into a table of the shared folder. Documents
    stand in the stream as they stand in their Parquet files, files by name;
    a frame that is no scan of files is sorted by a hash of (id, text) first.
    So the shards depend on the rows and ``key`` only, not on the splits. A
    null text counts as empty and is just an end id; null and repeated ids are rows
    like any other. The last sequence is filled up with end ids, which ``n_ids``
    and ``sha256`` leave out. An empty table writes nothing. Other columns are
    not read.

    The ids are shuffled and the shards written in ``rounds``, a range of shards
    each, so that a part of the ids at a time is on disk a third time. In a
    round, a task writes a range of consecutive shards, one shard where there
    are at most ``most_tasks``. A task that runs again writes the same bytes under the
    same name; a finished shard is never seen half written, and what lost tasks
    left is removed. The shards are written by this call, once; the result is a
    table of the shared folder. ``root`` is a folder that all executors share;
    without it the shards go to ``spark.checkpoint.dir`` and vanish when the
    application ends.
    """
    ids = ids or utf8_ids()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ids)  # its size is the vocabulary's
    texts = df.withColumns({"id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))}).select("id", "text")
    encoded = staged(_numbered(texts).mapInArrow(_encoded(shared), "file string, since long, start long, n long, ids binary"), "shard-ids", "zstd")
    # one row per segment, that is, per file and split of the input
    before = Window.orderBy("file", "since").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(
        encoded.groupBy("file", "since")
        .agg(F.sum("n").alias("ids"))
        .select("file", "since", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")),
        "shard-bases",
    )
    found = bases.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids")).first()
    total = -(-found["ids"] // length)
    bases = bases.drop("ids")
    if found["segments"] <= most_sent:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, ["file", "since"]).withColumn("start", F.col("start") + F.col("base"))
    folder = root or f"{shared_root(spark)}/quillgraph-shards-{uuid.uuid4().hex}"
    if root is None:
        remove_at_exit(spark, folder)
    store, path = _open(folder)
    store.create_dir(path)
    shards = max(1, -(-total // per_shard))
    rounds = max(1, min(rounds, shards))
    parts = []
    for r in range(rounds):
        low, high = r * shards // rounds, (r + 1) * shards // rounds
        tasks = min(high - low, most_tasks)
        with shuffles_removed(spark):
            part = (
                placed.select("start", "ids")
                .mapInArrow(_pieces(ids.width, length, max(1, total), key, per_shard, low, high), "shard long, slot long, at int, sequence long, data binary")
                .repartitionById(tasks, F.expr(f"cast((shard - {low}) * {tasks} div {high - low} as int)"))
                .sortWithinPartitions("slot", "at")
                .mapInArrow(
                    _writer(folder, ids.width, length, total, per_shard, ids.end),
                    "slot long, sequence long, shard long, offset long, n_ids int, sha256 string",
                )
            )
            parts.append(staged(part, "shard-manifest"))
    manifest = reduce(DataFrame.unionByName, parts)
    for f in store.get_file_info(pa.fs.FileSelector(path)):
        if os.path.basename(f.path).startswith(".shard-"):
            store.delete_file(f.path)
    return manifest


def read_shards(folder: str, from_slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Records in training order from a slot on: (slot, ids)."""
    store, path = _open(folder)
    names = sorted(f.path for f in store.get_file_info(pa.fs.FileSelector(path)) if os.path.basename(f.path).startswith("shard-"))
    for name in names:
        with store.open_input_file(name) as f:
            _, width, length, first, records = struct.unpack(HEADER, f.read(HEADER_SIZE))
            if first + records <= from_slot:
                continue
            slot = max(first, from_slot)
            f.seek(HEADER_SIZE + (slot - first) * length * width)
            for s in range(slot, first + records):
                yield s, np.frombuffer(f.read(length * width), f"<u{width}")
