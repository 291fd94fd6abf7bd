"""Byte-level BPE encoding and decoding.

A pre-token that is a vocabulary entry as a whole is found by a minimal perfect
hash; any other is merged from its bytes, with a heap of candidate pairs over a
linked list. Results of both tiers are kept in a bounded memo of text pieces.

Many texts at once are encoded by columns: pre-tokens are cut by the kinds of
neighbouring characters, each different one is resolved once, and new ones of
one length are merged side by side.
"""

from __future__ import annotations

import base64
import hashlib
import weakref
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NO_PAIR = 1 << 40  # above every rank
LONG = 48  # bytes from which a pre-token is merged on its own
AT_ONCE = 8_000_000  # characters whose pre-tokens are resolved together
SIDE_BY_SIDE = 10_000  # pre-tokens of one length that are merged together
#: the pattern whose pre-tokens ``_begins`` finds
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots, by displaced buckets.

    Keys fall into buckets; the fullest bucket first, each looks for a
    displacement that sends its keys to free slots. Buckets of one key are
    given a free slot outright, stored as a negative number.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2) -> None:
        self.n = len(keys)
        self.n_buckets = max(1, self.n // per_bucket)
        self.moves = [0] * self.n_buckets
        self.keys: list[bytes] = [b""] * self.n
        self.values = [0] * self.n
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        taken = bytearray(self.n)
        free = iter(range(self.n))
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) > 1:
                move = 0
                while True:
                    slots = {self._slot(hashes[i], move) for i in members}
                    if len(slots) == len(members) and not any(taken[s] for s in slots):
                        break
                    move += 1
                self.moves[b] = move
                placed = [(self._slot(hashes[i], move), i) for i in members]
            elif members:
                slot = next(s for s in free if not taken[s])
                self.moves[b] = -slot - 1
                placed = [(slot, members[0])]
            else:
                placed = []
            for slot, i in placed:
                taken[slot] = 1
                self.keys[slot], self.values[slot] = keys[i], i

    def _slot(self, h: int, move: int) -> int:
        return ((h >> 20) + move * ((h >> 41) | 1)) % self.n

    def find(self, key: bytes) -> int:
        """The key's position in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[h % self.n_buckets]
        slot = -move - 1 if move < 0 else self._slot(h, move)
        return self.values[slot] if self.keys[slot] == key else -1


class _Memo(dict):
    """Piece of text to its ids as bytes, in two generations of half of ``most`` entries.

    A full generation becomes the old one; what is still used is taken over
    from there, the rest is forgotten with it. The codec that makes the ids is
    held weakly: in a cycle with its memos it would stay in a Python worker,
    beside the next stage's model, until the collector runs after a task.
    """

    def __init__(self, owner: ByteBpe, make: Callable[[ByteBpe, str], bytes], most: int) -> None:
        super().__init__()
        self.owner, self.make, self.most, self.old = weakref.ref(owner), make, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = None  # goes before the copy is made
            self.old = dict(self)
            self.clear()
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = self.make(self.owner(), piece)
        self[piece] = ids
        return ids


def _kinds() -> np.ndarray:
    """By code point: letter, number, white space or other, as the pattern's library has them."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _begins(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``SPLIT`` begin, in the code points of texts one after the other.

    ``first`` marks where a text begins, and the end of the last one. Both
    arrays go on for two places beyond that end, so that no text is without
    followers to look at.
    """
    n = len(points) - 2
    kind = kinds[points]
    begin = np.empty(n + 2, bool)
    begin[0] = True
    begin[1:] = (kind[1:] != kind[:-1]) & (points[:-1] != 32)  # a space goes with what follows
    begin |= first
    space = kind == SPACE  # the last of a run stands apart from it, unless it ends the text
    last = np.flatnonzero(space[:-2] & space[1:-1] & ~space[2:]) + 1
    begin[last[~first[last + 1]]] = True
    # an apostrophe after others or a space belongs to them, so it doesn't begin a contraction
    at = np.flatnonzero(points[:n] == ord("'"))
    at = at[begin[at] & ~first[at + 1]]
    one = at[np.isin(points[at + 1], [ord(c) for c in "stmd"])]
    two = at[~first[at + 2]]
    a, b = points[two + 1], points[two + 2]
    two = two[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    for places, length in ((one, 2), (two, 3)):
        begin[places + 1] = False
        begin[places + length] = True
    return np.flatnonzero(begin[:n])


def _binary(ends: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """Pieces of ``data``, one after the other, as an Arrow column."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


class PairTable:
    """Ranks of pairs of ids by open addressing in NumPy arrays, for many pairs at once."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, ranks = (np.fromiter(x, np.int64, len(pairs)) for x in (pairs.keys(), pairs.values()))
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, NO_PAIR)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of those that want one slot the last gets it
            won = self.keys[at] == keys
            self.ranks[at[won]] = ranks[won]
            keys, ranks, at = keys[~won], ranks[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``NO_PAIR``."""
        keys = left << 32 | right
        at = self._slot(keys)
        found, there = self.ranks[at], self.keys[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        found[there != keys] = NO_PAIR
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            found[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return found


class ByteBpe:
    """A byte-level BPE codec for a rank file and a pre-token pattern."""

    def __init__(self, rank_file: bytes, pattern: str, memo_entries: int = 700_000) -> None:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, rank_file.splitlines()))
        self.tokens = {rank: token for rank, token in rows}
        self.ranks = [rank for rank, _ in rows]
        self.hash = PerfectHash([token for _, token in rows])
        by_token = self.by_token = {token: rank for rank, token in rows}
        self.of_byte = [by_token.get(bytes([b]), -1) for b in range(256)]
        #: (left id, right id) to the id of their join
        self.pairs = {
            by_token[token[:i]] << 32 | by_token[token[i:]]: rank
            for rank, token in rows
            for i in range(1, len(token))
            if token[:i] in by_token and token[i:] in by_token
        }
        self.pattern_text, self.memo_entries = pattern, memo_entries
        self._prepare()

    def _prepare(self) -> None:
        self.pattern = regex.compile(self.pattern_text)
        #: a space between white space, or after it at the end, belongs to a longer run
        self.runs = regex.compile(r"\s \s|\s \Z")
        self.plain = _Memo(self, ByteBpe._pieces, self.memo_entries)
        self.spaced = _Memo(self, ByteBpe._spaced_pieces, self.memo_entries)
        self.decimal = {rank: str(rank) for rank in self.ranks}
        of_byte, pair = self.of_byte, self.pairs.get
        #: by first and second byte: the rank of the pair, or -1
        self.of_bytes = [[pair(a << 32 | b, -1) for b in of_byte] for a in of_byte]
        self.after, self.before = list(range(1, 257)), list(range(-1, 255))
        self.table = self.kinds = self.entries = None

    def __getstate__(self) -> dict:
        made = ("pattern", "runs", "plain", "spaced", "decimal", "of_bytes", "after", "before", "table", "byte_ids", "kinds", "entries")
        return {k: v for k, v in self.__dict__.items() if k not in made}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._prepare()

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token: by the hash if it is an entry, else merged."""
        raw = token.encode()
        at = self.hash.find(raw)
        return array("I", (self.ranks[at],) if at >= 0 else self.merge(raw)).tobytes()

    def _spaced_pieces(self, piece: str) -> bytes:
        """Ids of a piece with the space before it."""
        if piece.isalpha():  # letters after a space are one pre-token
            return self._token(" " + piece)
        if piece[:-1].isalpha() and piece[-1] in ".,":  # then the mark is another
            return self.spaced[piece[:-1]] + self.plain[piece[-1]]
        return self._pieces(" " + piece)

    def _pieces(self, text: str) -> bytes:
        tokens = self.pattern.findall(text)
        if len(tokens) == 1:
            return self._token(text)
        spaced, plain = self.spaced, self.plain
        return b"".join([spaced[t[1:]] if t[0] == " " and t[1:].isalpha() else plain[t] for t in tokens])

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked pair, leftmost first."""
        pair, n = self.pairs.get, len(raw)
        ids = list(map(self.of_byte.__getitem__, raw))
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a byte")
        after = self.after[:n] if n <= 256 else list(range(1, n + 1))
        before = self.before[:n] if n <= 256 else list(range(-1, n - 1))
        of_bytes = self.of_bytes
        #: the rank of the pair that begins at each place, -1 for none
        now = [of_bytes[a][b] for a, b in zip(raw, raw[1:], strict=False)]
        heap = [rank << 32 | i for i, rank in enumerate(now) if rank >= 0]
        now.append(-1)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            rank = top >> 32
            if now[i] != rank:  # one of its parts has changed since
                continue
            j = after[i]
            ids[i], ids[j], now[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = now[i] = pair(rank << 32 | ids[k], -1)
                if new >= 0:
                    heappush(heap, new << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                new = now[h] = pair(ids[h] << 32 | rank, -1)
                if new >= 0:
                    heappush(heap, new << 32 | h)
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit little-endian numbers, without special tokens.

        A space with no white space on its other side always begins a
        pre-token, so a text is cut at spaces and the parts looked up in the
        memo; a text with longer runs of white space goes through the pattern.
        """
        if self.runs.search(text):
            plain = self.plain
            return b"".join([plain[token] for token in self.pattern.findall(text)])
        first, *rest = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def _merge_all(self, raws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pre-tokens of one length, a row of bytes each, merged side by side: (places of rows, their ids).

        Every round joins in each the lowest-ranked pair, leftmost first; those
        without any are done, so all others have the same number of ids left.
        """
        if self.table is None:
            self.table, self.byte_ids = PairTable(self.pairs), np.array(self.of_byte, np.int64)
        ids = self.byte_ids[raws]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        find, places, length = self.table.find, np.arange(len(raws)), raws.shape[1]
        ranks = find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raws), length - 1)
        for n in range(length, 0, -1):
            if n > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(ids)), at]
                open_ = best < NO_PAIR
            else:
                open_ = np.zeros(len(ids), bool)
            if not open_.all():
                yield places[~open_], ids[~open_]
                if not open_.any():
                    return
                ids, ranks, places, at, best = ids[open_], ranks[open_], places[open_], at[open_], best[open_]
            row = np.arange(len(ids))
            ids[row, at] = best
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(row), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(row), n - 2)
            for shift in (0, 1):  # the pairs that the new id begins and ends
                k = np.flatnonzero(at + 1 < n - 1 if shift == 0 else at > 0)
                a = at[k] - shift
                ranks[k, a] = find(ids[k, a], ids[k, a + 1])

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Pre-tokens that are no entries: (their places in another order, their ids in that order)."""
        starts, data = np.frombuffer(words.buffers()[1], np.int64), np.frombuffer(words.buffers()[2], np.uint8)
        lengths = np.diff(starts[: len(words) + 1])
        order = np.argsort(lengths, kind="stable")
        places, sizes, packed = [], [], []
        for members in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = lengths[members[0]]
            if length < LONG:
                for block in np.split(members, range(SIDE_BY_SIDE, len(members), SIDE_BY_SIDE)):
                    for rows, ids in self._merge_all(data[starts[block][:, None] + np.arange(length)]):
                        places.append(block[rows])
                        sizes.append(np.full(len(rows), ids.shape[1]))
                        packed.append(ids.astype("<u4").ravel())
            else:
                for i in members.tolist():
                    places.append([i])
                    packed.append(np.array(self.merge(data[starts[i] : starts[i] + length].tobytes()), "<u4"))
                    sizes.append([len(packed[-1])])
        ends = 4 * np.cumsum(np.concatenate(sizes))
        return np.concatenate(places), _binary(np.concatenate(([0], ends)), np.concatenate(packed))

    def _resolved(self, words: pa.Array) -> pa.Array:
        """Ids of different pre-tokens: entries are looked up, others merged."""
        n = len(self.by_token)
        if self.entries is None:
            ranks = np.fromiter(self.by_token.values(), "<u4", n)
            self.entries = pa.array(list(self.by_token), pa.large_binary()), _binary(np.arange(n + 1) * 4, ranks)
        entries, ids = self.entries
        at = pc.fill_null(pc.index_in(words, value_set=entries), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            places, merged = self._merged(words.take(pa.array(new)))
            at[new[places]] = n + np.arange(len(new))
            ids = pa.concat_arrays([ids, merged])
        return ids.take(pa.array(at))

    def _packed_column(self, texts: list[str]) -> Iterator[bytes]:
        """``packed`` of each text; a pre-token that they share is resolved once."""
        if self.kinds is None:
            self.kinds = _kinds()
        joined = "".join(texts)
        data, points = joined.encode(), np.frombuffer(f"{joined}\0\0".encode("utf-32-le"), "<u4")
        n = len(joined)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        first = np.zeros(n + 2, bool)
        first[bounds] = True
        begins = _begins(points, first, self.kinds)
        if not len(begins):
            yield from [b""] * len(texts)
            return
        at = np.append(begins, n)
        if len(data) > n:  # from characters to bytes
            wide = np.flatnonzero(points >= 0x80)
            more = np.zeros(n + 1, np.int32)
            more[wide + 1] = 1 + (points[wide] >= 0x800) + (points[wide] >= 0x10000).astype(np.int32)
            at += np.cumsum(more, dtype=np.int32)[at]
        tokens = _binary(at, data).dictionary_encode()
        ids = self._resolved(tokens.dictionary).take(tokens.indices)
        place = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begins, bounds)]
        packed = memoryview(ids.buffers()[2])
        for begin, end in zip(place.tolist(), place[1:].tolist(), strict=False):
            yield bytes(packed[begin:end])

    def packed_all(self, texts: list[str]) -> Iterator[bytes]:
        """``packed`` of each text; texts are encoded together until they have ``AT_ONCE`` characters."""
        if self.pattern_text != SPLIT:
            yield from map(self.packed, texts)
            return
        done = 0
        while done < len(texts):
            stop, held = done, 0
            while stop < len(texts) and held < AT_ONCE:
                held += len(texts[stop])
                stop += 1
            yield from self._packed_column(texts[done:stop])
            done = stop

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        return np.frombuffer(self.packed(text), np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file that the driver can open."""
    with open(path, "rb") as f:
        return ByteBpe(f.read(), pattern)


def encode_documents(df: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``ids`` array<int>. A null text counts as empty (no ids)."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for batch in batches:
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(df: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``decoded`` binary. Null ids decode to null."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for batch in batches:
            raw = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding: id, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, in one pass, so the ids need not travel. A null text
    counts as empty; null and repeated ids are passed through; other columns are
    not read. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
